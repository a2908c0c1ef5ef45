"""Manifest, resampling and order-sensitive fingerprints against SQL and plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstone.llm import manifest, numbering, orderhash, queries, resample

from ..duck import assert_same


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """(root, siblings of each leaf as (left, right) level by level) of a list of hashes."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            run, j = runs[i // 16], i % 16
            paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[k] = i // 16
        level = [h("".join(r)) for r in runs]
    return level[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        made = [(r, h("".join(map(field, r)))) for r in groups[s]]
        made.sort(key=lambda x: (x[0][0] if x[0][0] is not None else -(2**63), x[1]))
        trees[s] = (made, *plain_tree([x[1] for x in made]))
    root, above = plain_tree([trees[s][1] for s in order])
    out = []
    for s, up in zip(order, above):
        made, subroot, paths = trees[s]
        for (r, leaf), path in zip(made, paths):
            steps, start = path + up, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                start = h("".join(map(field, (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))))
            for a, b in steps:
                start = h(a + start + b)
            out.append((r[0], leaf, subroot, root, h("".join(a + b for a, b in steps)), start, start == root))
    return out


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("name", ["op11_manifest", "op12_resample"])
def test_queries_match_sql(name, spark, sf_dir):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


DOC = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 17, 300])
def test_manifest_matches_plain_trees_of_all_sizes(spark, n):
    rows = [(i * 37, "ab"[i % 11 == 0], "en", i, f"Text {i}") for i in range(n)]
    got = [tuple(r) for r in manifest.audited(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert all(r[6] == (zlib.crc32(str(r[0]).encode()) % 5 != 0) for r in got)


def test_manifest_of_odd_rows(spark, odd, none):
    rows = [
        (None, None, None, None, None), (None, None, "x", None, "No id"), (-5, None, None, 1, ""), (-(2**62), "", "e", 2, "A"), (2**62, "", "e", 2, "A"),
        (7, "é", "", 0, "Ünï"), (7, "z", "", 0, "Ünï"), (7, "z", "", 0, "Ünï"), (7, "z", "", 0, "another"), (8, "z", None, 0, None), (63, "z", None, 0, "B" * 100000), (64, "z", None, 0, "C"),
    ] + [(5, "same", "en", 1, "Row")] * 40 + [(i, "z", None, 0, "D") for i in range(9, 300, 7)]
    got = [tuple(r) for r in manifest.audited(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    more = odd.withColumn("leaf", F.lit("mine")).withColumn("g", F.lit(1)).withColumn("idx", F.lit(1)).withColumn("at", F.lit(1))
    got = [tuple(r) for r in manifest.audited(more).collect()]
    want = plain_manifest([tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert manifest.audited(none).collect() == []


def test_every_altered_text_is_found_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = manifest.audited(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0 or not re.search("[A-Z]", r.text))


def test_numbers_follow_the_order_over_all_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000 - 2500).alias("v"), F.lit(1).alias("__m"), F.lit(2).alias("row_no"))
    got = numbering.numbered(rows.union(rows.limit(3)), [F.asc("v")], "t").orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(5003)) and [r.v for r in got] == sorted(r.v for r in got)
    assert numbering.numbered(rows.limit(0), [F.asc("v")], "t").collect() == []


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), [zlib.crc32(f) % 10000 for f in words + [a + b" " + b for a, b in zip(words, words[1:])]]


def plain_resample(rows, wanted):
    made = [(i, *plain_features(t)) for i, t in rows]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, _, f in made:
        np.add.at(s, f, 1)
    for text in wanted:
        np.add.at(t, plain_features(text)[1], 1)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (int(s.sum()) + 10000) / ((float(a) + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s, t)]
    out = []
    for i, n, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        noise = (int(h(f"7:{'' if i is None else i}")[:8], 16) + 0.5) / 4294967296
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(noise))), n])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0], r[2], r[1]))
    place = {id(r): k + 1 for k, r in enumerate(fit[: 25 * len(fit) // 100])}
    return [(*r[:4], place.get(id(r))) for r in out]


def test_resampling_matches_plain_python(spark, odd, none, monkeypatch):
    long = "w" * 65 + " " + "v" * 64 + " " + "é" * 33 + " q " + "w" * 300 + " ab"
    rows = [(i, ("Alpha beta, gamma-" * (i % 7 + 1) + long + " Ünï\nx\x00y " * 9) if i % 5 else "short text") for i in range(90)]
    rows += [tuple(r) for r in odd.select("doc_id", "text").collect()]
    wanted = ["gamma beta alpha", None, "", long, "x y x y"]
    target = spark.createDataFrame([(t,) for t in wanted], "text string")
    want = plain_resample(rows, wanted)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, score int, rank string")
    got = [tuple(r) for r in resample.resampled(docs, target).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert resample.resampled(none, target).collect() == []
    assert {r["weight"] for r in resample.resampled(odd, target.limit(0)).collect()} >= {0}
    # documents are kept apart however few texts a slice has and however few words are remembered
    monkeypatch.setattr(resample, "SLICE_ROWS", 1)
    monkeypatch.setattr(resample, "MOST_WORDS", 3)
    assert resample.Features().of([b"a b", b"", b"c\nd e"])[0].tolist() == [0, 0, 2, 2, 2, 0, 2, 2]
    alone = resample.Features()
    for text in (r[1] for r in rows):
        words, features = plain_features(text)
        doc, bucket, count = alone.of([(text or "").encode()])
        assert bucket.tolist() == features and count.tolist() == [words] and not doc.any()


def plain_signature(text):
    """Order MinHash by its definition: all pairs of k-mer and occurrence number, sorted in each order."""
    raw = text.encode()
    if not raw:
        return [0] * 64
    mix = lambda v: int(orderhash.mixed(np.array([v % 2**64], np.uint64))[0])
    padded, seen, pairs = bytes(7) + raw, {}, []
    for i in range(len(raw)):
        kmer = mix(int.from_bytes(padded[i : i + 8], "little") + orderhash.BASE)
        n = seen[kmer] = seen.get(kmer, -1) + 1
        pairs.append((kmer, (mix(kmer + n * orderhash.BASE) if n else kmer) >> 32))
    out = []
    for p in range(64):
        a = int(orderhash.FACTORS[p, 0])
        least = sorted(range(len(pairs)), key=lambda i: (pairs[i][1] * a % 2**32, i))[:2]
        v = p + 1
        for kmer in [*[pairs[i][0] for i in sorted(least)], 0][:2]:
            v = mix(v * orderhash.BASE + kmer)
        out.append(max(1, v >> 48))
    return out


def plain_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in rows]
    prints = [plain_signature(t) for t in texts]
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / 64
    shown = lambda s: b"".join(x.to_bytes(2, "little") for x in s).hex()
    out = []
    for k, (i, _) in enumerate(rows):
        text, j = texts[k], (k + 1) % len(rows)
        half = len(text) // 2
        changed = text[: len(text) - half] + texts[j][:half]
        other = plain_signature(changed)
        out.append((i, len(text), h(changed), shown(prints[k]), shown(other), like(prints[k], other), like(prints[k], prints[j])))
    return out


def test_fingerprints_match_the_definition(spark, monkeypatch):
    rows = [(i, " ".join(f"wörd{i * j % 17}" for j in range(i * 3 % 50))) for i in range(60)]
    rows += [(60, "x" * 5000), (61, "ab" * 3000), (62, "ab" * 3000), (63, None), (64, ""), (None, "no id"), (65, "é"), (66, "two"), (-7, "last " * 2000)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, part string, place int")
    want = plain_fingerprints(rows)
    got = [tuple(r) for r in orderhash.fingerprints(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    monkeypatch.setattr(orderhash, "MOST_PARTS", 1)
    assert sorted((tuple(r) for r in orderhash.fingerprints(docs).collect()), key=key) == sorted(want, key=key)
    alone = docs.filter("doc_id = 66")
    assert [tuple(r) for r in orderhash.fingerprints(alone).collect()] == plain_fingerprints([(66, "two")])


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = orderhash.fingerprints(odd).collect()
    assert len(got) == odd.count() and orderhash.fingerprints(none).collect() == []
    by = {}
    for r in odd.select("doc_id", "text").collect():
        by.setdefault(r.text or "", set()).update(x.fingerprint for x in got if x.doc_id == r.doc_id)
    assert all(len(p) == 1 for p in by.values()) and len({p for s in by.values() for p in s}) == len(by)


def test_likeness_follows_edits_and_order(sf_dir, spark):
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.desc("n_chars")).first().text
    own = orderhash.signature(text.encode())
    words = text.split(" ")
    like = lambda t: orderhash.likeness(own, orderhash.signature(t.encode()))
    assert like(text) == 1
    few, many = text.replace(words[50], "changed", 1), text[: len(text) // 2] + text[len(text) // 4 :]
    assert like(few) > 0.9 > like(many) > like("something else " * 300)
    moved = " ".join(words[len(words) // 2 :] + words[: len(words) // 2])  # the same words, halves swapped
    assert 0.3 < like(moved) < 0.8


def test_half_an_edit_is_nearer_than_the_next_document(spark, sf_dir):
    got = orderhash.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).collect()
    assert len(got) == 200
    assert sum(r.near_edited > r.near_next for r in got) >= 196
    assert 0.08 < sum(r.near_edited for r in got) / len(got) < 0.25  # (1/3)^2 at a Jaccard similarity of 1/3
