import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilstone.llm import binary, components, decontaminate, licenses, neighbours, packing, quality, queries, sharding, simhash, substrings, tokens, warc, wordhash

from ..duck import assert_same

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- tokens


@pytest.mark.parametrize("path,keeps,width", [(WORD_BPE, False, 4), (BYTE_BPE, True, 2)])
def test_chunks_give_the_ids_of_the_whole_text(path, keeps, width, spark, sf_dir):
    texts = [r[0] for r in docs_of(spark, sf_dir).select("text").limit(60).collect()]
    texts += ["a \n b", "a  b\n\n c ", "  x\x1cy !\x1c z\t\t", "don't I'LL   é́ é À3 45", "", "   ", "a<|endoftext|> <|ENDOFTEXT|>x", "foo—bar foo…. baz(qux)[1]", "a  b \nc", "\n\nx", "naïve-café's"]
    code, tok = tokens.Encoder(path, keeps, width), Tokenizer.from_file(path)
    for text, got in zip(texts, code.batches([t.encode() for t in texts], most=2000)):
        assert np.frombuffer(got, code.kind).tolist() == tok.encode(text, add_special_tokens=False).ids, text[:60]


def test_an_encoder_outlives_its_task_and_keeps_a_bounded_cache(monkeypatch):
    code = tokens.encoder(WORD_BPE, False)
    list(code.batches([b"one two three four five " + b"x" * 60]))
    assert tokens.encoder(WORD_BPE, False) is code and set(code.known) >= {"one", "two", "three", "four", "five"}
    monkeypatch.setattr(tokens, "CACHE_ROWS", 8)
    text, tok = "six seven one two eight nine ten eleven " + "y" * 60, Tokenizer.from_file(WORD_BPE)
    for _ in range(2):
        (got,) = code.batches([text.encode()])
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
        assert 5 < len(code.known) <= 8 and "y" * 60 not in code.known
    tokens.encoder(BYTE_BPE, True, 2)
    assert list(tokens._ENCODERS) == [(BYTE_BPE, True, 2)]  # a worker holds one


# ---- 1 packing


def check_packing(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_and_tight(spark, sf_dir):
    rows = queries.op1_packing(spark, sf_dir).collect()
    tok, texts = Tokenizer.from_file(WORD_BPE), dict(docs_of(spark, sf_dir).select("doc_id", "text").collect())
    want = {}
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        for piece, lo in enumerate(range(0, len(ids), 2048)):
            part = ids[lo : lo + 2048]
            want[i, piece] = (lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    total = sum(v[1] for v in want.values())
    assert check_packing(rows) <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = np.bincount(rng.integers(1, 65, 3000), minlength=65) if seed else np.bincount([64] * 5 + [40] * 7 + [1] * 3, minlength=65)
    entries, n = packing.plan(hist, 64)
    used, fill = defaultdict(set), Counter()
    for length, lo, hi, first, offset, times in entries:
        for j in range(lo, hi):
            assert j not in used[length]
            used[length].add(j)
            fill[first + (j - lo) // times] += length
    assert all(used[i] == set(range(hist[i])) for i in range(1, 65)) and max(fill.values()) <= 64 and len(fill) == n
    assert n <= (hist * np.arange(65)).sum() / 64 * 1.05 + 3 or seed == 0


def test_packing_of_odd_rows(odd, none):
    rows = packing.packed_documents(odd, WORD_BPE).collect()
    check_packing(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in odd.select("doc_id").collect())
    assert next(r for r in rows if r.doc_id == 2).length == 1
    assert packing.packed_documents(none, WORD_BPE).count() == 0


# ---- 2 neighbours


def test_neighbours_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    held = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in held]), np.array([r[1] for r in held], float)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        true = [j for j in np.lexsort((ids, d)) if j != i][:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == ids[i])
        assert [g[0] for g in got] == list(range(1, 11))
        assert all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in got)
        hit += len({g[1] for g in got} & {int(ids[j]) for j in true})
        total += 10
    assert hit / total >= 0.9


def test_recall_on_the_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    held = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in held]), np.array([r[1] for r in held], float)
    hit = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(found[int(ids[i])] & {int(v) for v in ids[np.argsort(d, kind="stable")[:10]]})
        total += 10
    assert total == 10 * len(found) and hit / total >= 0.9


def test_blocks_of_entries_and_queries_change_no_result(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = sorted(neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect())
    assert sorted(neighbours.nearest(df, F.col("vec_id") % 10 == 0, block=7, query_block=3).collect()) == whole


def test_neighbours_of_copies_and_faulty_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0, 0.5, float(i % 3)]) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 4), (1002, [None, 1.0, 1.0, 1.0]), (1003, [nan] * 4), (1100, [1.0]), (None, [1.0] * 4), (299, [1.0, 2.0, 0.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert {r.query_id for r in got} == {0, 100, 200}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == list(range(3, 33, 3))
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert {r.rank for r in neighbours.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()} == {1, 2}


def test_walk_visits_cells_in_order_of_distance():
    rng = np.random.default_rng(0)
    index = neighbours.MultiIndex.fit(rng.normal(size=(500, 6)), 5)
    index.counts = {c: 1 for c in range(25)}
    a, b = rng.random(5), rng.random(5)
    walked = index.walk(a, b, 25)
    sums = [a[c // 5] + b[c % 5] for c in walked]
    assert len(set(walked)) == 25 and sums == sorted(sums)


# ---- 3 near-duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    k = min(4, len(words))
    counts, n = [0] * 64, len(words) - k + 1
    for i in range(n):
        h = xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > n)


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, sf_dir):
    rows = queries.op3_simhash(spark, sf_dir).collect()
    prints = {r[0]: brute_fingerprint(r[1]) for r in docs_of(spark, sf_dir).select("doc_id", "text").collect()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_no_link_is_lost_at_any_chain_length(spark, length):
    rng = np.random.default_rng(length)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    values = set(base.tolist())
    for v in base.tolist():
        for flips in range(1, 7):
            x = v
            for b in rng.choice(63, flips, replace=False):
                x ^= 1 << int(b)
            values.add(x)
    nodes = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = {(r.a, r.b) for r in simhash.links(nodes, 4, length).collect()}
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}
    assert got == want
    # fewer links, the same components
    few = {(r.a, r.b) for r in simhash.connecting_links(nodes, 4, length).collect()}
    assert few <= want and dict(components.components(spark.createDataFrame(list(few), "a long, b long")).collect()) == dict(components.components(spark.createDataFrame(list(want), "a long, b long")).collect())


def test_a_large_group_of_near_copies_costs_few_links(spark):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**62))
    values = {base} | {base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 62, (600, 2))}
    nodes = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    few = simhash.connecting_links(nodes).collect()
    assert len(few) < 30 * len(values) and len({r.root for r in components.components(spark.createDataFrame(few)).collect()}) == 1


def test_components_of_long_chains(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = dict(components.components(links).collect())
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert components.components(links.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].component_id == by[1].component_id == 0 and by[2].component_id == by[3].component_id == by[4].component_id == 2 and by[2].fingerprint == 0
    assert simhash.near_duplicates(none).count() == 0


def test_keys_are_merged_although_their_nodes_would_fit_a_broadcast(spark, monkeypatch):
    nodes = spark.range(2000).select(F.xxhash64("id").alias("fingerprint"))
    plans = []

    def kept(df, name, *args, **more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return df

    monkeypatch.setattr(simhash, "save", kept)
    simhash.meetings(nodes)
    plans.append(("links", simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()))
    assert [name for name, _ in plans] == ["meetings", "links"]
    for _, plan in plans:
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


# ---- 4 quality


def test_quality_on_the_held_out_third(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op4_quality(spark, sf).collect()}
    assert len(rows) == docs_of(spark, sf).count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.quality for r in labels) / len(labels) >= 0.95


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^ \t\r\n\f\x0B]+", text.translate(LOWER))
    n, m = len(text), len(words)
    stop = "the and of to in is it that for with der die das und von zu mit den ist le la les de des et un une que el los las y en por con".split()
    count = lambda of: sum(text.count(c) for c in of)
    return {
        "n_chars": n,
        "n_words": m,
        "word_length": n / m if m else 0,
        "distinct_share": len(dict.fromkeys(words)) / m if m else 0,
        "repeat_share": sum(words[i] == words[i - 1] for i in range(1, m)) / m if m else 0,
        "upper_share": count(string.ascii_uppercase) / n if n else 0,
        "mark_share": count(string.punctuation) / n if n else 0,
        "odd_mark_share": count("#$%&*@^~<>{}=+_\\") / n if n else 0,
        "digit_share": count(string.digits) / n if n else 0,
        "bar_share": text.count("|") / m if m else 0,
        "exclaim_share": text.count("!") / m if m else 0,
        "line_length": n / (text.count("\n") + 1),
        "stop_share": sum(w in stop for w in words) / m if m else 0,
        "wide_share": (len(text.encode()) - n) / n if n else 0,
    }


def test_every_statistic_equals_plain_python(spark, odd, sf_dir):
    more = ["Ünï çödé \u2028 x\x1cy | a|b !! The the THE, the", "#$%&*@^~<>{}=+_\\ 0123456789", "é" * 3000 + "\n\n\n|", "\t \n"]
    docs = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in more], "text string")).unionByName(docs_of(spark, sf_dir).select("text"))
    rows = quality.with_statistics(docs).collect()
    assert len(rows) > 200
    for r in rows:
        want = plain_statistics(r.text)
        assert list(want) == list(quality.STATISTICS) and r["__statistics"] == pytest.approx(list(want.values()), rel=1e-12), r.text[:60]


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = ("Ab, cé 9|!\n" * 50).encode()
    whole = quality.text_statistics(text)
    monkeypatch.setattr(quality, "PART_BYTES", 7)
    assert quality.text_statistics(text) == whole


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, 1), (7, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.scored(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert set(odd.columns) <= set(quality.scored(odd, labels).columns)
    assert {r.score for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(none, labels).count() == 0


def test_compiled_rules_equal_the_fitted_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.7)).astype(int)
    model = quality.RuleEnsemble.fit(x, y)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    got = np.array([r[0] for r in df.select(model.score("v")).collect()])
    total = np.full(len(x), model.bias)
    for w, rule in model.rules:
        total += w * quality._holds(x, rule)
    for w, j, lo, hi in model.linear:
        total += w * (np.clip(x[:, j], lo, hi) - lo)
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and ((got >= 0.5) == y).mean() > 0.97


# ---- 5 licenses


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(label, i) for label, p in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for _, i in found]
    return (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in found})))


def test_license_places_match_brute_force(spark, odd, none):
    more = ["x Under the MIT License. under the mit license under THE mit. license", "cc by nc by nc cc by nc cc CC-BY-NC", "Apache License, Version 2.0 apache license version 2", "éunder the mit license", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"]
    docs = odd.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(more)], "doc_id long, text string, n_words int")).unionByName(docs_of(spark, "/root/testdata/sf0.01").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(0).alias("n_words")))
    rows = licenses.summary(licenses.scan(docs)).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str)
    want = sorted(((i if i is not None else -1, *brute_licenses(t)) for i, t, _ in docs.collect()), key=str)
    assert got == want
    by = {r.doc_id: r for r in rows}
    assert by[104].labels == "bsd" and all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert licenses.summary(licenses.scan(none)).count() == 0


def brute_labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = set()
    for t in licenses.templates():
        for s in range(-len(t.words), len(words)):
            if all(s + at >= 0 and tuple(words[s + at : s + at + len(own)]) == own for at, own in t.phrases):
                found.add(t.label)
    return ",".join(sorted(found))


def test_all_labels_of_files_with_several_notices(spark):
    by = {label: sentence for label, sentence, _ in licenses.TEMPLATES}
    several = [["bsd", "gpl-3"], ["bsd", "gpl-3", "isc", "mpl-2", "unlicense"], list(by), list(by)[::-1], ["gpl", "lgpl", "agpl-3", "cc0"]]
    texts = [". And ".join(by[x] for x in labels) for labels in several]
    texts += [" ".join(s for _, s, _ in licenses.TEMPLATES), "x " * 3000 + texts[1] + " y" * 3000]
    texts += [" ".join(p) for _, _, p in licenses.TEMPLATES] + [f"{by['isc']} {' '.join(p)}" for _, _, p in licenses.TEMPLATES]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + r.doc_id, r.text) for r in docs_of(spark, "/root/testdata/sf0.01").collect()]
    scanned = licenses.summary(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.labels for r in scanned} == {i: brute_labels(t) for i, t in rows}
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in scanned)
    assert {r.doc_id: r.labels for r in scanned}[0] == "bsd,gpl-3"


# ---- 6 WARC


def test_warc_matches_sql(spark, sf_dir):
    assert_same(queries.op6_warc(spark, sf_dir), queries.ORACLES["op6_warc"], sf_dir)


def test_history_is_globally_ordered_over_several_merges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 8)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(7)
    rows = warc.capture_history(warc.write_archives(pages), split_rows=9).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r.part].append(warc.sort_key([r.urlkey, r.ts, r.page_id]))
    flat = [k for p in sorted(parts) for k in parts[p]]
    assert flat == sorted(flat) and len(flat) == pages.count() and len(parts) > 1


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_loser_tree_merges(k):
    rng = np.random.default_rng(k)
    runs = [sorted([f"k{rng.integers(0, 9)}", "t", int(rng.integers(0, 99)), "w", 0, 0] for _ in range(rng.integers(0, 12))) for _ in range(k)]
    runs = [sorted(r, key=warc.sort_key) for r in runs]
    got = list(warc.merged([iter(r) for r in runs]))
    assert [warc.sort_key(r) for r in got] == sorted(warc.sort_key(r) for run in runs for r in run)


def test_warc_of_odd_pages(spark):
    big = "x" * 2000
    rows = [(1, "http://a.example/", big), (2, None, big), (3, "http://a.example/", None), (4, "bad\r\nurl", ""), (None, "http://a.example/", big), (2, None, big), (5, "http://b.example/", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d"))
    manifest = warc.write_archives(pages)
    got = warc.read_archives(warc.capture_history(manifest), manifest.count()).collect()
    assert all(r.sound for r in got) and len(got) == 7
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert {(r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got if r.page_id == 1} == {("revisit", 2, 2000, sha)}
    assert {r.record_type for r in got if r.page_id in (2, 3, 4, 5, None)} == {"response"}
    assert next(r.payload_bytes for r in got if r.page_id == 5) == 1200
    empty = warc.write_archives(pages.limit(0))
    assert warc.read_archives(warc.capture_history(empty), 0).count() == 0


# ---- 7 decontamination


def test_decontamination_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op7_decontaminate(spark, sf).collect()}
    items = {r.item_id: decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    posts = defaultdict(set)
    for i, w in items.items():
        for j in range(len(w) - 4):
            posts[tuple(w[j : j + 5])].add(i)
    want = {}
    for r in docs_of(spark, sf).select("doc_id", "text").collect():
        w = decontaminate.words_of(r.text.encode())
        for i in {i for j in range(len(w) - 4) for i in posts.get(tuple(w[j : j + 5]), ())}:
            n = min(len(items[i]), len(w))
            best = max(decontaminate.similarity(w[s : s + n], items[i], 5) for s in range(len(w) - n + 1))
            if best >= 0.8:
                want[r.doc_id, i] = best
    assert got == want and got


def test_the_lookup_alone_finds_the_item():
    """Windows of other words than the item's: fingerprints within the radius find it, others don't."""
    rng = np.random.default_rng(2)
    own = rng.integers(0, 2**63, 40).astype(np.uint64) * np.uint64(2)
    sizes, numbers = np.repeat(np.arange(20, 24, dtype=np.int32), 10), np.arange(40)
    scanner = decontaminate.Scanner(sizes, numbers, own, 15)
    for size, index in scanner.sizes.items():
        held = {int(n): int(p) for n, p in zip(index.numbers, index.prints)}
        asked = []
        for p in held.values():
            for bits in (0, 7, 15, 16, 30):
                asked.append(p ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
        found = {(n, int(r), int(b)) for n, rows, diffs in index.find(np.array(asked, np.uint64)) for r, b in zip(rows, diffs)}
        assert found == {(n, r, (p ^ q).bit_count()) for n, p in held.items() for r, q in enumerate(asked) if (p ^ q).bit_count() <= 15} and len(found) >= 30


def test_block_tables_name_the_least_bits_and_pass_few_other_prints():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 16, 5).astype(np.uint16)
    want = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)[:, None] ^ values).min(1)
    assert (decontaminate.least_bits(values) == want).all()
    for n in (1, 6, 7, 23, 50, 300):
        draw = lambda n: rng.integers(0, 2**64, n, np.uint64)
        index, asked = decontaminate.MultiIndex(np.arange(n), draw(n), 15), draw(20_000)
        blocks, met = asked.view(np.uint16).reshape(-1, 4).T, 0
        for tables in index.tables:
            sums = sum(table[values] for table, values in zip(tables, blocks))
            met += ((sums.view(np.uint8) & 128) == 0).sum()
        assert met <= 20_000 * 0.01 * (n // 6 + 1)
        near = index.prints ^ np.uint64(0x7FFF)
        assert {(i, int(r)) for i, rows, _ in index.find(near) for r in rows} >= {(i, i) for i in range(n)}


def test_sums_of_bits_in_runs():
    hashes = np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    for n in (0, 1, 31, 32, 33, 1000):
        for kind in (np.uint8, np.int64):
            want = np.concatenate([np.zeros((1, 64), kind), np.cumsum(bits[:n], axis=0, dtype=kind)])
            assert (decontaminate.bit_sums(hashes[:n], kind) == want).all()


@pytest.mark.parametrize("lengths", [[1, 2, 37], [11, 254, 255, 256, 700], [300, 900, 66_000]])
def test_prints_of_all_sizes_are_made_in_one_pass(lengths, monkeypatch):
    """A run of any length serves all sizes: prints are those of the windows, whatever pieces they are made in."""
    monkeypatch.setattr(decontaminate, "MOST_SUMS", 1024)
    hashes = np.random.default_rng(6).integers(0, 2**64, lengths[-1] + 1500, np.uint64)
    hashes[600:1000] = hashes[5]  # counts far from half of a window
    for piece in (256, 1000, 4096):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        out = np.full((len(lengths), len(hashes)), 7, np.uint64)
        decontaminate.window_prints(hashes, lengths, out)
        for row, n in zip(out, lengths):
            last = len(hashes) - n
            for s in {0, 1, 255, 256, 257, 599, 700, 999, 1000, 1001, last - 1, last} & set(range(last + 1)):
                assert int(row[s]) == decontaminate.simhash(hashes[s : s + n]), (piece, n, s)
            assert (row[last + 1 :] == 7).all()


def test_large_arrays_are_not_mapped_afresh_for_each_text(monkeypatch):
    """Memory of counts, prints and look-ups is taken once, and given back when the task ends."""
    rng = np.random.default_rng(4)
    sizes = np.array([20, 33, 400], np.int32)
    scanner = decontaminate.Scanner(sizes, np.arange(3), rng.integers(0, 2**64, 3, np.uint64), 15)
    hashes = rng.integers(0, 2**64, 5000, np.uint64)
    left, heads = np.arange(5000, 0, -1), np.array([0])
    decontaminate._SPACE.clear()
    list(scanner.find(hashes, left, heads))
    held = {name: id(a) for name, a in decontaminate._SPACE.items()}
    list(scanner.find(hashes[:4000], left[1000:], heads))
    assert held and {name: id(a) for name, a in decontaminate._SPACE.items()} == held
    decontaminate._SPACE.clear()


def test_items_in_parts_and_short_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    monkeypatch.setattr(decontaminate, "STRETCH", 64)
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 999, n))
    items = [(i, text(n)) for i, n in enumerate([6, 12, 30, 30, 31, 80, 300, 5, 4, 1])]
    docs = [(i, f"{text(150)} {t} {text(40)}") for i, t in items if i < 9]
    docs += [(20, items[5][1].rsplit(" ", 8)[0]), (21, items[6][1].rsplit(" ", 30)[0]), (22, items[6][1].rsplit(" ", 100)[0]), (23, items[9][1]), (24, text(5))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect() if r.item_id < 9}
    want = set()
    for d, t in docs:
        w = t.split()
        for i, x in items[:9]:
            own, k = x.split(), min(5, len(x.split()))
            n = min(len(w), len(own))
            if n >= k and any(decontaminate.similarity(w[s : s + n], own, k) >= 0.8 for s in range(len(w) - n + 1)):
                want.add((d, i))
    assert got == want and {(20, 5), (21, 6)} <= got


def test_a_smaller_similarity_holds_for_short_documents_too(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:28])), (2, " ".join(words[:24])), (3, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    found = lambda least: {r.doc_id for r in decontaminate.contaminated(docs, items, least, 31).collect()}
    assert found(0.8) == {3} and found(0.6) == {1, 3} and found(0.5) == {1, 2, 3}


def test_edited_passages_are_found(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    item = [word() for _ in range(80)]
    near, far = list(item), list(item)
    near[40] = "changed"
    for i in (10, 25, 40, 55, 70):
        far[i] = "changed"
    docs = [(1, " ".join([word() for _ in range(50)] + near + [word() for _ in range(50)])), (2, " ".join(far)), (3, " ".join(item).upper() + "!"), (4, None), (None, " ".join(item)), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3))
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (None, "x y"), (11, "two words"), (12, "")], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 9), (3, 9), (None, 9)}
    assert next(r for r in got if r.doc_id == 1).first_word == 50
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


# ---- 8 sharding


def test_shards_are_even_gapless_and_reproducible(spark, sf_dir):
    rows = queries.op8_sharding(spark, sf_dir).collect()
    again = queries.op8_sharding(spark, sf_dir).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    n = [len(v) for v in slots.values()]
    assert len(n) == 40 and max(n) - min(n) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = dict(docs_of(spark, sf_dir).select("doc_id", "text").collect())
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 1000, 10007])
def test_feistel_is_a_permutation(spark, n):
    got = spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    a, b = sharding.rectangle(n)
    assert a * b >= n


def plain_shards(rows, shards, seed=20240131):
    """(doc_id, size, crc) -> (shard, slot), by a Feistel network of plain integers."""
    n, prime = len(rows), sharding.PRIME
    blocks = max(1, -(-n // sharding.ROWS_PER_BLOCK))

    def block(row):
        h = 7
        for k in row:
            h = (h * 1000003 + k % prime) % prime
        return h % blocks

    a, b = sharding.rectangle(n)
    state, keys = seed % prime, []
    for _ in range(2 * sharding.ROUNDS):
        state = (state * 48271 + 11) % prime
        keys.append(state + 1)

    def turn(x):
        left, right = x % a, x // a
        for i in range(sharding.ROUNDS):
            m, c = keys[2 * i], keys[2 * i + 1]
            half = right if i % 2 == 0 else left
            t = (half * m + c) % prime
            t = (t * t + half + c) % prime
            if i % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        return right * a + left

    out = {}
    for number, row in enumerate(sorted(rows, key=lambda r: (block(r), r))):
        p = turn(number)
        while p >= n:
            p = turn(p)
        out[row] = (p % shards, p // shards)
    return out


def test_shards_match_a_plain_feistel_network(spark, sf_dir):
    rows = {(r.doc_id, r.size, r.text_crc32): (r.shard, r.slot) for r in queries.op8_sharding(spark, sf_dir).collect()}
    assert rows == plain_shards(list(rows), 40)
    wide = spark.range(9000).select("id", (F.col("id") * 7 % 13).alias("size"), F.lit(0).alias("crc"))
    got = {(r.id, r.size, r.crc): (r.shard, r.slot) for r in sharding.feistel_shards(wide, ["id", "size", "crc"], 7).collect()}
    assert got == plain_shards(list(got), 7)


def test_shards_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(i, "x", 5, 1, 2) for i in range(10)], "id long, shard string, slot int, __n int, __block int")
    got = sharding.feistel_shards(df, ["id"], 3)
    assert got.columns == ["id", "__n", "__block", "shard", "slot"] and {(r["__n"], r["__block"]) for r in got.collect()} == {(1, 2)}


def test_shards_of_odd_rows(odd, none):
    docs = odd.select("doc_id", F.length("text").alias("size"))
    got = sharding.feistel_shards(docs, ["doc_id", "size"], 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd.select("doc_id").collect())
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    assert sharding.feistel_shards(none.select("doc_id", "n_chars"), ["doc_id", "n_chars"], 4).count() == 0


# ---- 9 token files


def test_token_files_round_trip(spark, sf_dir):
    rows = sorted(queries.op9_token_files(spark, sf_dir).collect())
    tok, texts = Tokenizer.from_file(BYTE_BPE), dict(docs_of(spark, sf_dir).select("doc_id", "text").collect())
    at = 0
    for r in rows:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(rows) == len(texts)


def test_token_files_of_odd_rows(odd, none):
    rows = binary.read_tokens(binary.write_tokens(odd, BYTE_BPE, 2)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd.select("doc_id").collect())
    order = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    assert next(r for r in rows if r.doc_id == 2).n_tokens == 1
    assert binary.read_tokens(binary.write_tokens(none, BYTE_BPE, 2)).count() == 0


# ---- 10 substrings


def brute_substrings(rows, k=13):
    least = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - k + 1 if i is not None else 0):
            x = tuple(w[j : j + k])
            least[x] = min(least.get(x, i), i)
    out = []
    for i, w in words:
        cut = [False] * len(w)
        for j in range(len(w) - k + 1 if i is not None else 0):
            if least[tuple(w[j : j + k])] < i:
                cut[j : j + k] = [True] * k
        kept = [x for x, c in zip(w, cut) if not c]
        out.append((i if i is not None else -1, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out)


def test_substrings_match_sql(spark, sf_dir):
    assert_same(queries.op10_substrings(spark, sf_dir), queries.ORACLES["op10_substrings"], sf_dir)


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 500_000, "hot": 0.0}, {"bucket_bytes": 200_000, "hot": 0.75}, {"bucket_bytes": 1000, "most_buckets": 3, "hot": 1.01}])
def test_substrings_match_brute_force_with_hot_buckets(spark, sf_dir, odd, none, sizes):
    docs = odd.select("doc_id", "text", "kept_text", "n_words").unionByName(docs_of(spark, sf_dir).select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit("").alias("kept_text"), F.lit(0).alias("n_words")))
    got = substrings.without_repeats(docs, **sizes).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substrings([(r[0], r[1]) for r in docs.collect()])
    assert substrings.without_repeats(none, **sizes).count() == 0


def test_equal_hashes_of_other_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "word_hashes", lambda line: (None, None, np.zeros(line.count(b" ") + line.count(b"\n") + 1, np.uint64)))
    least, at = substrings._smallest([b"a b c", b"a b d", b"a b c d"], np.array([3, 2, 1]), 3)
    assert least.tolist() == [1, 2, 1, 1] and at.tolist() == [0, 1, 2, 4]


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    line = b"aa bb aa\ncc " + b"d" * 40 + b" bb"
    whole = wordhash.word_hashes(line)[2]
    assert whole[0] == whole[2] and whole[1] == whole[5] and len(set(whole.tolist())) == 4
    monkeypatch.setattr(wordhash, "STRETCH", 45)
    assert (wordhash.word_hashes(line)[2] == whole).all()
    x = np.random.default_rng(0).integers(0, 99, 50)
    assert wordhash.sliding_min(x, 7).tolist() == [min(x[i : i + 7]) for i in range(44)]
