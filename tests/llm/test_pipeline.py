import os
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from veilstone.llm import decontaminate, nearcopies, quality
from veilstone.llm.common import save

from .test_operators import brute_substrings, check_packing

SF = "/root/testdata/sf0.01"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, good), (_, near), (_, cut), (_, leaks), (_, pack) = corpus_pipeline.STAGES
    kept = save(good(spark, docs, SF), "t")
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert sum((i in ids) == bool(q) for i, q in labels.items()) / len(labels) > 0.97

    single = save(near(spark, kept, SF), "t")
    texts = {r.doc_id: r.text for r in kept.collect()}
    roots = brute_near_copies(texts)
    assert {r[0] for r in single.select("doc_id").collect()} == set(roots.values())

    thin = save(cut(spark, single, SF), "t")
    want = {i: (n, gone, text) for i, n, gone, text in brute_substrings([(i, texts[i]) for i in set(roots.values())])}
    got = {r.doc_id: r for r in thin.collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not gone or n > gone}
    assert all(r.text == (want[i][2] if want[i][1] else texts[i]) and r.n_chars == len(r.text) for i, r in got.items())

    clean = save(leaks(spark, thin, SF), "t")
    items = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    firsts = defaultdict(list)
    for w in items:
        firsts[tuple(w[:5])].append(w)
    gone = set(got) - {r[0] for r in clean.select("doc_id").collect()}
    for i, r in got.items():
        w = decontaminate.words_of(r.text.encode())
        verbatim = any(w[j : j + len(own)] == own for j in range(len(w) - 4) for own in firsts.get(tuple(w[j : j + 5]), ()))
        assert verbatim <= (i in gone)
    assert gone and len(gone) < len(got) / 5
    rows = pack(spark, clean, SF).collect()
    check_packing(rows)
    assert {r.doc_id for r in rows} == set(got) - gone


def brute_near_copies(texts):
    """doc_id -> smallest doc_id reachable over pairs of five-word Jaccard similarity 0.8 or more."""
    sets = {i: nearcopies.shingles(t.encode()) for i, t in texts.items()}
    holders, root = defaultdict(list), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in holders[s])
        for j, n in both.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: find(i) for i in texts}


def test_near_dedup_stage_matches_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = set(brute_near_copies(texts).values())
    assert got.columns == docs.columns and {r[0] for r in got.select("doc_id").collect()} == want
    assert not {875, 944, 255, 770} & want  # near copies more than four bits apart


def test_near_copies_match_brute_force_on_edited_texts(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for family in range(30):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(4, 160)))] + "a line that many of these texts share in full".split() * (family % 3 > 0)
        for _ in range(8):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 5))):
                words[at] = f"v{rng.integers(0, 5000)}"
            texts[len(texts)] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_near_copies(texts)
    assert 30 < len(set(want.values())) < 240
    rows = nearcopies.near_copies(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id for r in rows if r.kept} == set(want.values())


def test_crowded_keys_move_back_and_no_pair_is_lost(spark):
    """A passage in every text, held by too many for a key; pairs of 0.8 and more, just over and just under."""
    rng = np.random.default_rng(11)
    passage, texts = [f"p{i}" for i in range(60)], {}
    for family in range(40):
        base = [f"w{x}" for x in rng.integers(0, 90000, int(rng.integers(20, 200)))]
        for _ in range(4):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 25))):
                words[at] = f"v{rng.integers(0, 90000)}"
            at = int(rng.integers(0, len(words)))
            texts[len(texts)] = " ".join(words[:at] + passage + words[at:])
    docs, want = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), brute_near_copies(texts)
    assert 40 <= len(set(want.values())) < 160
    for crowd in (4, 40, 10**9):
        assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, crowd=crowd).collect()} == want
    held = spark.createDataFrame(list(texts.items()), "id long, text string")
    widest = lambda crowd: nearcopies._spread_keys(held, 5, 0.8, crowd).groupBy("key").count().agg(F.max("count")).first()[0]
    nearcopies.SAMPLE, before = 1, nearcopies.SAMPLE  # too small a sample to know the passage
    try:
        assert 3 * widest(10) < widest(10**9) > 100
    finally:
        nearcopies.SAMPLE = before


def test_a_pair_meets_about_once_however_many_keys_it_shares(spark):
    """Long texts that share half of their words: they share many keys, and bitmaps don't tell them apart."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 90000, n))
    texts = [(i, f"{shared} {text(400)}") for shared in (text(600), text(600)) for i in range(12)]
    held = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "id long, text string")
    none = np.zeros(0, np.uint64), np.zeros(0)
    keys = nearcopies._keys(held, 5, 0.8, none).withColumns({"root": F.col("id"), **{b: F.lit(0).cast("long") for b in nearcopies.BITS}}).cache()
    x, y = keys.alias("x"), keys.filter("indexed").alias("y")
    together = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id"))).count()
    fitting = nearcopies._meeting(keys, 0.25)
    pairs, rows = fitting.distinct().count(), fitting.count()
    assert pairs == 132 and 8 * rows < together, (pairs, rows, together)


def test_bitmaps_tell_texts_just_below_the_similarity_apart():
    """150 shingles each, 20 of them other ones: similarity 0.76."""
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    allowed, met = 300 - 2 * int(np.ceil(0.8 / 1.8 * 300)), 0
    for _ in range(300):
        both = draw(130)
        a, b = (nearcopies.parities(np.concatenate([both, draw(20)])) for _ in range(2))
        met += int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= allowed
    assert met < 30, met


def test_the_node_that_shares_most_keys_is_a_centre(spark):
    """Node 0 meets all others, two at each of its keys; they have no other key in common."""
    rows = [(k, i, 20, 0, i) for k in range(40) for i in (0, 2 * k + 1, 2 * k + 2)]
    held = spark.createDataFrame(rows, "key long, id long, n int, pos int, root long")
    bitmaps = held.select("id").distinct().withColumns({b: F.lit(0).cast("long") for b in nearcopies.BITS})
    met = nearcopies._to_centres(held.join(nearcopies.folded(bitmaps), "id"), bitmaps, nearcopies.CENTRES, 0.8).collect()
    assert {(0, i) for i in range(1, 81)} <= {(r.a, r.b) for r in met} and len(met) <= 3 * 81


def test_near_dedup_leaves_only_the_tables_that_its_result_reads(spark, odd):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(shared))
    out = nearcopies.near_copies(odd)
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(shared)) - before)
    assert out.count() == odd.count() and left == ["near-named", "near-rows"]


def test_bitmaps_differ_in_no_more_bits_than_the_sets_in_members():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 90, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 5], rng.integers(0, 2**63, n // 6).astype(np.uint64)])
        bits = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(nearcopies.parities(a), nearcopies.parities(b)))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and not (nearcopies.parities(a) ^ nearcopies.parities(a)).any()


def test_rows_that_share_an_id_or_have_none_are_decided_by_their_own_text(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9999, n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    a, b, c = text(60), text(60), text(60)
    rows = [(1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (3, item), (3, c + " x"), (None, "x " + item), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    first = lambda *held: any(sorted(near, key=str) == sorted([(1, a), (1, b), (3, c + " x"), (4, None), x], key=str) for x in held)
    assert first((3, item))
    clean = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_leaks(spark, docs, SF).collect()), key=str)
    assert clean == sorted((x for x in rows if item not in (x[1] or "")), key=str)


def test_odd_rows_pass_through(spark, odd, none):
    """Columns of the user's, also of names that operators use, come back as they were."""
    names = ["row_hash", "__row", "__digest", "__print", "__key", "__text", "kept", "component_id", "predicted", "n_removed", "own_0", "__spans"]
    docs = odd.withColumns({c: F.lit(f"my {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
            for r in out.collect():
                assert (r.score, r.kept_text, r.n_words, r.lang) == (2.0, "k", 7, "en") and all(r[c] == f"my {c}" for c in names)
        else:
            out.count()
        assert stage(spark, docs.filter(F.lit(False)), SF).count() == 0
    assert quality.STATISTICS
