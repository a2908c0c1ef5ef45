"""Merged statistics of runs, job documents with unknown fields, context rules per term, styles per word."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilstone.operators import extras, runstats
from veilstone.plans import report_queries  # noqa: F401
from veilstone.plans.registry import ORACLES, QUERIES
from veilstone.sources import documents

from .duck import assert_same


def hits(spark, n=20_000):
    score = F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000)
    return spark.range(n).select((F.col("id") % 5).alias("run"), (F.col("id") % 7).cast("string").alias("entry"), F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("lang"), F.pmod(F.xxhash64("id"), F.lit(4001)).alias("doc_id"), score.alias("score"))


def test_merged_statistics_equal_a_single_pass_and_sketches_are_near(spark):
    rows = hits(spark).cache()
    by_run = runstats.run_partials(rows, ["entry", "lang"], 0.25)
    at_once = runstats.run_partials(rows.withColumn("run", F.lit(0)), ["entry", "lang"], 0.25)
    sets = [["entry", "lang"], ["lang"], []]
    exact = ["entry", "lang", "level", "n", "scored", "low", "score_min", "score_max"]
    merged, single = runstats.merged_stats(by_run, sets), runstats.merged_stats(at_once, sets)
    key = lambda r: str(r)
    assert sorted(merged.select(exact).collect(), key=key) == sorted(single.select(exact).collect(), key=key)
    truth = {"": rows, "lang": rows.filter("lang = 1"), "entry,lang": rows.filter("lang is null and entry = '3'")}
    for level, part in truth.items():
        want = {"": "level = ''", "lang": "level = 'lang' and lang = 1", "entry,lang": "level = 'entry,lang' and lang is null and entry = '3'"}[level]
        got = merged.filter(want).collect()
        assert len(got) == 1
        scores = sorted(r.score for r in part.select("score").collect() if r.score is not None)
        assert abs(got[0].docs / part.select("doc_id").distinct().count() - 1) < 0.06
        assert got[0].n == part.count() and abs(got[0].score_mean - sum(scores) / len(scores)) < 1e-9
        for q, value in zip([0.05, 0.5, 0.95], got[0].score_q):
            below, upto = sum(s < value for s in scores) / len(scores), sum(s <= value for s in scores) / len(scores)
            assert below - 0.04 <= q <= upto + 0.04
    rows.unpersist()


def test_statistics_of_nothing_and_of_matches_without_scores(spark):
    none = runstats.run_partials(hits(spark, 0), ["lang"], 0.25)
    assert runstats.merged_stats(none, [["lang"]]).count() == 0
    one = runstats.merged_stats(none, [[]]).collect()
    assert [(r.level, r.n, r.docs, r.score_mean, r.score_q) for r in one] == [("", 0, 0, None, None)]
    bare = runstats.merged_stats(runstats.run_partials(hits(spark, 50).withColumn("score", F.lit(None).cast("double")), ["lang"], 0.25), [[]]).first()
    assert (bare.n, bare.scored, bare.low, bare.score_mean, bare.score_q) == (50, 0, 0, None, None)


def test_report_counts_only_known_durations(spark):
    durations = spark.createDataFrame([(1, 100.0), (2, None), (3, -5.0), (4, 50.0)], "doc_id long, duration_sec double")
    rates = spark.createDataFrame([("a", 2.0, 1.0), ("b", 0.0, 3.0)], "step string, factor double, fixed_sec double")
    assert sorted(map(tuple, runstats.estimated_seconds(durations, rates).collect())) == [("a", 2, 150.0, 302.0), ("b", 2, 150.0, 6.0)]
    assert sorted(map(tuple, runstats.estimated_seconds(durations.limit(0), rates).collect())) == [("a", 0, 0.0, 0.0), ("b", 0, 0.0, 0.0)]


DOCS = [
    (1, '{"b": {"deep": [{"x": null}, 1e3]}, "a": "caf\\u00e9 \\"q\\"", "steps_completed": ["p"], "n": 12345678901234567890}'),
    (2, '{"job_id":'), (3, "[1]"), (4, None), (5, '{ "q" : 1.50 }'), (6, '{"a":1} x'), (7, "{}"), (8, ""), (9, '{"a":1}{"a":2}'), (10, '{"steps_completed": "odd", "k": true}'), (11, '{"a":1}]}'),
]


def texts(spark):
    return spark.createDataFrame(DOCS, "k long, doc string")


def test_documents_that_are_one_object(spark):
    fine, corrupt = documents.split_documents(texts(spark))
    assert sorted(r.k for r in fine.collect()) == [1, 5, 7, 10]
    assert sorted(r.k for r in corrupt.collect()) == [2, 3, 4, 6, 8, 9, 11]


def test_changed_documents_keep_what_is_unknown_and_others_their_text(spark):
    changes = [(1, "a", '"new"'), (1, "z", '{"y":[1]}'), (1, "c", "[]"), (1, "n", None), (1, "bad", "{"), (7, "b", "true"), (7, "none", None), (2, "a", "1"), (99, "a", "1")]
    df = spark.createDataFrame(changes, "k long, field string, value string")
    got = dict(map(tuple, documents.put_fields(texts(spark), df, "k").collect()))
    assert list(json.loads(got[1]).items()) == [("b", {"deep": [{"x": None}, 1000.0]}), ("a", "new"), ("steps_completed", ["p"]), ("c", []), ("z", {"y": [1]})]
    assert json.loads(got[7]) == {"b": True}
    assert {k: v for k, v in got.items() if k not in (1, 7)} == {k: v for k, v in DOCS if k not in (1, 7)}
    same = documents.put_fields(texts(spark), df.limit(0), "k")
    assert sorted(map(tuple, same.collect())) == DOCS


def test_round_trip_through_fields_loses_nothing(spark):
    r = random.Random(3)

    def value(depth):
        kind = r.randrange(7 if depth else 5)
        return [None, r.randrange(-(10**15), 10**15), r.random() < 0.5, "é\n\"\\" + str(r.random()), r.randrange(1000) / 8, [], {}][kind] if kind < 5 else ([value(depth - 1) for _ in range(r.randrange(4))] if kind == 5 else {f"k{i}": value(depth - 1) for i in range(r.randrange(4))})

    docs = [(i, json.dumps({f"f{j}": value(3) for j in range(r.randrange(6))})) for i in range(60)]
    df = spark.createDataFrame(docs, "k long, doc string")
    changes = df.select("k", F.lit("added").alias("field"), F.lit("1").alias("value"))
    got = dict(map(tuple, documents.put_fields(df, changes, "k").collect()))
    assert {k: json.loads(t) for k, t in got.items()} == {k: json.loads(t) | {"added": 1} for k, t in docs}


def test_steps_follow_events_one_by_one(spark):
    r = random.Random(5)
    events = [(k, i, r.choice("pqrs"), r.choice(["done", "done", "undo", "error"])) for k in (1, 5, 7, 10, 2) for i in range(30)]
    got = dict(map(tuple, documents.steps_after(texts(spark), spark.createDataFrame(events, "k long, seq int, step string, action string"), "k").collect()))
    for k in (1, 5, 7, 10):
        done = ["p"] if k == 1 else []
        for _, _, step, action in [e for e in events if e[0] == k]:
            if action == "done" and step not in done:
                done.append(step)
            if action == "undo" and step in done:
                done.remove(step)
        assert json.loads(got[k])["steps_completed"] == done
    assert got[2] == '{"job_id":'


def test_paths_and_folders(spark, tmp_path):
    for name, text in (("j1", '{"job_id": "a",\n "mux": {"files": ["x", "y"]}}'), ("j2", "{")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    raw = documents.scan_documents(spark, str(tmp_path))
    got = documents.with_paths(raw, {"file": ("$.mux.files[1]", "string"), "n": ("$.job_id", "int"), "no": ("$.x.y", "string")})
    assert sorted((r.dir, r.file, r.n, r.no) for r in got.collect()) == [("j1", "y", None, None), ("j2", None, None, None)]
    with pytest.raises(ValueError, match="columns exist"):
        documents.with_paths(raw, {"dir": ("$.a", "string")})


def test_context_of_a_term_matches_plain_python(spark):
    r = random.Random(9)
    texts = {d: [r.choice(["god", "oh", "dear", "Praise,", "thank", "x", "hell"]) for _ in range(120)] for d in range(4)}
    words = spark.createDataFrame([(d, i, w) for d, ws in texts.items() for i, w in enumerate(ws)], "doc_id long, word_index int, word string")
    found = [(d, i, s, e) for d, ws in texts.items() for i, w in enumerate(ws) for e, s in (("god", 1), ("hell", 2)) if w == e]
    matches = spark.createDataFrame(found, "doc_id long, word_index int, span int, entry string")
    rules = [("god", "oh  DEAR", 3, None), ("god", "praise", 1, 2), (None, "thank", 0, 1), ("hell", "x x", 2, 0), ("god", "!!", 5, 5), ("god", None, 5, 5), ("god", "x", -1, 0)]

    def excused(d, i, s, e):
        ws = [w.lower().strip(",") for w in texts[d]]
        for entry, near, before, after in rules:
            parts = [p for p in (near or "").lower().replace("!", "").split()]
            if (entry is None or entry == e) and parts:
                for a in range(len(ws) - len(parts) + 1):
                    if ws[a : a + len(parts)] == parts and (1 <= i - (a + len(parts) - 1) <= (before or 0) or 1 <= a - (i + s - 1) <= (after or 0)):
                        return True
        return False

    df = spark.createDataFrame(rules, "entry string, near string, before int, after int")
    got = sorted(map(tuple, extras.term_context(matches, words, df).collect()))
    assert got == sorted(m for m in found if not excused(*m)) and 0 < len(got) < len(found)
    assert extras.term_context(matches, words, df.limit(0)).count() == len(found)
    assert extras.term_context(matches.limit(0), words, df).columns == matches.columns


def test_styles_of_words(spark):
    words = spark.createDataFrame([(1, 0, '"Heck,"'), (1, 1, "darn!"), (1, 2, "it"), (1, 3, "Éa"), (1, 4, "--"), (2, 0, "ok")], "doc_id long, word_index int, word string")
    m = spark.createDataFrame([(1, 0, 1, "heck", 1), (1, 1, 2, "darn it", 2), (1, 3, 1, "éa", 3), (1, 4, 1, "odd", 4)], "doc_id long, word_index int, span int, entry string, line_no int")
    looks = spark.createDataFrame([("heck", "first", None), ("darn it", "word", "oh"), ("éa", "stars", None), ("odd", "none", None)], "entry string, style string, substitute string")
    got = dict(map(tuple, extras.styled_text(words, m, looks).collect()))
    assert got[1].split(" ")[:4] == ['"H***,"', "oh!", "oh", "**"] and got[2] == "ok"
    plain = dict(map(tuple, extras.styled_text(words, m, looks.limit(0), "stars").collect()))
    assert plain[1].startswith('"****," ****! ** **')
    with pytest.raises(ValueError, match="unknown style"):
        extras.styled_text(words, m, looks, "loud")


def test_sketch_query_is_near_the_exact_counts(spark, sf_dir):
    from veilstone.plans import fixtures as fx

    got = {r.source: r.docs for r in QUERIES["run_sketches"](spark, sf_dir).filter("level = 'source'").collect()}
    about = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    want = {r.source: r.n for r in fx.matches(spark, sf_dir).join(about, "doc_id").groupBy("source").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - n) <= max(1, 0.06 * n) for s, n in want.items())


@pytest.mark.parametrize("name", ["run_stats", "analysis_report", "job_documents", "term_context", "styled_text"])
def test_report_queries_match_sql(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)
