"""As-of joins and merged intervals of a stream, against plain Python and the batch operator."""

import random
import uuid

import pytest

from veilstone.operators import asof, intervals
from veilstone.plans import interval_queries, job_queries  # noqa: F401
from veilstone.plans.registry import ORACLES, QUERIES
from veilstone.sources import sinks
from veilstone.streaming.merge import SPANS, interval_stream, late_rows, merged_so_far, stream_spans

from .duck import assert_same


@pytest.mark.parametrize("block", [None, 3.0, 50.0])
def test_asof_matches_plain_python(spark, block):
    r = random.Random(4)
    keys = ["a", "b", "c", None]
    rows = [(r.choice(keys[:2] + [None]), r.choice([None, *[x / 4 for x in range(0, 400)]]), i % 37, f"w{i}") for i in range(300)]
    points = [(i, r.choice(keys), r.choice([None, *[x / 8 - 1 for x in range(0, 900)]]), "mine") for i in range(400)]

    def last(key, t):
        held = [(x[1], x[2], x[3]) for x in rows if key is not None and t is not None and x[0] == key and x[1] is not None and x[1] <= t]
        return max(held)[1:] if held else (None, None)

    left = sinks.saved(spark.createDataFrame(points, "n int, k string, t double, __held string"), "points")
    right = sinks.saved(spark.createDataFrame(rows, "k string, at double, n int, w string"), "rows")
    got = asof.asof(left, right, "k", "t", "at", {"order": "n", "w": "w"}, "n", block)
    assert got.columns == ["n", "k", "t", "__held", "order", "w"]
    assert sorted(map(tuple, got.collect())) == [(*p, *last(p[1], p[2])) for p in points]
    assert asof.asof(left, right.limit(0), "k", "t", "at", {"w": "w"}, None, block).filter("w is null").count() == 400
    assert asof.asof(left.limit(0), right, "k", "t", "at", {"w": "w"}, None, block).count() == 0


def test_adds_name_the_word_they_fall_on(spark):
    words = spark.createDataFrame([(1, 0, "one", 1.0, 1.5), (1, 1, "two", 2.0, 2.5), (1, 2, "three", 2.0, 3.0)], "doc_id long, word_index int, word string, start double, end double")
    adds = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 1.5), (1, 2.75), (1, 9.0), (2, 1.0), (1, None)], "doc_id long, start double")
    got = [(r.doc_id, r.start, r.on_index, r.on_word, r.sounding) for r in asof.adds_on_words(adds, words).collect()]
    want = [(1, 0.5, None, None, False), (1, 1.0, 0, "one", True), (1, 1.5, 0, "one", False), (1, 2.75, 2, "three", True), (1, 9.0, 2, "three", False), (2, 1.0, None, None, False), (1, None, None, None, False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SPANS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, lateness):
    interval_stream(stream_spans(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/state", lateness)


def test_stream_on_time_equals_batch_and_late_rows_are_kept(spark):
    r = random.Random(8)
    rows = [(r.randrange(4), s, s + r.choice([0.0, 0.25, 2.0, 30.0])) for s in (x / 8 for x in range(0, 4000, 5))]
    rows = [rows[i + j] for i in range(0, 800, 100) for j in r.sample(range(100), 100)]  # in disorder within 62.5 s
    folder = f"{sinks.shared_dir(spark)}/ev-{uuid.uuid4().hex}"
    for i in range(0, 400, 100):
        feed(spark, folder, rows[i : i + 100])
    run(spark, folder, 70.0)  # and goes on from its checkpoint after the restart below
    first = merged_so_far(spark, f"{folder}/out")
    whole = lambda part: sorted(map(tuple, intervals.merge_intervals(spark.createDataFrame(part, SPANS)).collect()))
    assert sorted(map(tuple, first.drop("closed").collect())) == whole(rows[:400])
    frozen = {tuple(x)[:3] for x in first.collect() if x.closed}
    for i in range(400, 800, 100):
        feed(spark, folder, rows[i : i + 100])
    run(spark, folder, 70.0)
    assert late_rows(spark, f"{folder}/out").count() == 0
    late = [(1, 3.0, 900.0), (2, 429.0, 429.5), (7, 100.0, 101.0)]  # the watermark is 499.375 - 70
    fine = [(1, 430.0, 431.0), (9, 498.0, 499.0), (3, None, 4.0), (3, 4.0, 3.0), (3, 600.0, None)]
    feed(spark, folder, late + fine)
    run(spark, folder, 70.0)
    got = merged_so_far(spark, f"{folder}/out").collect()
    assert sorted(tuple(x)[:3] for x in got) == whole(rows + fine[:2]) and len(got) > 40
    assert frozen and frozen <= {tuple(x)[:3] for x in got if x.closed}
    assert sorted(tuple(x)[:3] for x in late_rows(spark, f"{folder}/out").collect()) == late
    assert {x.batch for x in late_rows(spark, f"{folder}/out").collect()} == {8}


def test_a_repeated_batch_replaces_itself(spark):
    """The state is read from the other slot, so a second run of one batch finds what the first one found."""
    folder = f"{sinks.shared_dir(spark)}/ev-{uuid.uuid4().hex}"
    parts = [[(1, 0.0, 1.0), (1, 5.0, 6.0)], [(1, 6.0, 7.0), (1, 2.0, 2.5)], [(1, 9.0, 9.5), (1, 1.0, 8.0)]]

    class Stream:  # hands the writer of a stream its batches, the last one twice
        writeStream = property(lambda s: s)
        option = trigger = lambda s, *a, **k: s
        start = awaitTermination = lambda s: s

        def foreachBatch(s, write):
            for number in (0, 1, 2, 2):
                write(spark.createDataFrame(parts[number], SPANS), number)
            return s

    interval_stream(Stream(), f"{folder}/out", "", 4.0)
    got = sorted(tuple(x) for x in merged_so_far(spark, f"{folder}/out").collect())
    assert got == [(1, 0.0, 1.0, True), (1, 2.0, 2.5, True), (1, 5.0, 7.0, False), (1, 9.0, 9.5, False)]
    assert [tuple(x) for x in late_rows(spark, f"{folder}/out").collect()] == [(1, 1.0, 8.0, 2)]


@pytest.mark.parametrize("name", ["adds_on_words", "asof_events", "stream_intervals"])
def test_queries_match_sql(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)
