"""Numbered logs and bucketed tables: two writers, rewriting of touched buckets only, old versions."""

import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from veilstone.operators import overrides
from veilstone.plans import interval_queries  # noqa: F401
from veilstone.plans.registry import ORACLES, QUERIES
from veilstone.sources import keyed, sinks, versions

from .duck import assert_same


@pytest.fixture
def folder(spark):
    return f"{sinks.shared_dir(spark)}/kept-{uuid.uuid4().hex}"


def table(spark, ids, text="old"):
    return spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")


def held(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("link", [True, False])
def test_a_number_is_taken_once(spark, folder, link):
    name = f"{folder}/log/00000001.json"
    assert versions.put_if_absent(spark, name, "first", link)
    assert not versions.put_if_absent(spark, name, "second", link)
    assert versions.read_text(spark, name) == "first"
    assert versions.numbers(spark, f"{folder}/log") == [1]
    assert not [n for n in os.listdir(f"{folder}/log") if n.startswith(".") and not n.endswith(".crc")]


def test_writers_at_once_all_get_numbers_of_their_own(spark, folder):
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append((versions.append(spark, folder, {"writer": i}), i))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(n for n, _ in got) == list(range(1, 9))
    assert all(versions.entry(spark, folder, n) == {"writer": i} for n, i in got)


def test_a_change_rewrites_only_its_buckets(spark, folder):
    keyed.create(table(spark, range(200)), folder, buckets=16)
    before = versions.entry(spark, f"{folder}/log", 1)["files"]
    asked = spark.createDataFrame([(7,)], "doc_id int")  # another type than the table's
    assert keyed.replace(spark, folder, asked, table(spark, [7, 8], "new")) == 2
    after = versions.entry(spark, f"{folder}/log", 2)["files"]
    assert len([b for b in before if before[b] != after[b]]) == 1
    assert held(keyed.read(spark, folder)) == held(table(spark, [i for i in range(200) if i != 7]).union(table(spark, [7], "new")))
    assert held(keyed.read(spark, folder, version=1)) == held(table(spark, range(200)))
    part = keyed.read(spark, folder, keys=asked)
    assert held(part) == [(7, "new")] and len(part.inputFiles()) < 16
    assert [(n, k) for n, k, _ in keyed.history(spark, folder)] == [(1, len(before)), (2, 1)]
    assert keyed.rewrite(spark, folder, asked.limit(0), lambda old: old) == 2  # no keys, no version
    with pytest.raises(versions.Conflict):
        keyed.create(table(spark, [1]), folder)


def buckets_of(spark, folder):
    number, manifest = keyed._manifest(spark, folder, None)
    return lambda i: keyed._touched(spark.createDataFrame([(i,)], "doc_id long"), manifest)[0]


@pytest.mark.parametrize("same", [False, True])
def test_two_writers_at_once_lose_no_change(spark, folder, same):
    keyed.create(table(spark, range(40)), folder, buckets=8)
    bucket = buckets_of(spark, folder)
    other = next(i for i in range(1, 40) if (bucket(i) == bucket(0)) == same)
    calls = []

    def slow(old):
        calls.append(old)
        if len(calls) == 1:  # the other writer comes first
            keyed.replace(spark, folder, table(spark, [other]), table(spark, [other], "theirs"))
        return old.withColumn("text", F.when(F.col("doc_id") == 0, "ours").otherwise(F.col("text")))

    assert keyed.rewrite(spark, folder, table(spark, [0]), slow) == 3
    assert len(calls) == (2 if same else 1)  # only a change of the same bucket makes it read again
    got = dict(held(keyed.read(spark, folder)))
    assert (got[0], got[other], len(got)) == ("ours", "theirs", 40)


def test_a_writer_that_always_loses_says_so_and_changes_nothing(spark, folder):
    keyed.create(table(spark, range(10)), folder, buckets=1)

    def beaten(old):
        keyed.replace(spark, folder, table(spark, [1]), table(spark, [1], uuid.uuid4().hex))
        return old.withColumn("text", F.lit("lost"))

    with pytest.raises(versions.Conflict):
        keyed.rewrite(spark, folder, table(spark, [0]), beaten, tries=2)
    assert keyed.read(spark, folder).filter("text = 'lost'").count() == 0


def test_nulls_empty_tables_and_clashing_names(spark, folder):
    rows = spark.createDataFrame([(None, "x"), (1, None), (1, None)], "doc_id long, bucket string")
    keyed.create(rows, folder, buckets=4)
    assert held(keyed.read(spark, folder)) == held(rows)
    keyed.replace(spark, folder, rows.filter("doc_id = 1"), rows.limit(0))
    assert held(keyed.read(spark, folder)) == [(None, "x")]
    keyed.rewrite(spark, folder, rows.filter("doc_id is null"), lambda old: old.limit(0))
    assert keyed.read(spark, folder).count() == 0 and keyed.read(spark, folder).columns == ["doc_id", "bucket"]
    with pytest.raises(ValueError, match="buckets"):
        keyed.rewrite(spark, folder, rows.filter("doc_id is null"), lambda old: spark.createDataFrame([(i, "y") for i in range(50)], old.schema))
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, folder + "-none")


def test_vacuum_keeps_what_kept_versions_and_young_writes_need(spark, folder):
    keyed.create(table(spark, range(50)), folder, buckets=4)
    for i in range(3):
        keyed.replace(spark, folder, table(spark, [i]), table(spark, [i], f"v{i}"))
    want = held(keyed.read(spark, folder))
    assert keyed.vacuum(spark, folder, keep=1) == 0  # all are young
    assert [n for n, *_ in keyed.history(spark, folder)] == [4]
    keyed.vacuum(spark, folder, keep=1, hours=-1)
    assert held(keyed.read(spark, folder)) == want
    assert keyed.replace(spark, folder, table(spark, [9]), table(spark, [9], "on")) == 5


def test_a_request_given_twice_at_once_is_applied_once(spark, folder):
    cols = "doc_id long, seq int, action string, word_index int, text string, start double, end double"
    keyed.create(spark.createDataFrame([(1, 4, "skip", 2, None, None, None)], cols), folder, buckets=2)
    skips = spark.createDataFrame([(1, 9, 0, "a"), (1, 9, 1, "a"), (1, 2, 2, "b")], "doc_id long, word_index int, req int, text string")
    adds = spark.createDataFrame([], "doc_id long, req int, text string, start_raw string, end_raw string")
    for _ in range(2):
        overrides.correct_table(spark, folder, skips, adds)
    assert [(r.seq, r.word_index) for r in keyed.read(spark, folder).orderBy("seq").collect()] == [(4, 2), (5, 9)]


def test_current_is_the_last_number(spark, folder):
    for text in ("a", "b"):
        sinks.publish(table(spark, [1], text), folder)
    assert held(sinks.current(spark, folder)) == [(1, "b")]
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, folder + "-none")


@pytest.mark.parametrize("name", ["correct_table", "redo_table", "rematch_documents", "matches_sink", "censor_log_sink"])
def test_kept_table_queries_match_sql(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", ["apply_corrections", "correct_table"])
def test_corrections_of_documents_in_several_partitions(name, spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    docs.repartition(3, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    skips, _ = interval_queries.requests(spark, str(tmp_path))
    assert skips.rdd.getNumPartitions() > 1 and all(r.req == r.word_index for r in skips.collect())
    got = QUERIES[name](spark, str(tmp_path)).filter("action = 'skip' and word_index = 5000").collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(60) if i % 3 == 0 and i % 5]
