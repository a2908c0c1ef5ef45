"""Sparse corrections (skip, add) over immutable matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import parse_timestamp
from ..sources import keyed


def skip_antijoin(matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """Matches whose word has no skip; a skip removes every match at its word."""
    skips = overrides.filter("action = 'skip'").select("doc_id", "word_index")
    return matches.join(skips, ["doc_id", "word_index"], "left_anti")


def correction_text(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """Skip requests (doc_id, word_index) with the text of the last match at that word, null without."""
    last = matches.groupBy("doc_id", "word_index").agg(F.max_by("matched_text", F.struct(F.col("span") > 1, "line_no")).alias("text"))
    return requests.join(last, ["doc_id", "word_index"], "left")


def validate_corrections(adds: DataFrame) -> DataFrame:
    """Add requests (doc_id, text, start_raw, end_raw) with parsed start and end and a ``problem``: start,
    end, order, or null."""
    timed = adds.withColumns({"start": parse_timestamp(F.col("start_raw")), "end": parse_timestamp(F.col("end_raw"))})
    problem = F.when(F.col("start").isNull(), "start").when(F.col("end").isNull(), "end").when(F.col("end") <= F.col("start"), "order")
    return timed.withColumn("problem", problem)


def apply_corrections(existing: DataFrame, skips: DataFrame, adds: DataFrame) -> DataFrame:
    """Overrides (doc_id, seq, action, word_index, text, start, end) after a request per document: new
    skips once each, also inside the request, then all new adds; seq goes on. A document with a faulty
    add gets nothing of its request."""
    checked = validate_corrections(adds)
    faulty = checked.filter("problem is not null").select("doc_id").distinct()
    known = existing.filter("action = 'skip'").select("doc_id", "word_index")
    first = Window.partitionBy("doc_id", "word_index").orderBy("req")
    new_skips = skips.withColumn("__n", F.row_number().over(first)).filter("__n = 1").join(known, ["doc_id", "word_index"], "left_anti")
    none = F.lit(None)
    new = new_skips.select("doc_id", F.lit(0).alias("__k"), "req", F.lit("skip").alias("action"), "word_index", "text", none.cast("double").alias("start"), none.cast("double").alias("end")).unionByName(
        checked.select("doc_id", F.lit(1).alias("__k"), "req", F.lit("add").alias("action"), none.cast("int").alias("word_index"), "text", "start", "end")
    )
    new = new.join(faulty, "doc_id", "left_anti")
    last = existing.groupBy("doc_id").agg(F.max("seq").alias("__last"))
    order = Window.partitionBy("doc_id").orderBy("__k", "req")
    new = new.join(last, "doc_id", "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.row_number().over(order)).cast("int"))
    return existing.unionByName(new.select(*existing.columns))


def redo_review(existing: DataFrame, replacement: DataFrame, redone: DataFrame) -> DataFrame:
    """All overrides of the ``redone`` documents replaced, also by nothing."""
    return existing.join(redone.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(replacement.select(*existing.columns).join(redone.select("doc_id").distinct(), "doc_id", "left_semi"))


def correct_table(spark: SparkSession, folder: str, skips: DataFrame, adds: DataFrame) -> int:
    """A request applied to the overrides kept in ``folder`` (``sources.keyed``); only the buckets of its
    documents are read and written. Returns the new version."""
    asked = skips.select("doc_id").unionByName(adds.select("doc_id"))
    return keyed.rewrite(spark, folder, asked, lambda old: apply_corrections(old, skips, adds))


def redo_table(spark: SparkSession, folder: str, replacement: DataFrame, redone: DataFrame) -> int:
    """All kept overrides of the ``redone`` documents replaced, also by nothing."""
    return keyed.replace(spark, folder, redone, replacement)
