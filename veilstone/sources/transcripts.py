"""Word tables from transcripts and from plain texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..operators.scans import running

WORD = "struct<word:string,start:double,end:double,score:double>"
TRANSCRIPT = f"language string, segment_index int, segment_start_offset double, words array<{WORD}>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Segment transcripts, a JSON document per file; the file name comes along as ``file``."""
    return spark.read.schema(TRANSCRIPT).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def words_from_segments(segments: DataFrame) -> DataFrame:
    """Words of segment transcripts in place order (``pos``), empty words dropped; ``segments`` has
    doc_id besides the transcript's columns."""
    opened = segments.select("doc_id", "segment_index", "segment_start_offset", "language", F.posexplode("words").alias("pos", "w"))
    return opened.select("doc_id", "segment_index", "segment_start_offset", "language", "pos", "w.*").filter(F.coalesce("word", F.lit("")) != "")


def words_from_text(docs: DataFrame) -> DataFrame:
    """Words of texts with synthetic times and scores: a word starts each half second; every 37th is not
    aligned, every 11th has no score."""
    i = F.col("word_index")
    timed = i % 37 != 36
    return docs.select("doc_id", F.posexplode(split_words(F.col("text"))).alias("word_index", "word")).select(
        "doc_id", "word_index", "word",
        F.when(timed, i * 0.5).alias("start"), F.when(timed, i * 0.5 + 0.375).alias("end"),
        F.when(i % 11 != 10, (i % 64) / 64.0).alias("score"),
    )


def rebase_merge(words: DataFrame) -> DataFrame:
    """Segment words on one clock: times plus the segment's offset, rounded to 4 places, nulls kept;
    numbered densely in segment order. Words are numbered inside their segment, and the counts of a
    document's segments are summed in a window of their own, so a task holds a segment's words and not a
    document's. ``words`` is read twice."""
    shift = F.coalesce("segment_start_offset", F.lit(0.0))
    placed = running(words, "doc_id", [F.col("pos")], "segment_index", -1, word_index=(F.lit(1), "sum"))
    return placed.select(
        "doc_id", F.col("word_index").cast("int").alias("word_index"), "word",
        F.round(F.col("start") + shift, 4).alias("start"), F.round(F.col("end") + shift, 4).alias("end"), "score",
    )


def doc_language(segments: DataFrame) -> DataFrame:
    """Language of a document's last segment that names one; ``en`` without any."""
    named = F.when(F.coalesce("language", F.lit("")) != "", F.col("segment_index"))
    return segments.groupBy("doc_id").agg(F.coalesce(F.max_by("language", named), F.lit("en")).alias("language"))
