"""Duration and content checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration_problem(actual: Column, expected: Column, tolerance: Column) -> Column:
    """True where the durations differ by more than the tolerance, null without an expected one."""
    return F.when(expected.isNotNull(), F.abs(actual - expected) > tolerance)


def chapter_overrun(chapters: DataFrame, tracks: DataFrame, slack: float = 2.0) -> DataFrame:
    """Tracks whose last chapter ends more than ``slack`` seconds after them (a warning only)."""
    last = chapters.groupBy("track_id").agg(F.max("chapter_end").alias("last_chapter"))
    joined = tracks.join(last, "track_id", "left")
    return joined.withColumn("overrun", F.coalesce(F.col("last_chapter") > F.col("total_duration_sec") + slack, F.lit(False)))


def content_hash(content: Column) -> Column:
    """SHA-256 as hex; null for unreadable content."""
    return F.sha2(content, 256)


def verify_artifact(recorded: DataFrame, actual: DataFrame, key: str, tolerance: float = 5.0) -> DataFrame:
    """All problems of each recorded artifact: ``missing``, ``duration``, ``hash``. A half without a record is
    skipped, also a recorded duration of 0, and so is the hash of content that can't be read now."""
    a = actual.select(key, F.col("duration").alias("__duration"), F.col("hash").alias("__hash"), F.lit(True).alias("__there"))
    r = recorded.select(key, "duration", "hash").join(a, key, "left")
    gone = F.col("__there").isNull()
    off = F.col("__duration").isNull() | (F.abs(F.col("__duration") - F.col("duration")) > tolerance)
    problems = F.array_compact(
        F.array(
            F.when(gone, F.lit("missing")),
            F.when(~gone & (F.col("duration") != 0) & off, F.lit("duration")),
            F.when(~gone & (F.col("hash") != F.col("__hash")), F.lit("hash")),
        )
    )
    return r.select(key, problems.alias("problems"))
