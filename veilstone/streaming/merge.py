"""Merged intervals of words that arrive in any order within a bound: event time, watermark, late rows.

Session windows of the engine drop late rows unseen, and hold times in microseconds. Here the open intervals
are a table of state instead, which the batch operator folds with each batch's rows, so that the result equals
the batch result to the last bit and late rows are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals

SPANS = "doc_id long, padded_start double, padded_end double"
MERGED = "doc_id long, interval_start double, interval_end double"
CLOCK = "number long, latest double, watermark double"


def stream_spans(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Files of padded intervals of a folder as a stream."""
    return spark.readStream.schema(SPANS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _clock(spark: SparkSession, out: str, slot: int) -> tuple[float | None, float | None]:
    """Latest start seen and the watermark after the batch in ``slot``: one row."""
    row = spark.read.schema(CLOCK).parquet(f"{out}/clock/slot={slot}").first()
    return row["latest"], row["watermark"]


def interval_stream(stream: DataFrame, out: str, checkpoint: str, lateness_sec: float) -> None:
    """Merges the intervals (doc_id, padded_start, padded_end in seconds of one clock) of all files that are
    there now, as ``merge_intervals`` does.

    After each batch the watermark is the largest start seen less ``lateness_sec``. Rows of later batches that
    start before it are late: they go to ``out``/late and change nothing. Intervals that end before it can't
    grow any more and go to ``out``/closed; the others stay as state. Rows without a bound, or that end before
    they start, are left out and don't move the clock; NaN counts as no bound.

    A batch writes folders named by its number and one of two slots of state, and reads the other, so a
    repeated batch replaces itself; a restart goes on from the checkpoint, which belongs to ``out``. State is
    the intervals that are still open, spread over the tasks of a shuffle; one row is the clock."""

    def write(batch: DataFrame, number: int) -> None:
        spark, slot, other = batch.sparkSession, number % 2, (number - 1) % 2
        fine = "padded_end >= padded_start and not isnan(padded_start) and not isnan(padded_end)"
        batch.filter(fine).select("doc_id", "padded_start", "padded_end").write.mode("overwrite").parquet(f"{out}/rows")
        rows = spark.read.schema(SPANS).parquet(f"{out}/rows")
        latest, mark = _clock(spark, out, other) if number else (None, None)
        on_time = rows
        if mark is not None:
            rows.filter(F.col("padded_start") < mark).write.mode("overwrite").parquet(f"{out}/late/batch={number}")
            before = spark.read.schema(MERGED).parquet(f"{out}/merged/slot={other}").filter(F.col("interval_end") >= mark)
            on_time = rows.filter(F.col("padded_start") >= mark).unionByName(before.toDF("doc_id", "padded_start", "padded_end"))
        merge_intervals(on_time).write.mode("overwrite").parquet(f"{out}/merged/slot={slot}")
        newest = rows.agg(F.max("padded_start").alias("m")).first()["m"]
        latest = max((x for x in (latest, newest) if x is not None), default=None)
        mark = None if latest is None else latest - lateness_sec
        if mark is not None:
            done = spark.read.schema(MERGED).parquet(f"{out}/merged/slot={slot}").filter(F.col("interval_end") < mark)
            done.write.mode("overwrite").parquet(f"{out}/closed/batch={number}")
        spark.createDataFrame([(number, latest, mark)], CLOCK).coalesce(1).write.mode("overwrite").parquet(f"{out}/clock/slot={slot}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came too late, with the batch that brought them. At least two batches must have been read."""
    return spark.read.schema(f"{SPANS}, batch long").parquet(f"{out}/late")


def merged_so_far(spark: SparkSession, out: str) -> DataFrame:
    """All intervals that the stream has merged, with ``closed``: no row that is on time can change it."""
    now = spark.read.schema(f"{CLOCK}, slot int").parquet(f"{out}/clock").orderBy(F.desc("number")).first()
    held = spark.read.schema(MERGED).parquet(f"{out}/merged/slot={now['slot']}")
    if now["watermark"] is None:
        return held.withColumn("closed", F.lit(False))
    closed = spark.read.schema(f"{MERGED}, batch long").parquet(f"{out}/closed").drop("batch")
    return closed.withColumn("closed", F.lit(True)).unionByName(held.filter(F.col("interval_end") >= now["watermark"]).withColumn("closed", F.lit(False)))
