"""Series operators on time-indexed samples: mute, mix, split, join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from .intervals import interval_cover

METHODS = ("mute",)


def method_guard(method: Column, has_intervals: Column) -> Column:
    """The method, an error for an unknown one, and only where there is an interval to apply it to."""
    bad = has_intervals & ~method.isin(*METHODS)
    return F.when(bad, F.raise_error(F.concat(F.lit("unknown censor method: "), method)).cast("string")).otherwise(method)


def mute_series(samples: DataFrame, merged: DataFrame, key: str = "track_id", method: str = "mute") -> DataFrame:
    """Samples with value 0 where their time lies in an interval, its bounds at 4 decimals. Intervals that
    touch after the rounding count as one: every sample comes back once."""
    if method not in METHODS:
        raise ValueError(f"unknown censor method: {method}")
    rounded = merged.withColumns({c: F.round(c, 4) for c in ("interval_start", "interval_end")})
    covered = interval_cover(samples, rounded, key)
    return covered.withColumn("value", F.when(F.col("covered"), F.lit(0.0)).otherwise(F.col("value"))).drop("covered")


def mix_join(a: DataFrame, b: DataFrame, keys: list[str], other: str = "other") -> DataFrame:
    """Samples of ``a``, each with the ``value`` that ``b`` has at its ``keys``, as ``other``: null where ``b``
    is shorter. Samples that only ``b`` has are left out, so the first sets the length."""
    return a.join(b.select(*keys, F.col("value").alias(other)), keys, "left")


def mix_series(a: DataFrame, b: DataFrame, keys: list[str], low: int = -32768, high: int = 32767) -> DataFrame:
    """Sum of two integer series aligned on ``keys``, as long as the first, clamped to 16 bits."""
    other = fresh("__other", a)
    total = F.col("value") + F.coalesce(other, F.lit(0))
    return mix_join(a, b, keys, other).withColumn("value", F.greatest(F.lit(low), F.least(F.lit(high), total))).drop(other)


def split_series(samples: DataFrame, size: int) -> DataFrame:
    """Samples (track_id, idx, value) as segments of ``size``: segment and the place in it."""
    at = F.col("idx") % size
    return samples.withColumn("segment", ((F.col("idx") - at) / size).cast("long")).withColumn("pos", at).drop("idx")


def concat_series(parts: DataFrame) -> DataFrame:
    """Segments (track_id, segment, pos, value) appended in order. Lengths are summed per segment first,
    so the window runs over segments and not over samples."""
    sizes = parts.groupBy("track_id", "segment").agg((F.max("pos") + 1).alias("n"))
    before = Window.partitionBy("track_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("track_id", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return parts.join(base, ["track_id", "segment"]).withColumn("idx", F.col("base") + F.col("pos")).drop("base", "pos", "segment")
