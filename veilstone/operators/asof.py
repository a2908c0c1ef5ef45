"""As-of joins: the last row at or before a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from .scans import running


def _seconds(df: DataFrame, time: str) -> Column:
    """Seconds that never fall as the time rises; timestamps without a zone are taken apart, since no zone's
    clock may jump between them."""
    t = F.col(time)
    if df.schema[time].dataType.typeName() == "timestamp_ntz":
        return F.unix_date(F.to_date(t)) * 86400.0 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return t.cast("double")


def asof(points: DataFrame, rows: DataFrame, key: str, t: str, at: str, take: dict[str, str], tie: str | None = None, block_sec: float | None = None) -> DataFrame:
    """``points`` with columns of the last of ``rows`` of the same key whose ``at`` is not after ``t``:
    ``take`` maps new names to columns of ``rows``. Among rows of one time the largest ``tie`` wins, then the
    largest of the columns taken. Every point comes back once; those without a key, a time or an earlier row
    have nulls. Rows without a key or a time are never found.

    Both tables go through one shuffle as a union, and a running maximum carries the last row along, so the
    cost doesn't depend on how many rows lie before a point. For keys with more rows than one task should
    sort, ``block_sec`` cuts the time line into blocks of so many seconds (``scans.running``); both tables
    are then read several times, so give written ones."""
    time, side, held, point, last, block = (fresh(c, points, rows) for c in ("__t", "__side", "__held", "__point", "__last", "__block"))
    name = fresh("__key", points, rows)
    order = [F.col(at).alias("at"), *([F.col(tie).alias("tie")] if tie else [])]
    row = F.struct(*order, *[F.col(c).alias(f"v{i}") for i, c in enumerate(take.values())])
    known = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    left = points.select(F.col(key).alias(name), F.col(t).alias(time), F.lit(1).alias(side), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias(point))
    right = known.select(F.col(key).alias(name), F.col(at).alias(time), F.lit(0).alias(side), row.alias(held))
    both = left.unionByName(right, allowMissingColumns=True)
    if block_sec:
        both = both.withColumn(block, F.floor(_seconds(both, time) / block_sec))
    found = running(both, name, [F.col(time), F.col(side)], block if block_sec else None, **{last: (F.col(held), "max")}).filter(F.col(side) == 1)
    new = [F.col(f"{last}.v{i}").alias(c) for i, c in enumerate(take)]
    return found.select(*[F.col(f"{point}.`{c}`").alias(c) for c in points.columns if c not in take], *new)


def adds_on_words(adds: DataFrame, words: DataFrame, block_sec: float | None = None) -> DataFrame:
    """``adds`` (doc_id, start) with the word they fall on: ``on_index`` and ``on_word`` of the last word that
    begins at or before them, and ``sounding``, whether it hasn't ended yet."""
    ends = fresh("__ends", adds)
    found = asof(adds, words, "doc_id", "start", "start", {"on_index": "word_index", "on_word": "word", ends: "end"}, "word_index", block_sec)
    return found.withColumn("sounding", F.coalesce(F.col("start") < F.col(ends), F.lit(False))).drop(ends)
