"""Interval algebra: padding, merging, tiling and covering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import fmt_timestamp
from ..functions.names import fresh
from .scans import running


def segment_assign(tracks: DataFrame, size: int) -> DataFrame:
    """Fixed tiles of ``tracks`` (track_id, total_duration_sec): index from 0, start_sec, end_sec. Size 0
    or a short track gives one tile."""
    size = int(size)
    total = F.col("total_duration_sec")
    n = F.lit(1) if size == 0 else F.greatest(F.lit(1), F.ceil(total / size).cast("int"))
    tiles = tracks.withColumn("index", F.explode(F.sequence(F.lit(0), n - 1)))
    return tiles.withColumn("start_sec", F.col("index") * float(size)).withColumn("end_sec", F.least(F.col("start_sec") + size, total) if size else total)


def tile_of(t: Column, total: Column, size: int) -> Column:
    """Tile that a time lies in: the last one takes what is beyond."""
    if int(size) == 0:
        return F.lit(0)
    last = F.greatest(F.lit(1), F.ceil(total / int(size)).cast("int")) - 1
    return F.least(F.floor(t / int(size)).cast("int"), last)


def segment_durations(segments: DataFrame) -> DataFrame:
    """``segments`` (track_id, index, start_sec, total_duration_sec) with ``duration_sec``: up to the next
    start, the last up to the total."""
    order = Window.partitionBy("track_id").orderBy("index")
    return segments.withColumn("duration_sec", F.coalesce(F.lead("start_sec").over(order), F.col("total_duration_sec")) - F.col("start_sec"))


def resolve_intervals(matches: DataFrame, overrides: DataFrame, padding_ms: float) -> DataFrame:
    """The censor log before order: matches without a skip on their word, and the adds, padded. ``ord``
    is the place in the input: matches by word, span and line, adds by seq."""
    pad = padding_ms / 1000.0
    skips = overrides.filter("action = 'skip'").select("doc_id", "word_index").distinct()
    kept = matches.join(skips, ["doc_id", "word_index"], "left_anti").select(
        "doc_id", F.lit("matched").alias("source"), F.col("matched_text").alias("word"), "entry", "word_index", "start", "end", "score",
        F.struct(F.lit(0).alias("rank"), F.col("word_index").cast("long").alias("a"), (F.col("span") > 1).alias("b"), F.col("line_no").cast("long").alias("c")).alias("ord"),
    )
    adds = overrides.filter("action = 'add'").select(
        "doc_id", F.lit("review_add").alias("source"), F.col("text").alias("word"), F.lit(None).cast("string").alias("entry"), "word_index", "start", "end", F.lit(None).cast("double").alias("score"),
        F.struct(F.lit(1).alias("rank"), F.col("seq").cast("long").alias("a"), F.lit(False).alias("b"), F.lit(0).cast("long").alias("c")).alias("ord"),
    )
    both = kept.unionByName(adds)
    return both.withColumns({"padded_start": F.greatest(F.lit(0.0), F.col("start") - pad), "padded_end": F.col("end") + pad})


def censor_log(resolved: DataFrame) -> DataFrame:
    """Log rows: times to 4 places with clock texts, and ``seq``, their order inside the document."""
    order = Window.partitionBy("doc_id").orderBy(F.round("padded_start", 4), "ord")
    out = resolved.withColumn("seq", F.row_number().over(order))
    for c in ("start", "end", "padded_start", "padded_end"):
        out = out.withColumn(f"{c}_hms", fmt_timestamp(F.col(c)))
    return out.withColumns({c: F.round(c, 4) for c in ("start", "end", "padded_start", "padded_end")}).drop("ord")


def merge_intervals(intervals: DataFrame, key: str = "doc_id", block_sec: float | None = None) -> DataFrame:
    """Merge overlapping or touching intervals (padded_start, padded_end) of each key. Order is by the
    start rounded to 4 places, and an island keeps the start of its first row in that order. Rows that
    end before they start, or lack an end, are left out.

    An island is named by its first row, the latest so far that no earlier interval reaches. Without
    ``block_sec`` both scans are windows over a key and share its shuffle. For keys with more rows than one
    task should sort, ``block_sec`` cuts the time line into blocks of so many seconds, which are scanned in
    parallel (``scans.running``); the rows are then read several times, so give a written table."""
    held = [key, "padded_start", "padded_end", *(["ord"] if "ord" in intervals.columns else [])]
    rows = intervals.filter("padded_end >= padded_start").select(*held)
    by = [F.round("padded_start", 4), *([F.col("ord")] if "ord" in held else [F.col("padded_start"), F.col("padded_end")])]
    reach, first, block = (fresh(c, rows) for c in ("__reach", "__first", "__block"))
    if block_sec:
        rows = rows.withColumn(block, F.floor(by[0] / block_sec))
    cut = block if block_sec else None
    rows = running(rows, key, by, cut, -1, **{reach: (F.col("padded_end"), "max")})
    free = F.when(F.coalesce(F.col("padded_start") > F.col(reach), F.lit(True)), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)], "padded_start"))
    rows = running(rows, key, by, cut, 0, **{first: (free, "max")})
    merged = rows.groupBy(key, first).agg(F.max("padded_end").alias("interval_end"))
    return merged.select(key, F.col(f"{first}.padded_start").alias("interval_start"), "interval_end")


def interval_cover(points: DataFrame, intervals: DataFrame, key: str, t: str = "t", width: float = 600.0) -> DataFrame:
    """``points`` with ``covered``: the time lies in an interval of its key, both ends included.

    A range join by buckets of ``width`` seconds. The intervals are merged here, so that they are disjoint
    and not even touch: a point has one hit at most, and every point comes back once. Points without a time
    or key aren't covered; intervals without a bound cover nothing."""
    spans = intervals.select(F.col(key).alias("k"), F.col("interval_start").alias("padded_start"), F.col("interval_end").alias("padded_end"))
    bucket, covered = fresh("__bucket", points), "covered"
    steps = F.sequence(F.floor(F.col("interval_start") / width), F.floor(F.col("interval_end") / width))
    opened = merge_intervals(spans, "k").withColumn("b", F.explode(steps)).alias("i")
    p = points.drop(covered).withColumn(bucket, F.floor(F.col(t) / width)).alias("p")
    hit = (F.col(f"p.{key}") == F.col("i.k")) & (F.col(f"p.{bucket}") == F.col("i.b")) & F.col(f"p.{t}").between(F.col("i.interval_start"), F.col("i.interval_end"))
    return p.join(opened, hit, "left").select("p.*", F.col("i.k").isNotNull().alias(covered)).drop(bucket)


def mute_expr(merged: DataFrame) -> DataFrame:
    """Per document ``between(t,s,e)+...`` over its merged intervals, in order, 4 decimals."""
    spans = F.sort_array(F.collect_list(F.struct("interval_start", "interval_end")))
    text = F.transform(spans, lambda x: F.format_string("between(t,%.4f,%.4f)", x["interval_start"], x["interval_end"]))
    return merged.groupBy("doc_id").agg(F.array_join(text, "+").alias("mute_expr"))
