"""Progress lines and time estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import running

LINE, BAG = r"^\s*(\d+)%\|", r"a bag of (\d+) models"


def progress_fold(lines: DataFrame, models: int | None = None, block: int | None = None) -> DataFrame:
    """State after each bar line of (job_id, seq, line): model_index, last_pct, fraction and label.

    The number of models is the last ``a bag of N models`` seen before a line, 1 until there is one;
    ``models`` overrides it. A 0% line after a seen 100% starts the next model, the last model at most.
    The windows share the key; for a job with more lines than a task should sort, ``block`` cuts them into
    runs of so many ``seq`` that are scanned in parallel."""
    order = [F.col("seq")]
    cut = "block" if block else None
    rows = lines.select("job_id", "seq", "line", *([F.floor(F.col("seq") / block).alias("block")] if block else []))
    bag = F.regexp_extract("line", BAG, 1).try_cast("int")
    rows = running(rows, "job_id", order, cut, bag=(F.when(F.col("line").rlike(BAG) & bag.isNotNull(), F.struct("seq", bag.alias("n"))), "max"))
    said = F.lit(models) if models else F.coalesce(F.col("bag.n"), F.lit(1))
    pct = F.regexp_extract("line", LINE, 1).try_cast("int")
    bars = rows.select("job_id", "seq", *([cut] if cut else []), said.cast("int").alias("n"), pct.alias("pct")).filter("pct is not null")
    # lines between two 0% lines form an island; the next island is a new model if this one saw 100%
    bars = running(bars, "job_id", order, cut, island=(F.when(F.col("pct") == 0, 1).otherwise(0), "sum"))
    bars = running(bars, "job_id", order, cut, -1, full=(F.when(F.col("pct") == 100, F.col("island")), "max"))
    turn = (F.col("pct") == 0) & F.coalesce(F.col("full") == F.col("island") - 1, F.lit(False))
    bars = running(bars, "job_id", order, cut, turns=(F.when(turn, 1).otherwise(0), "sum"))
    state = bars.withColumn("model_index", F.least(F.col("turns"), F.col("n") - 1).cast("int"))
    fraction = F.least(F.lit(1.0), (F.col("model_index") + F.col("pct") / 100.0) / F.col("n"))
    label = F.format_string("%d/%d", F.least(F.col("model_index") + 1, F.col("n")), F.col("n"))
    return state.select("job_id", "seq", "model_index", F.col("pct").alias("last_pct"), fraction.alias("fraction"), label.alias("label"))


def segment_eta(runs: DataFrame, shifts: int = 1, block: int | None = None) -> DataFrame:
    """Estimates after each segment of (job_id, seg, dur, wall, skipped): a guess of the segment's wall
    time; the reported rate, whose numerator has the skipped segments too; the measured rate of the run
    segments alone; seconds that remain at the reported rate, and percent done. ``block`` cuts a job with
    very many segments into runs of so many, which are scanned in parallel."""
    run = F.when(F.col("skipped"), F.lit(0.0))
    cut = "block" if block else None
    rows = runs.select("job_id", "seg", "dur", "wall", "skipped", *([F.floor(F.col("seg") / block).alias("block")] if block else []))
    sums = {"done": (F.col("dur"), "sum"), "done_run": (run.otherwise(F.col("dur")), "sum"), "spent": (run.otherwise(F.col("wall")), "sum")}
    out = running(rows, "job_id", [F.col("seg")], cut, **sums)
    if block:
        totals = rows.groupBy(F.col("job_id").alias("job")).agg(F.sum("dur").alias("total"))
        out = out.join(totals, F.col("job_id").eqNullSafe(F.col("job")))
    else:
        out = out.withColumn("total", F.sum("dur").over(Window.partitionBy("job_id")))
    out = out.withColumn("estimate", F.col("dur") * 1.1 * shifts)
    reported = F.when(F.col("spent") > 0, F.col("done") / F.col("spent")).otherwise(F.lit(0.0))
    measured = F.when(F.col("spent") > 0, F.col("done_run") / F.col("spent")).otherwise(F.lit(0.0))
    out = out.withColumns({"rate_reported": reported, "rate_measured": measured})
    left = F.greatest(F.lit(0.0), F.col("total") - F.col("done"))
    return out.select(
        "job_id", "seg", "estimate", "rate_reported", "rate_measured",
        F.when(F.col("rate_reported") > 0, left / F.col("rate_reported")).alias("remaining"),
        F.when(F.col("total") > 0, F.col("done") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("overall_pct"),
    )
