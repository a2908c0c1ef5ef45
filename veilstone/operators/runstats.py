"""Statistics of matches kept per run and merged: exact counts, and sketches where exact ones can't be merged.

A run's rows (run, the dimensions, counts and two sketches) are written once; totals over any set of runs and any
grouping of the dimensions come from those rows alone, without the matches. Distinct documents are HyperLogLog
sketches (relative error about 1.04 / sqrt(2^LG_K)), score quantiles KLL sketches (rank error about 2.3 / K).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh

LG_K = 12  # 4096 registers: 1.6 % of the count
K = 200  # 1.3 % of the ranks


def run_partials(matches: DataFrame, dims: list[str], low: float, run: str = "run") -> DataFrame:
    """One row per run and value of ``dims`` from matches (doc_id, score, ``run`` and ``dims``): ``n``, ``scored``
    (matches with a score), ``low`` (scores below ``low``), ``score_sum``, ``score_min``, ``score_max``, ``docs``
    (a sketch of the documents) and ``scores`` (a sketch of the scores, null without one)."""
    score = F.col("score").cast("double")
    return matches.groupBy(run, *dims).agg(
        F.count("*").alias("n"), F.count("score").alias("scored"), F.count_if(score < low).alias("low"),
        F.sum(score).alias("score_sum"), F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        F.hll_sketch_agg(F.col("doc_id").cast("string"), LG_K).alias("docs"),
        F.when(F.count("score") > 0, F.kll_sketch_agg_double(score, K)).alias("scores"),
    )


def merged_stats(partials: DataFrame, sets: list[list[str]], quantiles: list[float] = [0.05, 0.5, 0.95]) -> DataFrame:
    """``partials`` of any runs merged under the grouping ``sets`` of their dimensions.

    Returns the dimensions, ``level`` (the dimensions of the row's set, comma-joined, in the order of ``sets``'
    first use), n, scored, low, score_mean, score_min, score_max, ``docs`` (estimate) and ``score_q`` (quantiles of
    the scores; null without one). A dimension that a set leaves out is null, told by ``level`` from a null of
    its own. No rows: only an empty set gives one, with n 0."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    column = fresh("__set", partials)
    grouped = partials.groupingSets([[F.col(d) for d in s] for s in sets], *dims) if dims else partials.groupBy()
    out = {
        "n": F.coalesce(F.sum("n"), F.lit(0).cast("long")), "scored": F.coalesce(F.sum("scored"), F.lit(0).cast("long")), "low": F.coalesce(F.sum("low"), F.lit(0).cast("long")),
        "score_mean": F.try_divide(F.sum("score_sum"), F.sum("scored")), "score_min": F.min("score_min"), "score_max": F.max("score_max"),
        "docs": F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("docs")), F.lit(0).cast("long")),
        column: F.when(F.sum("scored") > 0, F.kll_merge_agg_double("scores")),
    }
    level = reduce(lambda a, d: F.concat(a, F.when(F.grouping(d) == 0, F.lit(f",{d}")).otherwise("")), dims, F.lit("")) if dims else F.lit("")
    merged = grouped.agg(F.substring(level, 2, 1 << 30).alias("level"), *[c.alias(name) for name, c in out.items()])
    return merged.withColumn("score_q", _quantiles(F.col(column), quantiles)).drop(column)


def _quantiles(sketch: Column, quantiles: list[float]) -> Column:
    each = F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(float(q))) for q in quantiles])
    return F.when(sketch.isNotNull(), each)


def estimated_seconds(durations: DataFrame, rates: DataFrame) -> DataFrame:
    """Estimated processing time of each step from the material's seconds (``durations``: doc_id, duration_sec;
    unknown or negative ones don't count) and the steps' ``rates`` (step, factor: seconds of work per second of
    material, fixed_sec: per document): step, documents, material_sec, estimated_sec."""
    known = durations.filter("duration_sec >= 0").agg(F.count("*").alias("documents"), F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("material_sec"))
    work = F.col("material_sec") * F.col("factor") + F.col("documents") * F.col("fixed_sec")
    # an equi-join on a constant: the totals are one row
    both = rates.withColumn("__one", F.lit(1)).join(known.withColumn("__one", F.lit(1)), "__one")
    return both.select("step", "documents", "material_sec", work.alias("estimated_sec"))


def analysis_report(matches: DataFrame, durations: DataFrame, rates: DataFrame, low: float) -> DataFrame:
    """What an analysis shows before any work is done, as (section, name, value): ``term`` with the matches of each
    rule, ``low_confidence`` with those that score below ``low``, ``estimate`` with the seconds of each step,
    rounded to a thousandth, and of all, as they are (name null)."""
    terms = matches.groupBy(F.col("entry").alias("name")).agg(F.count("*").cast("double").alias("value"), F.count_if(F.col("score") < low).alias("low"))
    none = F.lit(None).cast("string").alias("name")
    doubtful = terms.agg(F.coalesce(F.sum("low"), F.lit(0)).cast("double").alias("value"))
    steps = estimated_seconds(durations, rates).groupBy(F.col("step").alias("name")).agg(F.sum("estimated_sec").alias("value"))
    rounded = steps.select(F.lit("estimate").alias("section"), "name", F.round("value", 3).alias("value"))
    parts = [
        terms.select(F.lit("term").alias("section"), "name", "value"), doubtful.select(F.lit("low_confidence").alias("section"), none, "value"),
        rounded, steps.agg(F.sum("value").alias("value")).select(F.lit("estimate").alias("section"), none, "value"),
    ]
    return reduce(DataFrame.unionByName, parts)
