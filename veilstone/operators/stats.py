"""Per-document and per-job statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import fmt_duration, offset_clock


def flag_stats(words: DataFrame, matches: DataFrame) -> DataFrame:
    """word_count and candidates of every document that has words; 0 candidates without a match."""
    n = words.groupBy("doc_id").agg(F.count("*").alias("word_count"))
    c = matches.groupBy("doc_id").agg(F.count("*").alias("candidates"))
    return n.join(c, "doc_id", "left").na.fill(0, ["candidates"])


def merge_stats(segment_words: DataFrame) -> DataFrame:
    """Segments and words per document."""
    return segment_words.groupBy("doc_id").agg(F.countDistinct("segment_index").alias("segments"), F.count("*").alias("word_count"))


def transcribe_stats(segment_words: DataFrame, runs: DataFrame) -> DataFrame:
    """Words of each segment and the seconds that its run took (``runs``: doc_id, segment_index,
    elapsed_sec), rounded to one place, with a total row per document (segment_index null) and one of all.
    A run without words counts 0 words, words without a run have no seconds; totals add unrounded ones."""
    words = segment_words.groupBy("doc_id", "segment_index").agg(F.count("*").alias("n"))
    spent = runs.groupBy("doc_id", "segment_index").agg(F.sum("elapsed_sec").alias("s"))
    both = words.join(spent, ["doc_id", "segment_index"], "full_outer")
    return both.rollup("doc_id", "segment_index").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("word_count"), F.round(F.sum("s"), 1).alias("elapsed_sec"))


def mute_stats(matches: DataFrame, overrides: DataFrame, merged: DataFrame) -> DataFrame:
    """candidates, skipped (distinct skip words, matched or not), added and muted_intervals."""
    c = matches.groupBy("doc_id").agg(F.count("*").alias("candidates"))
    skips = F.countDistinct(F.when(F.col("action") == "skip", F.col("word_index")))
    o = overrides.groupBy("doc_id").agg(skips.alias("skipped"), F.count_if(F.col("action") == "add").alias("added"))
    m = merged.groupBy("doc_id").agg(F.count("*").alias("muted_intervals"))
    return c.join(o, "doc_id", "full_outer").join(m, "doc_id", "full_outer").na.fill(0)


def run_summary(merge: DataFrame, flag: DataFrame, review: DataFrame, mute: DataFrame, streams: DataFrame, jobs: DataFrame, method: str, padding_ms: float) -> DataFrame:
    """The final report per document: started and finished (``jobs``: doc_id, started_at, finished_at,
    total_duration_sec) as clock texts in UTC, the duration and its text, segments, words, candidates, the
    counts of the review, skipped, added, muted intervals with method and padding, and the audio track's
    encoder, bit rate and reason for a fallback (``streams``: doc_id and the columns of an encoder plan).

    ``merge`` sets the documents. Counts without a row are 0, the rest is null. Each table has at most one
    row per document, so the joins share one partitioning."""
    none = F.lit(None).cast("string")
    flagged = flag.select("doc_id", "candidates")
    reviewed = review.select("doc_id", "approved", "rejected", "auto_approved")
    muted = mute.select("doc_id", "skipped", "added", "muted_intervals")
    out = merge.join(flagged, "doc_id", "left").join(reviewed, "doc_id", "left").join(muted, "doc_id", "left").na.fill(0)
    timed = jobs.select(
        "doc_id", offset_clock(F.col("started_at"), none).alias("started"), offset_clock(F.col("finished_at"), none).alias("finished"),
        F.round("total_duration_sec", 1).alias("duration_sec"), fmt_duration(F.col("total_duration_sec")).alias("duration"),
    )
    track = streams.select("doc_id", "encoder", "bitrate", "fallback_reason")
    return out.join(timed, "doc_id", "left").join(track, "doc_id", "left").withColumns({"method": F.lit(method), "padding_ms": F.lit(float(padding_ms))})


def analyze_terms(matches: DataFrame, low: float) -> DataFrame:
    """Matches per rule, and how many score below ``low``."""
    return matches.groupBy("entry").agg(F.count("*").alias("n"), F.count_if(F.col("score") < low).alias("low_confidence"))
