"""Context snippets, the review queue and the replay of review decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import saved
from .matching import match_order
from .sieve import sifted


def with_context(spans: DataFrame, words: DataFrame, k: int, block: int = 64) -> DataFrame:
    """``spans`` (doc_id, word_index, span and more) with ``context``: the raw words from k before to k
    after, clipped at the document's ends, between dots; null where the document has none of them.

    Words travel as blocks of ``block``, and a span asks for the one or two blocks that its words lie in,
    so the join has a row for a block and not for a word. Equal spans are asked for once, and only blocks that
    one asks for are made. ``spans`` are written, since they are used three times."""
    spans = saved(spans, "spans")
    names = [c for c in spans.columns if c != "context"]
    lo, hi = F.greatest(F.lit(0), F.col("word_index") - k), F.col("word_index") + F.col("span") + k - 1
    need = spans.select("doc_id", "word_index", "span").distinct().withColumns({"lo": lo, "hi": hi})
    asked = need.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    held = F.array_sort(F.collect_list(F.struct(F.col("word_index").alias("at"), "word"))).alias("held")
    near = words.select("doc_id", "word_index", "word", F.floor(F.col("word_index") / block).alias("block"))
    # the words of other blocks are sifted out before the shuffle, and the join leaves out what slips through
    blocks = sifted(near, asked, "doc_id", "block").groupBy("doc_id", "block").agg(held)
    inside = F.filter("held", lambda w: (w["at"] >= F.col("lo")) & (w["at"] <= F.col("hi")))
    part = F.transform(inside, lambda w: w["word"])
    parts = asked.join(blocks, ["doc_id", "block"]).groupBy("doc_id", "word_index", "span").agg(F.array_sort(F.collect_list(F.struct("block", part.alias("part")))).alias("parts"))
    text = F.array_join(F.flatten(F.transform("parts", lambda p: p["part"])), " ")
    made = parts.select("doc_id", "word_index", "span", F.when(text != "", F.concat(F.lit("..."), text, F.lit("..."))).alias("context"))
    return spans.select(*names).join(made, ["doc_id", "word_index", "span"], "left").select(*names, "context")


def review_queue(matches: DataFrame, words: DataFrame, min_conf: float = 0.0, k: int = 8) -> DataFrame:
    """Matches that need a person: all unless ``min_conf`` > 0 and the score is above it. Ordinals and
    totals count all candidates."""
    whole = Window.partitionBy("doc_id")
    queue = match_order(matches).withColumn("total", F.count("*").over(whole))
    if min_conf > 0:
        queue = queue.filter(F.col("score") <= min_conf)
    return with_context(queue, words, k)


def replay_decisions(matches: DataFrame, decisions: DataFrame, min_conf: float = 0.0) -> DataFrame:
    """Outcome of every candidate from a table of decisions (doc_id, ordinal, decision Y/N/S/Q): rejected,
    approved or auto_approved. From the first S on all are approved; before it a score above ``min_conf``
    (where that is over 0) is approved by itself and its decision is not asked for. A document with a Q
    that is reached has no output at all."""
    auto = F.lit(min_conf > 0) & (F.col("score") > min_conf)
    whole = Window.partitionBy("doc_id")
    seen = match_order(matches).join(decisions, ["doc_id", "ordinal"], "left").withColumn("asked", F.when(~auto, F.col("decision")))
    seen = seen.withColumn("stop", F.min(F.when(F.col("asked").isin("S", "Q"), F.struct("ordinal", "asked"))).over(whole))
    seen = seen.filter(F.coalesce(F.col("stop.asked") != "Q", F.lit(True)))
    after = F.coalesce(F.col("ordinal") >= F.col("stop.ordinal"), F.lit(False))
    outcome = F.when(after, "approved").when(auto, "auto_approved").when(F.col("asked") == "N", "rejected").otherwise("approved")
    return seen.withColumn("outcome", outcome).drop("stop", "asked", "decision")


def review_overrides(outcomes: DataFrame) -> DataFrame:
    """Skip rows of the rejected candidates."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    return outcomes.filter("outcome = 'rejected'").select("doc_id", F.row_number().over(order).alias("seq"), F.lit("skip").alias("action"), "word_index", F.col("matched_text").alias("text"))


def review_summary(outcomes: DataFrame, added: DataFrame) -> DataFrame:
    """Counts per document: candidates, approved, rejected, auto_approved, added."""
    n = outcomes.groupBy("doc_id").agg(F.count("*").alias("candidates"), *[F.count_if(F.col("outcome") == x).alias(x) for x in ("approved", "rejected", "auto_approved")])
    more = added.groupBy("doc_id").agg(F.count("*").alias("added"))
    return n.join(more, "doc_id", "full_outer").na.fill(0)
