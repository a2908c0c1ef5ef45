"""Operators that build on matching: redaction, substitution, context rules and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import split_words, strip_punct
from ..sources.sinks import saved


def redact_text(words: DataFrame, matches: DataFrame, style: str = "tag") -> DataFrame:
    """Document texts with flagged words replaced: ``tag`` ([redacted]), ``stars`` (as many as letters) or
    ``first`` (first letter and stars)."""
    hit = matches.select("doc_id", F.explode(F.sequence("word_index", F.col("word_index") + F.col("span") - 1)).alias("word_index")).distinct().withColumn("hit", F.lit(True))
    n = F.length("word")
    new = {"tag": F.lit("[redacted]"), "stars": F.repeat(F.lit("*"), n), "first": F.concat(F.substring("word", 1, 1), F.repeat(F.lit("*"), n - 1))}[style]
    shown = _marked(words, hit, "hit").withColumn("shown", F.when(F.col("hit"), new).otherwise(F.col("word")))
    return shown.groupBy("doc_id").agg(_in_order("shown").alias("text"))


def _marked(words: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """Words (doc_id, word_index, word) with ``mark``, which ``marks`` has for some of them, a row a word at most.
    Both are dealt by document, once: the texts made of the words need no further shuffle."""
    same = [F.col(c).cast(words.schema[c].dataType).alias(c) for c in ("doc_id", "word_index")]
    hits = marks.select(*same, mark).filter("doc_id is not null and word_index is not null")
    rows = words.select("doc_id", "word_index", "word", F.lit(True).alias("__said")).unionByName(hits, allowMissingColumns=True).repartition("doc_id")
    place = Window.partitionBy("doc_id", "word_index")
    return rows.withColumn(mark, F.max(mark).over(place)).filter("__said").drop("__said")


def _in_order(word: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", word))), lambda x: x[word]), " ")


def _substitutes(matches: DataFrame, substitutions: DataFrame, fallback: str) -> DataFrame:
    """``matches`` with ``new``: what ``substitutions`` (entry, substitute) have for their rule, the fallback
    for rules without one."""
    known = substitutions.groupBy("entry").agg(F.min("substitute").alias("new"))
    return matches.join(known, "entry", "left").withColumn("new", F.coalesce("new", F.lit(fallback)))


def substitute_text(words: DataFrame, matches: DataFrame, substitutions: DataFrame, fallback: str = "[censored]") -> DataFrame:
    """Document texts with every match replaced by its rule's substitute. Each word of a phrase is
    replaced; a word of several matches takes the first of them, single words before phrases, then by
    line."""
    spread = F.explode(F.sequence("word_index", F.col("word_index") + F.col("span") - 1)).alias("at")
    flagged = _substitutes(matches, substitutions, fallback).select("doc_id", spread, "span", "line_no", "new")
    first = flagged.groupBy("doc_id", F.col("at").alias("word_index")).agg(F.min_by("new", F.struct(F.col("span") > 1, "line_no")).alias("new"))
    shown = _marked(words, first, "new").withColumn("shown", F.coalesce("new", "word"))
    return shown.groupBy("doc_id").agg(_in_order("shown").alias("text"))


STYLES = ("word", "tag", "stars", "first")


def styled_text(words: DataFrame, matches: DataFrame, styles: DataFrame, fallback: str = "tag", tag: str = "[censored]") -> DataFrame:
    """Document texts with every word of a match shown in its rule's style. ``styles`` (entry, style, substitute):
    ``word`` shows the substitute (the tag if there is none), ``tag`` the tag, ``stars`` a star for each
    character, ``first`` the first character and stars. Punctuation around the word stays. Rules without a row, or with an
    unknown style, take ``fallback``; of several rows of a rule the smallest counts, of several matches of a word the
    first, single words before phrases, then by line."""
    if fallback not in STYLES:
        raise ValueError(f"unknown style: {fallback}")
    known = styles.filter(F.col("style").isin(*STYLES)).groupBy("entry").agg(F.min(F.struct("style", "substitute")).alias("__look"))
    spread = F.explode(F.sequence("word_index", F.col("word_index") + F.col("span") - 1)).alias("at")
    look = F.coalesce("__look", F.struct(F.lit(fallback).alias("style"), F.lit(None).cast("string").alias("substitute")))
    flagged = matches.join(known, "entry", "left").select("doc_id", spread, "span", "line_no", look.alias("__look"))
    first = flagged.groupBy("doc_id", F.col("at").alias("word_index")).agg(F.min_by("__look", F.struct(F.col("span") > 1, "line_no")).alias("__look"))
    core = strip_punct(F.col("word"))
    at, n = F.expr("instr(word, __core)"), F.length("__core")
    style = F.col("__look.style")
    new = F.when(style == "word", F.coalesce("__look.substitute", F.lit(tag))).when(style == "stars", F.repeat(F.lit("*"), n))
    new = new.when(style == "first", F.concat(F.substring("__core", 1, 1), F.repeat(F.lit("*"), n - 1))).otherwise(F.lit(tag))
    around = F.concat(F.substring("word", F.lit(1), at - 1), new, F.substring("word", at + n, F.length("word")))
    shown = _marked(words, first, "__look").withColumn("__core", core).withColumn("shown", F.when(F.col("__look").isNull(), F.col("word")).otherwise(around))
    return shown.groupBy("doc_id").agg(_in_order("shown").alias("text"))


def substitute_cues(cues: DataFrame, matches: DataFrame, substitutions: DataFrame, fallback: str = "[censored]") -> DataFrame:
    """Cues (doc_id, cue, cue_start, cue_end, cue_text) with ``new_text``: words of the cue text that are
    words of a match that starts in the cue (compared stripped and in lower case) are replaced by the
    substitute of the match's rule, the first by line where several fit."""
    token = F.lower(strip_punct(F.col("w")))
    said = _substitutes(matches, substitutions, fallback).withColumn("w", F.explode(split_words(F.col("matched_text"))))
    said = said.select("doc_id", "start", "line_no", "new", token.alias("token")).filter("token <> ''")
    inside = _in_cue(said, cues).groupBy("doc_id", "cue", "token").agg(F.min_by("new", "line_no").alias("new"))
    swaps = inside.groupBy("doc_id", "cue").agg(F.map_from_entries(F.collect_list(F.struct("token", "new"))).alias("swaps"))
    shown = F.transform(split_words(F.col("cue_text")), lambda w: F.coalesce(F.try_element_at("swaps", F.lower(strip_punct(w))), w))
    new = F.when(F.col("swaps").isNull(), F.col("cue_text")).otherwise(F.array_join(shown, " "))
    return cues.join(swaps, ["doc_id", "cue"], "left").withColumn("new_text", new).drop("swaps")


def context_rules(matches: DataFrame, words: DataFrame, suppress: list[str], before: int) -> DataFrame:
    """Matches without one of the ``suppress`` words among the ``before`` words ahead of them."""
    near = words.withColumn("t", F.lower(strip_punct(F.col("word")))).filter(F.col("t").isin(*suppress))
    shadow = near.select("doc_id", F.explode(F.sequence(F.col("word_index") + 1, F.col("word_index") + before)).alias("word_index")).distinct()
    return matches.join(shadow, ["doc_id", "word_index"], "left_anti")


def term_context(matches: DataFrame, words: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches that no context rule excuses. ``rules`` (entry, near, before, after): a match of ``entry`` (null: of any
    rule) is excused if the words of ``near`` (one or more, compared stripped and in lower case, all in a row) end
    within the ``before`` words ahead of it, or begin within the ``after`` words behind its last. Null or 0: not on
    that side. Rules without a word in ``near`` excuse nothing.

    Only words that a rule names are joined, so the work grows with those, not with the corpus."""
    parts = F.filter(F.transform(split_words(F.col("near")), lambda w: F.lower(strip_punct(w))), lambda t: t != "")
    numbered = rules.select(F.struct(F.col("entry").alias("entry"), parts.alias("parts"), F.col("before").alias("before"), F.col("after").alias("after")).alias("rule")).distinct()
    wanted = numbered.select("rule", F.posexplode("rule.parts").alias("j", "token"))
    said = words.select("doc_id", "word_index", F.lower(strip_punct(F.col("word"))).alias("token"))
    places = said.join(wanted, "token").groupBy("doc_id", "rule", (F.col("word_index") - F.col("j")).alias("first")).agg(F.countDistinct("j").alias("n"))
    found = places.filter(F.col("n") == F.size("rule.parts")).withColumn("last", F.col("first") + F.col("n") - 1)

    def shadow(reach: str, lo: Column, hi: Column) -> DataFrame:
        return found.filter(F.col(reach) > 0).select("doc_id", F.col("rule.entry").alias("entry"), F.explode(F.sequence(lo, hi)).alias("at")).distinct()

    ahead = shadow("rule.before", F.col("last") + 1, F.col("last") + F.col("rule.before"))
    behind = shadow("rule.after", F.col("first") - F.col("rule.after"), F.col("first") - 1)
    out = matches
    for side, place in ((ahead, F.col("m.word_index")), (behind, F.col("m.word_index") + F.col("m.span") - 1)):
        same = (F.col("m.doc_id") == F.col("s.doc_id")) & (place == F.col("s.at")) & (F.col("s.entry").isNull() | (F.col("s.entry") == F.col("m.entry")))
        out = out.alias("m").join(side.alias("s"), same, "left_anti")
    return out


def text_similarity(a: Column, b: Column) -> Column:
    """0 to 100 from the edit distance."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise((1 - F.levenshtein(a, b) / longest) * 100)


def _in_cue(rows: DataFrame, cues: DataFrame, width: float = 10.0) -> DataFrame:
    """``rows`` (doc_id, start and more), each with the cues that it starts in: a range join by buckets of
    ``width`` seconds, with the bounds of the cue."""
    bucket = fresh("__bucket", rows, cues)
    spread = cues.select("doc_id", "cue", "cue_start", "cue_end", F.explode(F.sequence(F.floor(F.col("cue_start") / width), F.floor(F.col("cue_end") / width))).alias(bucket))
    timed = rows.filter("start is not null").withColumn(bucket, F.floor(F.col("start") / width))
    return timed.join(spread, ["doc_id", bucket]).filter((F.col("start") >= F.col("cue_start")) & (F.col("start") < F.col("cue_end"))).drop(bucket)


def cue_texts(words: DataFrame, cues: DataFrame, width: float = 30.0) -> DataFrame:
    """Cues (doc_id, cue, cue_start, cue_end, cue_text) with the transcript's words that start in them
    (``heard``) and the mean of their scores, a word without one counting 0 (``confidence``).

    Words travel once, gathered into blocks of ``width`` seconds, and meet the cues block by block. A cue that lies in one
    block goes on as its text; only the words of others go on as words, to be put in order over blocks."""
    block = fresh("__block", words, cues)
    lo, hi = F.floor(F.col("cue_start") / width), F.ceil(F.col("cue_end") / width) - 1
    spread = cues.filter("cue_start < cue_end").select("doc_id", "cue", "cue_start", "cue_end", (lo == hi).alias("__whole"), F.explode(F.sequence(lo, hi)).alias(block))
    held = F.array_sort(F.collect_list(F.struct("word_index", "word", "start", F.coalesce("score", F.lit(0.0)).alias("score")))).alias("__held")
    said = words.filter("start is not null").groupBy("doc_id", F.floor(F.col("start") / width).alias(block)).agg(held)
    inside = F.filter("__held", lambda w: (w["start"] >= F.col("cue_start")) & (w["start"] < F.col("cue_end")))
    met = spread.join(said, ["doc_id", block]).select("doc_id", "cue", "__whole", inside.alias("__in")).filter(F.size("__in") > 0)
    text = F.array_join(F.transform("__in", lambda w: w["word"]), " ")
    some = F.transform("__in", lambda w: F.struct(w["word_index"].alias("word_index"), w["word"].alias("word")))
    parts = met.select(
        "doc_id", "cue", F.when(F.col("__whole"), text).alias("__text"), F.when(~F.col("__whole"), some).alias("__some"),
        F.size("__in").alias("__n"), F.aggregate("__in", F.lit(0.0), lambda total, w: total + w["score"]).alias("__sum"),
    )
    heard = parts.groupBy("doc_id", "cue").agg(F.max("__text").alias("__text"), F.flatten(F.collect_list("__some")).alias("__some"), (F.sum("__sum") / F.sum("__n")).alias("confidence"))
    in_order = F.array_join(F.transform(F.array_sort("__some"), lambda w: w["word"]), " ")
    heard = heard.select("doc_id", "cue", F.coalesce("__text", in_order).alias("heard"), "confidence")
    joined = cues.join(heard, ["doc_id", "cue"], "left")
    return joined.withColumns({"heard": F.coalesce("heard", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def srt_diff(words: DataFrame, cues: DataFrame) -> DataFrame:
    """Cues with the transcript heard in them and how alike the two are."""
    return cue_texts(words, cues).withColumn("similarity", F.round(text_similarity(F.lower("cue_text"), F.lower("heard")), 4))


def srt_correct(words: DataFrame, cues: DataFrame, mode: str = "report", least: float = 85.0, sure: float = 0.5) -> DataFrame:
    """Cues with ``action`` and ``new_text``. A cue diverges if its text is less than ``least`` alike the
    transcript. ``report`` marks those for review; ``auto`` puts the transcript in where its confidence is
    above ``sure``, and keeps the rest; ``hybrid`` does so too and marks the rest for review."""
    if mode not in ("report", "auto", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    diverges = F.col("similarity") < least
    mend = diverges & (F.col("confidence") > sure) & F.lit(mode != "report")
    action = F.when(mend, "correct").when(diverges & F.lit(mode != "auto"), "review").otherwise("keep")
    return srt_diff(words, cues).withColumns({"action": action, "new_text": F.when(mend, F.col("heard")).otherwise(F.col("cue_text"))})


STRATEGIES = ("transcript_primary", "srt_primary", "highest_confidence")


def srt_align(matches: DataFrame, cues: DataFrame, words: DataFrame, least: float = 85.0, strategy: str = "transcript_primary") -> DataFrame:
    """Matches with the cue that they start in where its text is at least ``least`` alike the transcript
    (``cue``, else null) and their times by ``strategy``: ``transcript_primary`` keeps the match's own, the cue
    only confirms the words; ``srt_primary`` takes the cue's; ``highest_confidence`` takes the cue's where its
    similarity (as a share) is above the match's score. A match in several such cues takes the first."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    # only cues in which a match starts are heard and compared
    spots = saved(_in_cue(matches.select("doc_id", "start").distinct(), cues), "match-cues")
    near = cues.join(spots.select("doc_id", "cue").distinct(), ["doc_id", "cue"], "left_semi")
    good = srt_diff(words, near).filter(F.col("similarity") >= least)
    first = spots.join(good.select("doc_id", "cue", "similarity"), ["doc_id", "cue"]).groupBy("doc_id", "start").agg(F.min(F.struct("cue", "cue_start", "cue_end", "similarity")).alias("__cue"))
    taken = {"transcript_primary": F.lit(False), "srt_primary": F.lit(True), "highest_confidence": F.col("__cue.similarity") / 100 > F.coalesce("score", F.lit(0.0))}[strategy]
    use = F.col("__cue").isNotNull() & taken
    out = matches.drop("cue", "aligned_start", "aligned_end").join(first, ["doc_id", "start"], "left").withColumns({
        "cue": F.col("__cue.cue"),
        "aligned_start": F.when(use, F.col("__cue.cue_start")).otherwise(F.col("start")),
        "aligned_end": F.when(use, F.col("__cue.cue_end")).otherwise(F.col("end")),
    })
    return out.drop("__cue")
