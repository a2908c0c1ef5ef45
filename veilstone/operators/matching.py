"""Word matching against a rule list, with a fixed precedence of rule classes.

A token's hit depends on its text alone, so classes are resolved on the distinct tokens: four equi-joins
(theta joins become equi-joins on the substrings of the rules' lengths), then the smallest
(class, line) wins, then one join back to the words. Phrases are runs of tokens, joined as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import fmt_timestamp
from ..functions.text import split_words, strip_punct
from ..sources.sinks import saved
from .sieve import sifted

EXACT_CI, EXACT_CS, PREFIX, CONTAINS = 1, 2, 3, 4


def timed(words: DataFrame) -> DataFrame:
    """Words with both times."""
    return words.filter(F.col("start").isNotNull() & F.col("end").isNotNull())


def candidates(words: DataFrame) -> DataFrame:
    """Timed words whose stripped ``token`` isn't empty; indices stay as they are."""
    return timed(words).withColumn("token", strip_punct(F.col("word"))).filter("token <> ''")


def _singles(lexicon: DataFrame, kind: str) -> DataFrame:
    one = lexicon.filter((F.size("tokens") == 1) & (F.col("match_type") == kind))
    return one.select("line_no", "raw", F.try_element_at("tokens", F.lit(1)).alias("root"), "case_sensitive")


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules with the key they are looked up by: lower-cased unless case-sensitive."""
    return rules.withColumn("key", F.when(F.col("case_sensitive"), F.col("root")).otherwise(F.lower("root")))


def _pieces(text: Column, lengths: Column, anywhere: bool) -> Column:
    """Distinct substrings (prefixes, or all) of the ``lengths`` of a text."""
    fits = F.filter(lengths, lambda n: n <= F.length(text))
    if anywhere:
        cut = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))))
    else:
        cut = F.transform(fits, lambda n: F.substring(text, F.lit(1), n))
    return F.array_distinct(cut)


def class_hits(tokens: DataFrame, lexicon: DataFrame, *kinds: int) -> DataFrame:
    """All (token, class, line_no, raw) of the rule classes over distinct ``tokens``: every token offers
    its keys for every class, and one equi-join with the keyed rules finds the hits."""
    exact, prefix, inside = (_keyed(_singles(lexicon, kind)) for kind in ("exact", "startswith", "contains"))
    rules = (
        exact.withColumn("class", F.when(F.col("case_sensitive"), EXACT_CS).otherwise(EXACT_CI))
        .unionByName(prefix.withColumn("class", F.lit(PREFIX)))
        .unionByName(inside.withColumn("class", F.lit(CONTAINS)))
        .filter(F.col("class").isin(*kinds))
    )

    def offer(kind: int, cs: bool) -> Column:
        text = F.col("token") if cs else F.lower("token")
        if kind in (EXACT_CI, EXACT_CS):
            keys = F.array(text)
        else:
            keys = _pieces(text, F.col(f"__n{kind}{cs}"), kind == CONTAINS)
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("class"), F.lit(cs).alias("case_sensitive"), k.alias("key")))

    wanted = [(EXACT_CI, False), (EXACT_CS, True), (PREFIX, False), (PREFIX, True), (CONTAINS, False), (CONTAINS, True)]
    for kind, cs in wanted[2:]:
        of = (prefix if kind == PREFIX else inside).filter(F.col("case_sensitive") == cs)
        tokens = tokens.withColumn(f"__n{kind}{cs}", of.agg(F.sort_array(F.collect_set(F.length("key"))).alias("n")).scalar())
    offers = F.concat(*[offer(kind, cs) for kind, cs in wanted if kind in kinds])
    offered = tokens.select("token", F.explode(offers).alias("p")).select("token", "p.*")
    return offered.join(rules, ["class", "case_sensitive", "key"]).select("token", "class", "line_no", "raw")


def token_hits(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The hit of each distinct token: smallest class, then smallest line."""
    hits = class_hits(tokens, lexicon, EXACT_CI, EXACT_CS, PREFIX, CONTAINS)
    first = F.min(F.struct("class", "line_no", "raw")).alias("hit")
    return hits.groupBy("token").agg(first).select("token", "hit.*")


def first_hit(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Single-token matches: at most one per word. The tokens' hits are written: Spark then knows how few they are, and
    need not shuffle the words to them."""
    found = candidates(words)
    hits = saved(token_hits(found.select("token").distinct(), lexicon), "token-hits")
    return found.join(hits, "token").select(
        "doc_id", "word_index", F.lit(1).alias("span"), F.col("word").alias("matched_text"), F.col("raw").alias("entry"), "line_no",
        "start", "end", F.coalesce("score", F.lit(0.0)).alias("score"),
    )


BLOCK = 256  # words of a block in which runs are read
LONG = 16  # words of a run; longer phrases wait at their rarest token


def _runs(tokens: DataFrame, spans: list[int], held: list[str], take: list[Column]) -> DataFrame:
    """All runs of consecutive word indices of the lengths ``spans`` in ``tokens`` (doc_id, word_index, kind, key
    and ``held``): doc_id, word_index of the first, kind, span, text (the keys, joined by spaces) and ``take``, columns
    of run (structs of word_index, key and ``held``), which itself is left behind, as it is wide.

    Runs are read inside blocks of a document, each with the first words of the next block behind its own, so a
    long document is many tasks' work; tokens are gathered into blocks before they are shuffled, once."""
    most, own = max(spans), F.floor(F.col("word_index") / BLOCK)
    spread = F.when((F.col("word_index") % BLOCK < most - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    gathered = F.array_sort(F.collect_list(F.struct("word_index", "key", *held))).alias("gathered")
    blocks = tokens.withColumn("block", F.explode(spread)).groupBy("doc_id", "block", "kind").agg(gathered)
    ahead = F.explode(F.transform("gathered", lambda w, i: F.slice("gathered", i + 1, F.lit(most)))).alias("run")
    read = blocks.select("doc_id", "block", "kind", ahead).withColumn("word_index", F.col("run")[0]["word_index"]).filter(own == F.col("block"))
    whole = lambda n: (F.size("run") >= n) & (F.col("run")[n - 1]["word_index"] == F.col("word_index") + n - 1)
    cut = lambda n: F.struct(F.lit(n).alias("span"), F.array_join(F.transform(F.slice("run", 1, n), lambda x: x["key"]), " ").alias("text"))
    grams = F.filter(F.array(*[F.when(whole(n), cut(n)) for n in spans]), lambda g: g.isNotNull())
    opened = read.select("doc_id", "word_index", "kind", "run", F.explode(grams).alias("g")).select("doc_id", "word_index", "kind", "g.*", "run")
    return opened.withColumn("run", F.slice("run", F.lit(1), F.col("span"))).select("doc_id", "word_index", "kind", "span", "text", *take)


def _at_rarest(tokens: DataFrame, parts: DataFrame, held: list[str], take: list[Column]) -> DataFrame:
    """As ``_runs`` for phrases of any length (``parts``: kind, text, span, j, key): each waits at its rarest
    token, by the counts of the phrases' tokens in the words, and the other tokens are looked up by place."""
    counts = tokens.groupBy("kind", "key").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "j", "key")).alias("rare")
    known = parts.join(counts, ["kind", "key"]).groupBy("kind", "text", "span").agg(rarest, F.count("*").alias("all")).filter(F.col("all") == F.col("span"))
    waiting = known.select("kind", "text", F.col("rare.key").alias("key"), F.col("rare.j").alias("anchor"))
    starts = tokens.select("doc_id", "word_index", "kind", "key").join(waiting, ["kind", "key"]).select("doc_id", "kind", "text", (F.col("word_index") - F.col("anchor")).alias("at"))
    needed = starts.filter("at >= 0").join(parts, ["kind", "text"]).withColumn("word_index", F.col("at") + F.col("j"))
    met = needed.join(tokens, ["doc_id", "word_index", "kind", "key"])
    run = F.array_sort(F.collect_list(F.struct("word_index", "key", *held))).alias("run")
    whole = met.groupBy("doc_id", F.col("at").alias("word_index"), "kind", "span", "text").agg(run).filter(F.size("run") == F.col("span"))
    return whole.select("doc_id", "word_index", "kind", "span", "text", *take)


def _in_a_row(tokens: DataFrame, phrases: DataFrame, held: list[str], take: list[Column], many: bool = False) -> DataFrame:
    """Places of ``phrases`` (kind, text: keys joined by spaces, and more) in ``tokens`` (doc_id, word_index, kind,
    key and ``held``): doc_id, word_index, span, ``take`` (as in ``_runs``) and the columns of ``phrases``, a row for each of
    them with the text. Only tokens that a phrase has are kept, cut down before any of them is shuffled where the
    phrases are few. ``many`` is for phrases that may be too many to broadcast: tokens and runs then pass
    a sieve before they are shuffled. The distinct lengths of phrases reach the driver."""
    parts = phrases.select("kind", "text").distinct().withColumn("keys", F.split("text", " ")).withColumn("span", F.size("keys"))
    lengths = sorted(r[0] for r in parts.select("span").distinct().collect())
    needed = parts.select("kind", F.explode("keys").alias("key")).distinct()
    wanted = sifted(tokens, needed, "kind", "key") if many else tokens.join(needed, ["kind", "key"], "left_semi")
    short, long = [n for n in lengths if n <= LONG], lengths and lengths[-1] > LONG
    runs = _runs(wanted, short or [1], held, take)
    found = (sifted(runs, phrases, "kind", "text") if many else runs).join(phrases, ["kind", "text"])
    if long:
        far = parts.filter(F.col("span") > LONG).select("kind", "text", "span", F.posexplode("keys").alias("j", "key"))
        found = found.unionByName(_at_rarest(saved(wanted, "wanted-tokens"), far, held, take).join(phrases, ["kind", "text"]))
    return found


def phrase_matches(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Phrases over consecutive word indices: every phrase at every place, overlaps included. The score
    is the smallest of the span, null counting as 0."""
    rules = lexicon.filter(F.size("tokens") > 1)
    text = F.array_join("tokens", " ")
    # two kinds of keys: the token as it is (s), or lower-cased (i)
    rules = rules.select("line_no", "raw", F.when(F.col("case_sensitive"), "s").otherwise("i").alias("kind"), F.when(F.col("case_sensitive"), text).otherwise(F.lower(text)).alias("text"))
    keys = F.array(F.struct(F.lit("s").alias("kind"), F.col("token").alias("key")), F.struct(F.lit("i").alias("kind"), F.lower("token").alias("key")))
    tokens = candidates(words).select("doc_id", "word_index", "word", "start", "end", "score", F.explode(keys).alias("k")).select("doc_id", "word_index", "k.*", "word", "start", "end", "score")
    take = [
        F.array_join(F.transform("run", lambda x: x["word"]), " ").alias("matched_text"), F.col("run")[0]["start"].alias("start"), F.element_at("run", -1)["end"].alias("end"),
        F.array_min(F.transform("run", lambda x: F.coalesce(x["score"], F.lit(0.0)))).alias("score"),
    ]
    found = _in_a_row(tokens, rules, ["word", "start", "end", "score"], take)
    return found.select("doc_id", "word_index", "span", "matched_text", F.col("raw").alias("entry"), "line_no", "start", "end", "score")


def find_matches(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """All matches, with clock texts. ``line_no`` gives the order of ties: single tokens first, then
    phrases by line."""
    both = first_hit(words, lexicon).unionByName(phrase_matches(words, lexicon))
    return both.withColumns({"start_hms": fmt_timestamp(F.col("start")), "end_hms": fmt_timestamp(F.col("end"))})


def match_order(matches: DataFrame) -> DataFrame:
    """``matches`` with ``ordinal`` (from 1) inside their document: by word, single tokens first, then
    phrases by line."""
    order = Window.partitionBy("doc_id").orderBy("word_index", F.col("span") > 1, "line_no")
    return matches.withColumn("ordinal", F.row_number().over(order))


def phrase_search(words: DataFrame, queries: DataFrame, context: int = 6) -> DataFrame:
    """Places of query texts (query_id, query): tokens compared in lower case, the words' stripped, the
    query's as written; a word needs a start time only. With ``context`` words on both sides. Queries
    without words find nothing; equal texts are searched once, whatever their ids."""
    from .review import with_context

    one = F.lit("i").alias("kind")
    # written, since they are used three times, and Spark then knows their size
    asked = saved(queries.select("query_id", "query", one, F.array_join(split_words(F.lower("query")), " ").alias("text")).filter("text <> ''"), "asked")
    tokens = words.filter(F.col("start").isNotNull()).select("doc_id", "word_index", one, F.lower(strip_punct(F.col("word"))).alias("key"), "start")
    hits = _in_a_row(tokens, asked, ["start"], [F.col("run")[0]["start"].alias("start")], many=True)
    return with_context(hits.select("doc_id", "word_index", "query_id", "query", "span", "start"), words, context)
