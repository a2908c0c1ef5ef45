"""Queries on statistics of runs, job documents with unknown fields, context rules per term and styles per word."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extras, runstats
from ..sources import documents, sinks
from . import fixtures as fx
from .fixtures import sql
from .matching_queries import bigint
from .registry import query

SETS = [["entry", "lang"], ["lang", "source"], ["source"], []]


def run_partials(spark, sf):
    """Statistics of four runs (documents by remainder), each per rule, language and source, written once."""
    about = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    rows = fx.matches(spark, sf).join(about, "doc_id").withColumn("run", F.pmod("doc_id", F.lit(4)))
    return sinks.saved(runstats.run_partials(rows, ["entry", "lang", "source"], 0.25), "run-stats")


@query("run_stats", sql("""select entry, lang, source, concat_ws(',', case when grouping(entry) = 0 then 'entry' end, case when grouping(lang) = 0 then 'lang' end, case when grouping(source) = 0 then 'source' end) as level,
    count(*) as n, count(score) as scored, count(*) filter (where score < 0.25) as low, sum(score) / count(score) as score_mean, min(score) as score_min, max(score) as score_max
    from matches join (select doc_id, lang, source from documents) using (doc_id) group by grouping sets ((entry, lang), (lang, source), (source), ())""", "matches"))
def run_stats(spark, sf):
    """The exact columns of statistics merged from four runs."""
    return runstats.merged_stats(run_partials(spark, sf), SETS).drop("docs", "score_q")


@query("run_sketches")
def run_sketches(spark, sf):
    """The estimated columns of the same; no SQL, since engines' sketches differ."""
    return runstats.merged_stats(run_partials(spark, sf), SETS).select("entry", "lang", "source", "level", "docs", "score_q")


RATES = (("separate", 1.125, 2.0), ("transcribe", 0.375, 4.0), ("encode", 0.0625, 0.5))


@query("analysis_report", sql("""select 'term' as section, entry as name, count(*)::double as value from matches group by entry
    union all select 'low_confidence', null, count(*) filter (where score < 0.25)::double from matches
    union all select 'estimate', step, round(sum(total_duration_sec) * factor + count(*) * fixed, 3) from tracks, (values ('separate', 1.125::double, 2.0::double), ('transcribe', 0.375, 4.0), ('encode', 0.0625, 0.5)) r(step, factor, fixed) group by step, factor, fixed
    union all select 'estimate', null, sum(total_duration_sec) * 1.5625::double + count(*) * 6.5::double from tracks""", "matches", "tracks"))
def analysis_report(spark, sf):
    durations = fx.tracks(spark, sf).select(F.col("track_id").alias("doc_id"), F.col("total_duration_sec").alias("duration_sec"))
    rates = spark.createDataFrame(list(RATES), "step string, factor double, fixed_sec double")
    return runstats.analysis_report(fx.kept_matches(spark, sf), durations, rates, 0.25)


def job_texts(spark, sf):
    """A job document per user of the events, with fields that no table of ours knows; every ninth is cut short."""
    user = F.col("user_id")
    text = F.format_string('{"job_id": "job%d", "note": "caf\\u00e9 \\"%d\\"", "steps_completed": ["1a_extract"], "probe": {"streams": [{"codec": "aac", "index": %d}]}, "x_%d": [%d, null, 1.25]}', user, user, user, user % 3, user)
    users = fx.table(spark, sf, "events").select("user_id").distinct()
    return users.select(user.alias("job_id"), F.when(user % 9 == 0, F.substring(text, 1, 40)).otherwise(text).alias("doc"))


@query("job_documents", sql("""select u as job_id, '1a_extract' || coalesce(',' || array_to_string(steps_completed, ','), '') as steps, u as stream_index, 'café "' || u || '"' as note, 'x_' || u % 3 as field, '[' || u || ',null,1.25]' as value
    from (select distinct user_id as u from events where user_id % 9 <> 0) left join folded on job_id = u""", "folded"))
def job_documents(spark, sf):
    """Steps marked in job documents; what the library doesn't know is read from the changed texts."""
    sound = documents.split_documents(job_texts(spark, sf))[0]
    after = documents.steps_after(sound, fx.step_events(spark, sf), "job_id")
    paths = {"s": ("$.steps_completed", "array<string>"), "stream_index": ("$.probe.streams[0].index", "long"), "note": ("$.note", "string")}
    named = documents.with_paths(after, paths).withColumn("steps", F.array_join("s", ",")).drop("s")
    return documents.unknown_fields(named, ["job_id", "note", "steps_completed", "probe"])


CONTEXT = (("the", "of", 3, 0), ("with", "in the", 0, 2), (None, "and", 1, 1))
CONTEXT_SQL = """, c as (select doc_id, word_index, lower(trim(word, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')) as t from words),
    c2 as (select a.doc_id, a.word_index from c a join c b on a.doc_id = b.doc_id and b.word_index = a.word_index + 1 where a.t = 'in' and b.t = 'the')
    select doc_id, word_index::bigint as word_index, entry from matches m where
        not (entry = 'the' and exists (select 1 from c where t = 'of' and c.doc_id = m.doc_id and m.word_index between c.word_index + 1 and c.word_index + 3))
        and not (entry = 'with' and exists (select 1 from c2 c where c.doc_id = m.doc_id and c.word_index between m.word_index + m.span and m.word_index + m.span + 1))
        and not exists (select 1 from c where t = 'and' and c.doc_id = m.doc_id and (m.word_index = c.word_index + 1 or m.word_index + m.span - 1 = c.word_index - 1))"""


@query("term_context", sql(CONTEXT_SQL, "words", "matches").replace(") , c as", "), c as"))
def term_context(spark, sf):
    rules = spark.createDataFrame(list(CONTEXT), "entry string, near string, before int, after int")
    return bigint(extras.term_context(fx.matches(spark, sf), fx.words(spark, sf), rules)).select("doc_id", "word_index", "entry")


LOOKS = (("the", "stars", None), ("with", "first", None), ("from", "word", "out of"), ("of on", "word", None), ("bleed*", "shout", None))


@query("styled_text", sql("""select doc_id, string_agg(case when style is null then word else word[1:p - 1] || case style when 'word' then coalesce(substitute, '[censored]') when 'stars' then repeat('*', length(core)) when 'first' then core[1] || repeat('*', length(core) - 1) else '[censored]' end || word[p + length(core):] end, ' ' order by word_index) as text
    from (select *, instr(word, core) as p from (select *, trim(word, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~') as core from words)) left join (
        select doc_id, i as word_index, arg_min(coalesce(style, 'tag'), (span > 1)::int * 1000 + line_no) as style, arg_min({'s': substitute}, (span > 1)::int * 1000 + line_no).s as substitute
        from matches left join (values ('the', 'stars', null), ('with', 'first', null), ('from', 'word', 'out of'), ('of on', 'word', null)) v(entry, style, substitute) using (entry), unnest(range(word_index, word_index + span)) t(i) group by doc_id, i) using (doc_id, word_index) group by doc_id""", "words", "matches"))
def styled_text(spark, sf):
    looks = spark.createDataFrame(list(LOOKS), "entry string, style string, substitute string")
    return extras.styled_text(fx.words(spark, sf), fx.kept_matches(spark, sf), looks)
