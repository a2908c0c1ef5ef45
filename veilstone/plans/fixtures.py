"""Input tables of the registered queries, derived from the given tables, in Spark and as SQL.

Times are multiples of 1/8 second, so both sides hold the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, ledger, matching
from ..sources import lexicon as rules
from ..sources import sinks, transcripts

#: The rule list that the registered matching queries use.
RULES = (
    "with", "=That", "from", "bleed*", "=Ther*", "*schen*", "=*Eau*", "of on", "=In the", "that to", "the", "the the", "with*", "wh*t", "*bad", "**", "la la la*", "# note",
)
CODECS = ("aac", "ac3", "eac3", "dts", "mp3", "flac", "vorbis", "opus", "wmav2", "pcm_s16le", "pcm_s24le", "pcm_s32le", "truehd", "xyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.words_from_text(table(spark, sf_dir, "documents"))


def rule_list(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{r}')" for i, r in enumerate(RULES, 1))
    lines = spark.sql(f"select * from values {rows} as t(line_no, raw)")
    return rules.lexicon_load(lines)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.find_matches(words(spark, sf_dir), rule_list(spark))


def kept_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches, written once through the sink, for queries that need them more than once."""
    return sinks.saved(matches(spark, sf_dir), "matches")


def overrides(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """A skip for every matched word whose index divides by 5; an add for every seventh document."""
    found = matches(spark, sf_dir) if found is None else found
    none = F.lit(None)
    skips = found.filter("word_index % 5 = 0").select("doc_id", "word_index").distinct()
    skips = skips.select(
        "doc_id", F.col("word_index").cast("int").alias("seq"), F.lit("skip").alias("action"), "word_index",
        none.cast("string").alias("text"), none.cast("double").alias("start"), none.cast("double").alias("end"),
    )
    adds = table(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select(
        "doc_id", F.lit(1_000_000).alias("seq"), F.lit("add").alias("action"), none.cast("int").alias("word_index"),
        F.lit("manual").alias("text"), F.lit(10.0).alias("start"), F.lit(12.5).alias("end"),
    )
    return skips.unionByName(adds)


def resolved(spark: SparkSession, sf_dir: str, pad: float = 50.0, found: DataFrame | None = None) -> DataFrame:
    found = kept_matches(spark, sf_dir) if found is None else found
    return intervals.resolve_intervals(found, overrides(spark, sf_dir, found), pad)


def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as 60-second segment transcripts hold them: local times, place in the segment."""
    w = words(spark, sf_dir)
    seg = F.floor(F.col("word_index") / 120).cast("int")
    base = seg * 60.0
    return w.select("doc_id", (seg + 1).alias("segment_index"), base.alias("segment_start_offset"), (F.col("word_index") % 120).alias("pos"), "word", (F.col("start") - base).alias("start"), (F.col("end") - base).alias("end"), "score")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment transcripts as documents with word arrays."""
    w = segment_words(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    word = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word", "start", "end", "score"))), lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    language = F.when(F.col("segment_index") % 3 != 0, F.col("lang")).alias("language")
    return w.groupBy("doc_id", language, "segment_index", "segment_start_offset").agg(word.alias("words"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "event_id", F.expr("timestampdiff(MICROSECOND, timestamp'2024-01-01 00:00:00', cast(ts as timestamp)) / 1e6").alias("t"), "value")


def mute_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 seconds around every error event, merged."""
    raw = samples(spark, sf_dir).join(table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id"), "event_id", "left_semi")
    raw = raw.select("track_id", F.greatest(F.lit(0.0), F.col("t") - 300).alias("padded_start"), (F.col("t") + 300).alias("padded_end"))
    return intervals.merge_intervals(raw, "track_id")


def touching_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 seconds around every error event as they are, and each of their halves once more, so that many
    overlap and the halves touch."""
    spans = samples(spark, sf_dir).join(table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id"), "event_id", "left_semi")
    lo, mid, hi = F.greatest(F.lit(0.0), F.col("t") - 300), F.col("t"), F.col("t") + 300
    halves = F.explode(F.array(F.struct(lo.alias("a"), hi.alias("b")), F.struct(lo.alias("a"), mid.alias("b")), F.struct(mid.alias("a"), hi.alias("b"))))
    return spans.select("track_id", halves.alias("h")).select("track_id", F.col("h.a").alias("interval_start"), F.col("h.b").alias("interval_end"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track per part: its duration from price and size."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_id"), (F.col("p_size") * 512.5).alias("total_duration_sec"))


def segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcription run for each segment, with the seconds that it took; the first has none."""
    seg = segment_words(spark, sf_dir).groupBy("doc_id", "segment_index").agg(F.count("*").alias("n"))
    return seg.filter("segment_index > 1").select("doc_id", "segment_index", (F.col("n") * 0.25 + 0.0625).alias("elapsed_sec"))


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.element_at(F.array(*[F.lit(s) for s in ledger.STEPS]), (F.col("event_id") % 6 + 1).cast("int"))
    action = F.when(F.col("event_type") == "signup", "undo").when(F.col("event_type") == "error", "error").otherwise("done")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.row_number().over(order).alias("seq"), step.alias("step"), action.alias("action"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.element_at(F.array(*[F.lit(c) for c in CODECS]), (F.col("p_partkey") % 14 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"), codec.alias("codec"), F.when((codec == "dts") & (F.col("p_size") % 2 == 0), "DTS-HD MA").alias("profile"),
        F.when(F.col("p_size") % 10 == 0, "N/A").otherwise((F.col("p_retailprice").cast("long") * 1000).cast("string")).alias("bit_rate"), (F.col("p_size") % 9).alias("channels"),
        F.when(F.col("p_size") % 4 == 0, "unknown").when(F.col("p_size") % 4 == 1, "5.1(side)").alias("channel_layout"), F.when(F.col("p_size") % 3 == 0, 48000).alias("sample_rate"),
    )


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule lines from part names, in every notation."""
    name = F.col("p_name")
    first = F.split(name, " ")[0]
    k = F.col("p_partkey") % 14
    raw = (
        F.when(k == 0, F.concat(first, F.lit("*"))).when(k == 1, F.concat(F.lit("*"), first)).when(k == 2, F.concat(F.lit("*"), first, F.lit("*"))).when(k == 3, F.concat(F.lit("="), first))
        .when(k == 4, F.concat(F.lit("=*"), first, F.lit("*"))).when(k == 5, F.concat(F.lit("# "), name)).when(k == 6, F.lit("  ")).when(k == 7, F.lit("**")).when(k == 8, F.concat(name, F.lit("*")))
        .when(k == 9, F.concat(F.lit(" "), name, F.lit(" "))).when(k == 10, F.concat(F.lit("*="), first, F.lit("*"))).when(k == 11, F.lit("=")).when(k == 12, F.concat(F.lit("wh*"), first)).otherwise(first)
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("line_no"), raw.alias("raw"))


# ---- the same tables as SQL common table expressions, by name; each names those it needs

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "words": ((), """select doc_id, i::bigint as word_index, w as word,
        case when i % 37 <> 36 then i * 0.5::double end as "start", case when i % 37 <> 36 then i * 0.5::double + 0.375::double end as "end",
        case when i % 11 <> 10 then (i % 64) / 64.0::double end as score
        from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from
            (select doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n\\f\\x0B]+'), lambda x: x <> '') as ws from documents))"""),
    "lexicon": ((), """select * from (values (1,'with',['with'],'exact',false),(2,'=That',['That'],'exact',true),(3,'from',['from'],'exact',false),(4,'bleed*',['bleed'],'startswith',false),
        (5,'=Ther*',['Ther'],'startswith',true),(6,'*schen*',['schen'],'contains',false),(7,'=*Eau*',['Eau'],'contains',true),(8,'of on',['of','on'],'exact',false),(9,'=In the',['In','the'],'exact',true),
        (10,'that to',['that','to'],'exact',false),(11,'the',['the'],'exact',false),(12,'the the',['the','the'],'exact',false),(13,'with*',['with'],'startswith',false),(14,'wh*t',['wh*t'],'exact',false),
        (17,'la la la*',['la','la','la'],'exact',false)) t(line_no, raw, tokens, match_type, case_sensitive)"""),
    "cand": (("words",), """select * from (select *, trim(word, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~') as token from words where "start" is not null and "end" is not null) where token <> ''"""),
    "toks": (("cand",), "select distinct token from cand"),
    "classes": (("toks", "lexicon"), """select token, line_no, raw, class from (
        select token, line_no, raw, case
            when match_type = 'exact' and not case_sensitive and lower(token) = lower(tokens[1]) then 1
            when match_type = 'exact' and case_sensitive and token = tokens[1] then 2
            when match_type = 'startswith' and (case when case_sensitive then starts_with(token, tokens[1]) else starts_with(lower(token), lower(tokens[1])) end) then 3
            when match_type = 'contains' and (case when case_sensitive then contains(token, tokens[1]) else contains(lower(token), lower(tokens[1])) end) then 4 end as class
        from toks, lexicon where len(tokens) = 1) where class is not null"""),
    "hits": (("classes",), "select token, class, line_no, raw from (select *, row_number() over (partition by token order by class, line_no) as n from classes) where n = 1"),
    "single": (("hits",), """select doc_id, word_index, 1 as span, word as matched_text, raw as entry, line_no, "start", "end", coalesce(score, 0.0::double) as score from cand join hits using (token)"""),
    "phrase": (("cand", "lexicon"), """select doc_id, word_index, span, matched_text, entry, line_no, "start", "end", score from (
        select doc_id, word_index - j as word_index, len(tokens) as span, string_agg(word, ' ' order by j) as matched_text, raw as entry, line_no, arg_min("start", j) as "start", arg_max("end", j) as "end",
            min(coalesce(score, 0.0::double)) as score, count(*) as n
        from cand join (select *, unnest(tokens) as root, generate_subscripts(tokens, 1) - 1 as j from lexicon where len(tokens) > 1)
            on (case when case_sensitive then token = root else lower(token) = lower(root) end)
        group by doc_id, word_index - j, line_no, raw, len(tokens)) where n = span"""),
    "matches": (("single", "phrase"), "select * from single union all select * from phrase"),
    "overrides": (("matches",), """select doc_id, word_index::int as seq, 'skip' as action, word_index, null::varchar as text, null::double as "start", null::double as "end" from (select distinct doc_id, word_index from matches where word_index % 5 = 0)
        union all select doc_id, 1000000, 'add', null, 'manual', 10.0::double, 12.5::double from documents where doc_id % 7 = 0"""),
    "resolved": (("overrides",), """select doc_id, 'matched' as source, matched_text as word, entry, word_index, "start", "end", score, 0 as k1, word_index as k2, (span > 1)::int as k3, line_no as k4 from matches m
            where not exists (select 1 from overrides o where o.action = 'skip' and o.doc_id = m.doc_id and o.word_index = m.word_index)
        union all select doc_id, 'review_add', text, null, word_index, "start", "end", null, 1, seq, 0, 0 from overrides where action = 'add'"""),
    "padded": (("resolved",), """select *, greatest(0.0::double, "start" - {pad}) as padded_start, "end" + {pad} as padded_end from resolved"""),
    "merged": (("padded",), """select doc_id, arg_min(padded_start, n) as interval_start, max(padded_end) as interval_end from (
        select *, sum(fresh) over (partition by doc_id order by n) as island from (
            select *, case when padded_start <= max(padded_end) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from (
                select *, row_number() over (partition by doc_id order by round(padded_start, 4), k1, k2, k3, k4) as n from padded))) group by doc_id, island"""),
    "segwords": (("words",), """select doc_id, (word_index // 120 + 1)::int as segment_index, (word_index // 120) * 60.0::double as segment_start_offset, word_index % 120 as pos, word,
        "start" - (word_index // 120) * 60.0::double as "start", "end" - (word_index // 120) * 60.0::double as "end", score from words"""),
    "samples": ((), "select user_id as track_id, event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 1e6::double as t, value, event_type from events"),
    "spans": (("samples",), """select track_id, min(padded_start) as interval_start, max(padded_end) as interval_end from (
        select *, sum(fresh) over (partition by track_id order by n) as island from (
            select *, case when padded_start <= max(padded_end) over (partition by track_id order by n rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from (
                select track_id, greatest(0.0::double, t - 300) as padded_start, t + 300 as padded_end, row_number() over (partition by track_id order by round(greatest(0.0::double, t - 300), 4), greatest(0.0::double, t - 300), t) as n
                from samples where event_type = 'error'))) group by track_id, island"""),
    "halves": (("samples",), """select track_id, unnest([lo, lo, t]) as interval_start, unnest([hi, t, hi]) as interval_end from (
        select track_id, t, greatest(0.0::double, t - 300) as lo, t + 300 as hi from samples where event_type = 'error')"""),
    "runs": (("segwords",), "select doc_id, segment_index, count(*) * 0.25::double + 0.0625::double as elapsed_sec from segwords group by doc_id, segment_index having segment_index > 1"),
    "tracks": ((), "select p_partkey as track_id, p_size * 512.5::double as total_duration_sec from part"),
    "steps": ((), "select * from (values (0,'4b_flag'),(1,'4b_review'),(2,'5_mute'),(3,'6_recombine'),(4,'6b_encode'),(5,'7_mux')) t(ord, step)"),
    "stepev": ((), """select user_id as job_id, row_number() over (partition by user_id order by ts, event_id)::int as seq, ['4b_flag','4b_review','5_mute','6_recombine','6b_encode','7_mux'][event_id % 6 + 1] as step,
        case event_type when 'signup' then 'undo' when 'error' then 'error' else 'done' end as action from events"""),
    "folded": (("stepev",), """select job_id, list(step order by at_) as steps_completed from (
        select job_id, step, arg_max(action, seq) as last, min(seq) filter (where action = 'done' and seq > coalesce(undone, -1)) as at_ from (
            select *, max(case when action = 'undo' then seq end) over (partition by job_id, step) as undone from stepev where action in ('done', 'undo')) group by job_id, step) where last = 'done' group by job_id"""),
    "streams": ((), """select p_partkey as track_id, codec, case when codec = 'dts' and p_size % 2 = 0 then 'DTS-HD MA' end as profile,
        case when p_size % 10 = 0 then 'N/A' else ((trunc(p_retailprice)::bigint) * 1000)::varchar end as bit_rate, p_size % 9 as channels,
        case p_size % 4 when 0 then 'unknown' when 1 then '5.1(side)' end as channel_layout, case when p_size % 3 = 0 then 48000 end as sample_rate
        from (select *, ['aac','ac3','eac3','dts','mp3','flac','vorbis','opus','wmav2','pcm_s16le','pcm_s24le','pcm_s32le','truehd','xyz'][p_partkey % 14 + 1] as codec from part)"""),
    "lines": ((), """select p_partkey::int as line_no, case p_partkey % 14 when 0 then f || '*' when 1 then '*' || f when 2 then '*' || f || '*' when 3 then '=' || f when 4 then '=*' || f || '*' when 5 then '# ' || p_name
        when 6 then '  ' when 7 then '**' when 8 then p_name || '*' when 9 then ' ' || p_name || ' ' when 10 then '*=' || f || '*' when 11 then '=' when 12 then 'wh*' || f else f end as raw
        from (select *, string_split(p_name, ' ')[1] as f from part)"""),
    "parsed": (("lines",), """select *, len(tokens) > 1 as many from (select *, list_filter(string_split_regex(b, '\\s+'), lambda x: x <> '') as tokens from (
        select line_no, raw, cs, lead, trail, trim(case when trail then b2[:-2] else b2 end) as b from (
            select *, b2 like '%*' as trail from (select *, case when lead then b1[2:] else b1 end as b2 from (
                select *, b1 like '*%' as lead from (select line_no, raw, raw like '=%' as cs, case when raw like '=%' then raw[2:] else raw end as b1 from (
                    select line_no, trim(raw) as raw from lines) where raw <> '' and raw not like '#%'))))))"""),
}


def sql(body: str, *names: str, pad: float = 50.0) -> str:
    """``body`` behind the common table expressions it names, and theirs."""
    seen: dict[str, None] = {}

    def need(name: str) -> None:
        for x in CTES[name][0]:
            need(x)
        seen.setdefault(name)

    for name in names:
        need(name)
    parts = ", ".join(f"{n} as ({CTES[n][1].replace('{pad}', f'{pad / 1000!r}::double')})" for n in seen)
    return (f"with {parts} " if parts else "") + body
