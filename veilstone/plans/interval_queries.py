"""Queries on intervals, overrides and series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import asof, intervals, matching, media, overrides, review, series, stats
from ..sources import keyed, sinks
from . import fixtures as fx
from .fixtures import sql
from .job_queries import ENCODER_SQL
from .matching_queries import MATCH, bigint, decisions, hms, replay_sql
from .registry import ORACLES, query

LOG_SQL = f"""select doc_id, source, word, entry, word_index::bigint as word_index, round("start", 4) as "start", round("end", 4) as "end", score, round(padded_start, 4) as padded_start, round(padded_end, 4) as padded_end,
    row_number() over (partition by doc_id order by round(padded_start, 4), k1, k2, k3, k4)::int as seq,
    {hms('''"start"''')} as start_hms, {hms('''"end"''')} as end_hms, {hms("padded_start")} as padded_start_hms, {hms("padded_end")} as padded_end_hms from padded"""


@query("resolve_intervals", sql('select doc_id, source, word, entry, word_index::bigint as word_index, "start", "end", score, padded_start, padded_end from padded', "padded"))
def resolve_intervals(spark, sf):
    return bigint(fx.resolved(spark, sf)).drop("ord")


@query("censor_log", sql(LOG_SQL, "padded"))
def censor_log(spark, sf):
    return bigint(intervals.censor_log(fx.resolved(spark, sf)))


@query("censor_order", sql("select doc_id, source, word, row_number() over (partition by doc_id order by round(padded_start, 4), k1, k2, k3, k4)::int as seq from padded", "padded", pad=62.5))
def censor_order(spark, sf):
    return intervals.censor_log(fx.resolved(spark, sf, 62.5)).select("doc_id", "source", "word", "seq")


@query("censor_log_sink", sql(f"select *, 1 as one from ({LOG_SQL})", "padded").replace("select *, 1 as one from", "select * from"))
def censor_log_sink(spark, sf):
    folder = sinks.shared_dir(spark)
    log = sinks.bucketed(bigint(intervals.censor_log(fx.resolved(spark, sf))), 16)
    sinks.publish(log, f"{folder}/censor_log_sink", "parquet", ["doc_bucket"])
    return sinks.current(spark, f"{folder}/censor_log_sink").drop("doc_bucket")


@query("merge_intervals", sql("select doc_id, interval_start, interval_end from merged", "merged"))
def merge_intervals(spark, sf):
    return intervals.merge_intervals(fx.resolved(spark, sf))


@query("merge_intervals_blocks", sql("select doc_id, interval_start, interval_end from merged", "merged"))
def merge_intervals_blocks(spark, sf):
    """The same by blocks of 20 seconds, so that a document is many tasks' work."""
    return intervals.merge_intervals(sinks.saved(fx.resolved(spark, sf), "resolved"), block_sec=20.0)


@query("merge_touching", sql("select doc_id, interval_start, interval_end from merged", "merged", pad=62.5))
def merge_touching(spark, sf):
    return intervals.merge_intervals(fx.resolved(spark, sf, 62.5))


@query("mute_expr", sql("select doc_id, string_agg(format('between(t,{:.4f},{:.4f})', interval_start, interval_end), '+' order by interval_start) as mute_expr from merged group by doc_id", "merged", pad=62.5))
def mute_expr(spark, sf):
    return intervals.mute_expr(intervals.merge_intervals(fx.resolved(spark, sf, 62.5)))


@query("skip_antijoin", sql("select doc_id, word_index::bigint as word_index, entry from matches m where not exists (select 1 from overrides o where o.action = 'skip' and o.doc_id = m.doc_id and o.word_index = m.word_index)", "overrides"))
def skip_antijoin(spark, sf):
    found = fx.kept_matches(spark, sf)
    return bigint(overrides.skip_antijoin(found, fx.overrides(spark, sf, found))).select("doc_id", "word_index", "entry")


@query("correction_text", sql("select w.doc_id, w.word_index::bigint as word_index, m.text from words w left join (select doc_id, word_index, arg_max(matched_text, line_no + case when span > 1 then 1000 else 0 end) as text from matches group by doc_id, word_index) m on m.doc_id = w.doc_id and m.word_index = w.word_index", "matches", "words"))
def correction_text(spark, sf):
    """A request for every word."""
    asked = fx.words(spark, sf).select("doc_id", "word_index")
    return bigint(overrides.correction_text(asked, fx.matches(spark, sf)))


def requests(spark, sf):
    docs = fx.table(spark, sf, "documents").filter("doc_id % 3 = 0")
    skips = docs.select("doc_id", F.explode(F.array(F.lit(5), F.lit(11), F.lit(11), F.lit(5000))).alias("word_index")).withColumn("req", F.col("word_index")).withColumn("text", F.lit(None).cast("string"))
    bad = F.when(F.col("doc_id") % 5 == 0, "x:1").otherwise("0:00:12.5")
    adds = docs.select("doc_id", F.lit(1).alias("req"), F.lit("beep").alias("text"), F.format_string("%d.25", F.col("doc_id") % 10).alias("start_raw"), bad.alias("end_raw"))
    return skips, adds


@query("validate_corrections", """select doc_id, req, text, start_raw, end_raw, (doc_id % 10 + 0.25)::double as "start", case when doc_id % 5 <> 0 then 12.5::double end as "end", case when doc_id % 5 = 0 then 'end' end as problem
    from (select doc_id, 1 as req, 'beep' as text, (doc_id % 10) || '.25' as start_raw, case when doc_id % 5 = 0 then 'x:1' else '0:00:12.5' end as end_raw from documents where doc_id % 3 = 0)""")
def validate_corrections(spark, sf):
    return overrides.validate_corrections(requests(spark, sf)[1])


@query("apply_corrections", sql("""select doc_id, seq::int as seq, action, word_index::bigint as word_index, text, "start", "end" from overrides union all
    select doc_id, (coalesce(last, 0) + row_number() over (partition by doc_id order by k, req))::int, action, word_index, text, s, e from (
        select doc_id, 0 as k, w as req, 'skip' as action, w as word_index, null::varchar as text, null::double as s, null::double as e from documents d, (values (5), (11), (5000)) v(w) where doc_id % 3 = 0 and doc_id % 5 <> 0 and not exists (select 1 from overrides o where o.doc_id = d.doc_id and o.action = 'skip' and o.word_index = w)
        union all select doc_id, 1, 1, 'add', null, 'beep', doc_id % 10 + 0.25::double, 12.5::double from documents where doc_id % 3 = 0 and doc_id % 5 <> 0) n
    left join (select doc_id, max(seq) as last from overrides group by doc_id) l using (doc_id)""", "overrides"))
def apply_corrections(spark, sf):
    return bigint(overrides.apply_corrections(fx.overrides(spark, sf), *requests(spark, sf)))


@query("redo_review", sql("""select doc_id, seq, action, word_index::bigint as word_index, text, "start", "end" from overrides where doc_id % 4 <> 0 union all select doc_id, 1, 'add', null, 'manual', 1.0::double, 2.0::double from documents where doc_id % 8 = 0""", "overrides"))
def redo_review(spark, sf):
    docs = fx.table(spark, sf, "documents")
    new = docs.filter("doc_id % 8 = 0").select("doc_id", F.lit(1).alias("seq"), F.lit("add").alias("action"), F.lit(None).cast("int").alias("word_index"), F.lit("manual").alias("text"), F.lit(1.0).alias("start"), F.lit(2.0).alias("end"))
    return bigint(overrides.redo_review(fx.overrides(spark, sf), new, docs.filter("doc_id % 4 = 0").select("doc_id")))


def kept_overrides(spark, sf):
    """The overrides as a bucketed table in a folder of its own."""
    folder = f"{sinks.shared_dir(spark)}/overrides-{uuid.uuid4().hex}"
    keyed.create(fx.overrides(spark, sf), folder, buckets=16)
    return folder


@query("correct_table", ORACLES["apply_corrections"])
def correct_table(spark, sf):
    """A request applied to a kept table, and once more: skips are there already, and no add is asked for."""
    folder = kept_overrides(spark, sf)
    skips, adds = requests(spark, sf)
    overrides.correct_table(spark, folder, skips, adds)
    overrides.correct_table(spark, folder, skips.filter("doc_id % 5 <> 0"), adds.limit(0))
    return bigint(keyed.read(spark, folder))


@query("redo_table", ORACLES["redo_review"])
def redo_table(spark, sf):
    folder, docs = kept_overrides(spark, sf), fx.table(spark, sf, "documents")
    new = docs.filter("doc_id % 8 = 0").select("doc_id", F.lit(1).alias("seq"), F.lit("add").alias("action"), F.lit(None).cast("int").alias("word_index"), F.lit("manual").alias("text"), F.lit(1.0).alias("start"), F.lit(2.0).alias("end"))
    overrides.redo_table(spark, folder, new, docs.filter("doc_id % 4 = 0").select("doc_id"))
    return bigint(keyed.read(spark, folder))


@query("rematch_documents", sql(f"select {MATCH} from matches", "matches"))
def rematch_documents(spark, sf):
    """Kept matches, of which every third document has only those of its first words, matched again for those
    documents: their buckets alone are written."""
    folder = f"{sinks.shared_dir(spark)}/matches-{uuid.uuid4().hex}"
    stale = F.col("doc_id") % 3 == 0
    keyed.create(fx.kept_matches(spark, sf).filter(~stale | (F.col("word_index") < 8)), folder, buckets=16)
    words = fx.words(spark, sf).filter(stale)
    keyed.replace(spark, folder, words.select("doc_id"), matching.find_matches(words, fx.rule_list(spark)))
    return bigint(keyed.read(spark, folder)).select("doc_id", "word_index", "span", "matched_text", "entry", "line_no", "start", "end", "score")


@query("mute_stats", sql("""select doc_id, coalesce(candidates, 0) as candidates, coalesce(skipped, 0) as skipped, coalesce(added, 0) as added, coalesce(muted_intervals, 0) as muted_intervals
    from (select doc_id, count(*) as candidates from matches group by doc_id) full join (select doc_id, count(distinct word_index) filter (where action = 'skip') as skipped, count(*) filter (where action = 'add') as added from overrides group by doc_id) using (doc_id)
    full join (select doc_id, count(*) as muted_intervals from merged group by doc_id) using (doc_id)""", "matches", "overrides", "merged"))
def mute_stats(spark, sf):
    found = fx.kept_matches(spark, sf)
    return stats.mute_stats(found, fx.overrides(spark, sf, found), intervals.merge_intervals(fx.resolved(spark, sf, found=found)))


RUN_SUMMARY = f"""select s.doc_id, segments, word_count, coalesce(c.candidates, 0) as candidates, coalesce(approved, 0) as approved, coalesce(rejected, 0) as rejected, coalesce(auto_approved, 0) as auto_approved,
    coalesce(skipped, 0) as skipped, coalesce(added, 0) as added, coalesce(muted_intervals, 0) as muted_intervals, strftime(j.a, '%Y-%m-%d %H:%M:%S +0000') as started, strftime(j.b, '%Y-%m-%d %H:%M:%S +0000') as finished,
    round(total_duration_sec, 1) as duration_sec, format('{{:02d}}:{{:02d}}:{{:02d}}', d // 3600, d // 60 % 60, d % 60) as duration, encoder, bitrate, fallback_reason, 'mute' as method, 50.0::double as padding_ms
    from (select doc_id, count(distinct segment_index) as segments, count(*) as word_count from segwords group by doc_id) s left join (select doc_id, count(*) as candidates from matches group by doc_id) c using (doc_id)
    left join (select doc_id, count(*) filter (where outcome = 'approved') as approved, count(*) filter (where outcome = 'rejected') as rejected, count(*) filter (where outcome = 'auto_approved') as auto_approved from r group by doc_id) v using (doc_id)
    left join (select doc_id, count(distinct word_index) filter (where action = 'skip') as skipped, count(*) filter (where action = 'add') as added from overrides group by doc_id) o using (doc_id)
    left join (select doc_id, count(*) as muted_intervals from merged group by doc_id) i using (doc_id)
    left join (select p_partkey as doc_id, total_duration_sec, trunc(total_duration_sec)::bigint as d, timestamp '2024-01-01 00:00:00' + to_seconds(p_partkey * 61) as a, timestamp '2024-01-01 00:00:00' + to_seconds(p_partkey * 61 + d) as b from part join tracks on track_id = p_partkey) j using (doc_id)
    left join ({ENCODER_SQL}) e on e.track_id = s.doc_id"""


def jobs(spark, sf):
    """A job for each track, taken for the document of the same number: it starts 61 seconds after the one
    before, and takes as long as its track."""
    t = fx.tracks(spark, sf).withColumn("at", F.col("track_id") * 61)
    clock = lambda s: F.timestamp_seconds(F.lit(1704067200) + s)
    ends = F.col("at") + F.col("total_duration_sec").cast("long")
    return t.select(F.col("track_id").alias("doc_id"), clock(F.col("at")).alias("started_at"), clock(ends).alias("finished_at"), "total_duration_sec")


@query("run_summary", replay_sql(RUN_SUMMARY, "segwords", "overrides", "merged", "streams", "tracks"))
def run_summary(spark, sf):
    found = fx.kept_matches(spark, sf)
    merged = intervals.merge_intervals(fx.resolved(spark, sf, found=found))
    outcomes = review.replay_decisions(found, decisions(found), 0.75)
    reviewed = review.review_summary(outcomes, fx.table(spark, sf, "documents").filter("doc_id % 7 = 0").select("doc_id"))
    streams = media.encoder_plan(fx.streams(spark, sf)).withColumnRenamed("track_id", "doc_id")
    words = fx.segment_words(spark, sf)
    mute = stats.mute_stats(found, fx.overrides(spark, sf, found), merged)
    return stats.run_summary(stats.merge_stats(words), stats.flag_stats(words, found), reviewed, mute, streams, jobs(spark, sf), "mute", 50.0)


@query("interval_cover", sql("select s.track_id, event_id, t, value, exists (select 1 from spans i where i.track_id = s.track_id and t between interval_start and interval_end) as covered from samples s", "samples", "spans"))
def interval_cover(spark, sf):
    return intervals.interval_cover(fx.samples(spark, sf), fx.mute_spans(spark, sf), "track_id")


@query("cover_touching", sql("select s.track_id, event_id, t, value, exists (select 1 from halves i where i.track_id = s.track_id and t between interval_start and interval_end) as covered from samples s", "samples", "halves"))
def cover_touching(spark, sf):
    return intervals.interval_cover(fx.samples(spark, sf), fx.touching_spans(spark, sf), "track_id")


@query("mute_touching", sql("select s.track_id, event_id, t, case when exists (select 1 from halves i where i.track_id = s.track_id and t between round(interval_start, 4) and round(interval_end, 4)) then 0.0::double else value end as value from samples s", "samples", "halves"))
def mute_touching(spark, sf):
    return series.mute_series(fx.samples(spark, sf), fx.touching_spans(spark, sf))


@query("mute_series", sql("select s.track_id, event_id, t, case when exists (select 1 from spans i where i.track_id = s.track_id and t between round(interval_start, 4) and round(interval_end, 4)) then 0.0::double else value end as value from samples s", "samples", "spans"))
def mute_series(spark, sf):
    return series.mute_series(fx.samples(spark, sf), fx.mute_spans(spark, sf))


def int_series(spark, sf, kind):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = fx.table(spark, sf, "events").filter(F.col("event_type").isin(*kind))
    return rows.select(F.col("user_id").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (F.col("event_id") % 5000 * 13 - 32000).alias("value"))


INT_SERIES = "select user_id as track_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, event_id % 5000 * 13 - 32000 as value from events where event_type in "


@query("mix_series", f"select a.track_id, a.idx, greatest(-32768, least(32767, a.value + coalesce(b.value, 0))) as value from ({INT_SERIES} ('click', 'view')) a left join ({INT_SERIES} ('purchase', 'signup')) b on a.track_id = b.track_id and a.idx = b.idx")
def mix_series(spark, sf):
    return series.mix_series(int_series(spark, sf, ("click", "view")), int_series(spark, sf, ("purchase", "signup")), ["track_id", "idx"])


@query("mix_join", f"select a.track_id, a.idx, a.value, b.value as other from ({INT_SERIES} ('click', 'view')) a left join ({INT_SERIES} ('purchase')) b on a.track_id = b.track_id and a.idx = b.idx")
def mix_join(spark, sf):
    return series.mix_join(int_series(spark, sf, ("click", "view")), int_series(spark, sf, ("purchase",)), ["track_id", "idx"])


@query("method_guard", "select event_type, count(*) as n, case when event_type = 'error' then 'mute' else 'beep' end as method from events group by event_type")
def method_guard(spark, sf):
    """Tracks with an interval ask for mute, the others for a method that isn't known: there it passes."""
    made = series.method_guard(F.when(F.col("event_type") == "error", "mute").otherwise("beep"), F.col("event_type") == "error")
    return fx.table(spark, sf, "events").withColumn("method", made).groupBy("event_type", "method").agg(F.count("*").alias("n"))


@query("segment_series", f"select track_id, idx // 7 as segment, idx % 7 as pos, value from ({INT_SERIES} ('click', 'view'))")
def segment_series(spark, sf):
    return series.split_series(int_series(spark, sf, ("click", "view")), 7).select("track_id", "segment", "pos", "value")


@query("concat_series", f"select track_id, idx, value from ({INT_SERIES} ('click', 'view'))")
def concat_series(spark, sf):
    return series.concat_series(series.split_series(int_series(spark, sf, ("click", "view")), 7)).select("track_id", "idx", "value")


SEGMENTS = """segs as (select track_id, i::int as "index", i * 1800.0::double as start_sec, least(i * 1800.0::double + 1800, total_duration_sec) as end_sec, total_duration_sec from tracks, unnest(range(0, greatest(1, ceil(total_duration_sec / 1800))::bigint)) t(i))"""


@query("segment_assign", sql("", "tracks").rstrip() + f""", {SEGMENTS} select track_id, "index", start_sec, end_sec, total_duration_sec from segs""")
def segment_assign(spark, sf):
    return intervals.segment_assign(fx.tracks(spark, sf), 1800)


@query("segment_durations", sql("", "tracks").rstrip() + f""", {SEGMENTS} select track_id, "index", start_sec, end_sec - start_sec as duration_sec from segs""")
def segment_durations(spark, sf):
    return intervals.segment_durations(intervals.segment_assign(fx.tracks(spark, sf), 1800).drop("end_sec")).select("track_id", "index", "start_sec", "duration_sec")


@query("tile_of", sql("select s.track_id, event_id, t, least(floor(t / 1800)::int, (n - 1)::int) as tile from samples s join (select track_id, greatest(1, ceil(total_duration_sec / 1800))::bigint as n, total_duration_sec from tracks) using (track_id)", "samples", "tracks"))
def tile_of(spark, sf):
    """The tile of each sample in the track of its number; samples beyond the end are in the last."""
    both = fx.samples(spark, sf).join(fx.tracks(spark, sf), "track_id")
    return both.select("track_id", "event_id", "t", intervals.tile_of(F.col("t"), F.col("total_duration_sec"), 1800).alias("tile"))


@query("adds_on_words", sql("""select a.doc_id, a.req, a."start", w.word_index::bigint as on_index, w.word as on_word, coalesce(a."start" < w."end", false) as sounding
    from (select doc_id, i as req, doc_id % 10 + i * 7.5::double + 0.25 as "start" from documents, unnest(range(0, 4)) t(i)) a
    asof left join words w on a."start" >= w."start" and w.doc_id = a.doc_id""", "words"))
def adds_on_words(spark, sf):
    """Four adds a document, with the word that each falls on."""
    adds = fx.table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("req"))
    adds = adds.withColumn("start", F.col("doc_id") % 10 + F.col("req") * 7.5 + 0.25)
    return asof.adds_on_words(adds, fx.words(spark, sf)).withColumn("on_index", F.col("on_index").cast("long"))


@query("asof_events", """select e.event_id, e.user_id, v.view_id from events e
    asof left join (select user_id, ts, max(event_id) as view_id from events where event_type = 'view' group by user_id, ts) v on v.user_id = e.user_id and e.ts >= v.ts""")
def asof_events(spark, sf):
    """Every event with its user's last view up to then, by blocks of a day."""
    events = fx.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    views = events.filter("event_type = 'view'")
    return asof.asof(events, views, "user_id", "ts", "ts", {"view_id": "event_id"}, "event_id", block_sec=86400.0).select("event_id", "user_id", "view_id")
