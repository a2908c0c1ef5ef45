"""Queries on jobs, integrity, media, progress and scalar formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators import integrity, intervals, ledger, media, progress
from . import fixtures as fx
from .fixtures import sql
from .matching_queries import MATCH, bigint, hms
from .registry import ORACLES, query


@query("fmt_timestamp", f"select event_id, value, {hms('value * 37.03125')} as hms from events")
def fmt_timestamp(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", "value", clock.fmt_timestamp(F.col("value") * 37.03125).alias("hms"))


RAW_TIMES = """case p_partkey % 8 when 0 then p_size || '.25' when 1 then p_size || ':05.5' when 2 then '1:' || p_size || ':30' when 3 then '' when 4 then 'x' || p_size when 5 then '-' || p_size when 6 then p_size || ':' || p_size || ':1e3' else '0:90:' || p_size || '.125' end"""


@query("parse_timestamp", f"""select p_partkey, raw, case p_partkey % 8 when 0 then p_size + 0.25::double when 1 then p_size * 60 + 5.5::double when 2 then 3600 + p_size * 60 + 30.0::double when 7 then 5400 + p_size + 0.125::double end as seconds from (select *, {RAW_TIMES} as raw from part)""")
def parse_timestamp(spark, sf):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    raw = (
        F.when(k == 0, F.concat(size, F.lit(".25"))).when(k == 1, F.concat(size, F.lit(":05.5"))).when(k == 2, F.concat(F.lit("1:"), size, F.lit(":30"))).when(k == 3, F.lit("")).when(k == 4, F.concat(F.lit("x"), size))
        .when(k == 5, F.concat(F.lit("-"), size)).when(k == 6, F.concat(size, F.lit(":"), size, F.lit(":1e3"))).otherwise(F.concat(F.lit("0:90:"), size, F.lit(".125")))
    )
    return fx.table(spark, sf, "part").select("p_partkey", raw.alias("raw")).withColumn("seconds", clock.parse_timestamp(F.col("raw")))


@query("fmt_duration", "select o_orderkey, format('{:02d}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) as duration from (select o_orderkey, trunc(o_totalprice)::bigint as s from orders)")
def fmt_duration(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", clock.fmt_duration(F.col("o_totalprice")).alias("duration"))


@query("fmt_size", """select event_id, case when n < 1024 then format('{} B', n) when n < 1048576 then format('{:.1f} KB', n / 1024.0::double) when n < 1073741824 then format('{:.1f} MB', n / 1048576.0::double) when n < 1099511627776 then format('{:.1f} GB', n / 1073741824.0::double) else format('{:.1f} TB', n / 1099511627776.0::double) end as size
    from (select event_id, ((event_id + 1) * [1, 1024, 1048576, 1073741824, 1099511627776][event_id % 5 + 1])::bigint as n from events)""")
def fmt_size(spark, sf):
    factor = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 1024, 1048576, 1073741824, 1099511627776)]), (F.col("event_id") % 5 + 1).cast("int"))
    return fx.table(spark, sf, "events").select("event_id", text.fmt_size((F.col("event_id") + 1) * factor).alias("size"))


@query("fmt_dir", "select page_id, rtrim(case when page_id % 3 = 0 then url || '//' when page_id % 3 = 1 then '/data/' || page_id else url end, '/') || '/' as dir from pages")
def fmt_dir(spark, sf):
    host = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("//"))).when(F.col("page_id") % 3 == 2, F.col("url"))
    return fx.table(spark, sf, "pages").select("page_id", text.fmt_dir(host, F.concat(F.lit("/data/"), F.col("page_id").cast("string"))).alias("dir"))


@query("offset_clock", """select event_id, strftime(date_trunc('second', ts) + to_seconds(sec), '%Y-%m-%d %H:%M:%S ') || tag as local, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S +0000') as utc from (
    select event_id, ts, [0, 19800, -12600, 0, 0][event_id % 5 + 1] as sec, ['+0000', '+0530', '-0330', '+0000', '+0000'][event_id % 5 + 1] as tag from events)""")
def offset_clock(spark, sf):
    offsets = F.element_at(F.array(F.lit("+00:00"), F.lit("+05:30"), F.lit("-0330"), F.lit("east"), F.lit(None).cast("string")), (F.col("event_id") % 5 + 1).cast("int"))
    return fx.table(spark, sf, "events").select("event_id", clock.offset_clock(F.col("ts"), offsets).alias("local"), clock.offset_clock(F.col("ts"), F.lit(None).cast("string")).alias("utc"))


@query("iso_epoch", "select event_id, case when event_id % 7 <> 0 then epoch(date_trunc('second', ts))::double - case when event_id % 2 = 0 then 7200 else 0 end end as epoch from events")
def iso_epoch(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("yesterday")).otherwise(F.concat(iso, F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("+00:00")))
    return fx.table(spark, sf, "events").select("event_id", clock.iso_epoch(raw).alias("epoch"))


@query("job_id", "select page_id, sha256(url || ':' || (page_id * 1000 + 7))[1:12] as job_id from pages")
def job_id(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.job_id(F.col("url"), (F.col("page_id") * 1000 + 7).cast("string")).alias("job_id"))


@query("slug", """select page_id, case when length(p) <= 32 then p when contains(p[1:33], '-') then regexp_extract(p[1:33], '^(.*)-', 1) else p[1:33] end as slug from (select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as p from pages)""")
def slug(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("edition_name", """select p_partkey, case when p_partkey % 3 = 0 then p_name || '_censored' when p_partkey % 3 = 1 then p_name || ' (19' || (p_size + 10) || ') {edition-Quiet}.sd (2001)' else p_name || ' {edition-Quiet}' end || '.mkv' as name from part""")
def edition_name(spark, sf):
    stem = F.when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" (19"), (F.col("p_size") + 10).cast("string"), F.lit(").sd (2001)"))).otherwise(F.col("p_name"))
    style = F.when(F.col("p_partkey") % 3 == 0, "suffix").otherwise("plex_edition")
    return fx.table(spark, sf, "part").select("p_partkey", text.edition_name(stem, style, F.lit("Quiet"), F.lit("_censored"), F.lit("mkv")).alias("name"))


@query("codec_ext", sql("""select track_id, codec, case codec when 'vorbis' then '.ogg' when 'wmav2' then '.wma' when 'pcm_s16le' then '.wav' when 'pcm_s24le' then '.wav' when 'pcm_s32le' then '.wav' else '.' || codec end as ext from streams""", "streams"))
def codec_ext(spark, sf):
    return fx.streams(spark, sf).select("track_id", "codec", media.codec_ext(F.col("codec")).alias("ext"))


@query("layout_default", sql("""select track_id, case when channels = 0 then 2 else channels end as channels, coalesce(case when channel_layout <> 'unknown' then channel_layout end, case case when channels = 0 then 2 else channels end when 1 then 'mono' when 2 then 'stereo' when 6 then '5.1' when 8 then '7.1' end, 'stereo') as channel_layout, coalesce(sample_rate, 44100) as sample_rate from streams""", "streams"))
def layout_default(spark, sf):
    return media.layout_default(fx.streams(spark, sf)).select("track_id", "channels", "channel_layout", "sample_rate")


@query("safe_int", sql("select track_id, bit_rate, try_cast(bit_rate as bigint) as rate from streams", "streams"))
def safe_int(spark, sf):
    return fx.streams(spark, sf).select("track_id", "bit_rate", text.safe_int(F.col("bit_rate")).alias("rate"))


ENCODER_SQL = """select track_id, codec, case when fb then 'ac3' else enc end as encoder, case when fb then least(coalesce(rate, 640000), 640000) when enc = 'flac' or enc like 'pcm_%' then 0 else coalesce(rate, case enc when 'aac' then 192000 when 'ac3' then 448000 when 'eac3' then 448000 when 'dca' then 1509000 when 'libmp3lame' then 320000 when 'libvorbis' then 192000 when 'libopus' then 128000 else 192000 end) end::bigint as bitrate,
    case when ll then codec || case when profile is not null then ' (' || profile || ')' else '' end || ': no encoder keeps it lossless' when enc is null then 'unknown codec: ' || codec end as fallback_reason
    from (select *, ll or enc is null as fb from (select *, try_cast(bit_rate as bigint) as rate, codec = 'truehd' or (codec = 'dts' and coalesce(profile, '') ilike '%ma%') as ll,
        case codec when 'dts' then 'dca' when 'mp3' then 'libmp3lame' when 'vorbis' then 'libvorbis' when 'opus' then 'libopus' when 'pcm_s24le' then 'pcm_s16le' when 'pcm_s32le' then 'pcm_s16le' when 'truehd' then null when 'xyz' then null else codec end as enc from streams))"""


@query("encoder_plan", sql(ENCODER_SQL, "streams"))
def encoder_plan(spark, sf):
    return media.encoder_plan(fx.streams(spark, sf)).select("track_id", "codec", "encoder", "bitrate", "fallback_reason")


@query("duration_check", sql("select track_id, case when track_id % 5 <> 0 then abs(track_id % 7) > case when track_id % 2 = 0 then 5.0 else 2.0 end end as failed from tracks", "tracks"))
def duration_check(spark, sf):
    t = F.col("total_duration_sec")
    expected = F.when(F.col("track_id") % 5 != 0, t + F.col("track_id") % 7)
    return fx.tracks(spark, sf).select("track_id", integrity.duration_problem(t, expected, F.when(F.col("track_id") % 2 == 0, 5.0).otherwise(2.0)).alias("failed"))


@query("chapter_overrun", sql("""select t.track_id, total_duration_sec, last_chapter, coalesce(last_chapter > total_duration_sec + 2.0, false) as overrun from tracks t left join (select l_partkey as track_id, max(l_quantity * 512.5::double) as last_chapter from lineitem where l_linenumber > 2 group by l_partkey) c using (track_id)""", "tracks"))
def chapter_overrun(spark, sf):
    """Lines from the third on are taken for chapters, so that some parts have none."""
    chapters = fx.table(spark, sf, "lineitem").filter("l_linenumber > 2").select(F.col("l_partkey").alias("track_id"), (F.col("l_quantity").cast("double") * 512.5).alias("chapter_end"))
    return integrity.chapter_overrun(chapters, fx.tracks(spark, sf)).select("track_id", "total_duration_sec", "last_chapter", "overrun")


@query("content_hash", "select page_id, sha256(html) as hash from pages")
def content_hash(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", integrity.content_hash(F.col("html")).alias("hash"))


@query("verify_artifact", """select doc_id, list_filter([case when gone then 'missing' end, case when not gone and doc_id % 3 = 1 and doc_id % 10 > 5 then 'duration' end, case when not gone and doc_id % 4 = 1 and doc_id % 13 <> 0 then 'hash' end], lambda x: x is not null) as problems from (select doc_id, doc_id % 11 = 0 as gone from documents)""")
def verify_artifact(spark, sf):
    """Recorded durations are off by up to 9, 0 for a third of the documents; every 13th can't be hashed now."""
    docs = fx.table(spark, sf, "documents")
    i, n, h = F.col("doc_id"), F.col("n_chars").cast("double"), F.sha2("text", 256)
    duration = F.when(i % 3 == 1, n + i % 10).when(i % 3 == 2, F.lit(0.0))
    recorded = docs.select("doc_id", duration.alias("duration"), F.when(i % 4 == 1, F.lit("0")).when(i % 4 == 2, h).alias("hash"))
    actual = docs.filter("doc_id % 11 <> 0").select("doc_id", n.alias("duration"), F.when(i % 13 != 0, h).alias("hash"))
    return integrity.verify_artifact(recorded, actual, "doc_id")


@query("integrity_chars", "select doc_id, n_chars = length(text) as sound from documents")
def integrity_chars(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") == F.length("text")).alias("sound"))


ETA = """e as (select user_id as job_id, event_id, row_number() over (partition by user_id order by ts, event_id)::int as seg, floor(value) + 60 as dur, floor(value) + 64 as wall, event_id % 6 = 0 as skipped from events),
    f as (select *, sum(dur) over w as done, sum(case when skipped then 0 else dur end) over w as done_run, sum(case when skipped then 0 else wall end) over w as spent, sum(dur) over (partition by job_id) as total from e window w as (partition by job_id order by seg))"""


@query("segment_eta", f"""with {ETA} select job_id, seg, dur * 1.1::double as estimate, case when spent > 0 then done / spent else 0 end as rate_reported, case when spent > 0 then done_run / spent else 0 end as rate_measured,
    case when spent > 0 and done > 0 then greatest(0, total - done) / (done / spent) end as remaining, case when total > 0 then done / total * 100 else 0 end as overall_pct from f""")
def segment_eta(spark, sf, block=None):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    dur = F.floor("value").cast("double")
    runs = fx.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.row_number().over(order).alias("seg"), (dur + 60).alias("dur"), (dur + 64).alias("wall"), (F.col("event_id") % 6 == 0).alias("skipped"))
    return progress.segment_eta(runs, block=block)


@query("progress_fold", f"""with b as (select user_id as job_id, n as seq, (n * 25 % 125)::int as pct, user_id % 4 + 1 as models from (select *, row_number() over (partition by user_id order by ts, event_id)::int as n from events)),
    s as (select *, least(models - 1, seq // 5)::int as model_index from b) select job_id, seq, model_index, pct as last_pct, least(1.0::double, (model_index + pct / 100.0::double) / models) as fraction, least(model_index + 1, models) || '/' || models as label from s""")
def progress_fold(spark, sf, block=None):
    """A log per user: a line that names the number of models (no such line for one), then a bar per event."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n, job = F.row_number().over(order), F.col("user_id").alias("job_id")
    events = fx.table(spark, sf, "events")
    bars = events.select(job, n.alias("seq"), F.format_string(" %d%%|####", n * 25 % 125).alias("line"))
    models = F.col("user_id") % 4 + 1
    heads = events.select("user_id").distinct().filter(models > 1).select(job, F.lit(0).alias("seq"), F.format_string("Selected model is a bag of %d models.", models).alias("line"))
    return progress.progress_fold(bars.unionByName(heads), block=block)


@query("segment_eta_blocks", ORACLES["segment_eta"])
def segment_eta_blocks(spark, sf):
    return segment_eta(spark, sf, block=50)


@query("progress_fold_blocks", ORACLES["progress_fold"])
def progress_fold_blocks(spark, sf):
    return progress_fold(spark, sf, block=50)


@query("ledger_fold", sql("select job_id, steps_completed from folded", "folded"))
def ledger_fold(spark, sf):
    return ledger.ledger_fold(fx.step_events(spark, sf))


@query("ledger_status", sql("""select job_id, case when action = 'error' then 'failed' when action = 'done' and step = '7_mux' then 'complete' else 'running' end as status, case when action = 'error' then step end as failed_step from (select *, row_number() over (partition by job_id order by seq desc) as n from stepev) where n = 1""", "stepev"))
def ledger_status(spark, sf):
    return ledger.ledger_status(fx.step_events(spark, sf))


@query("cascade_steps", sql("select job_id, ord, step from (select job_id, min(ord) as least from stepev join steps using (step) where action = 'undo' group by job_id) j join steps s on s.ord >= j.least", "stepev", "steps"))
def cascade_steps(spark, sf):
    return ledger.cascade_steps(fx.step_events(spark, sf).filter("action = 'undo'").select("job_id", "step"))


@query("correction_cascade", sql("select job_id, ord, step from (select distinct job_id from stepev), steps where ord >= 2", "stepev", "steps"))
def correction_cascade(spark, sf):
    return ledger.correction_cascade(fx.step_events(spark, sf).select("job_id").distinct())


@query("correction_gate", sql("""select job_id, kind, problem from (select r.job_id, r.kind, case when f.job_id is null then 'no_job' when kind = 'correction' and not list_contains(steps_completed, '4b_flag') then 'not_flagged' end as problem
    from (select c_custkey as job_id, case when c_custkey % 2 = 0 then 'correction' else 'redo' end as kind from customer) r left join folded f using (job_id)) where problem is not null""", "folded"))
def correction_gate(spark, sf):
    asked = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 2 == 0, "correction").otherwise("redo").alias("kind"))
    return ledger.correction_gate(asked, ledger.ledger_fold(fx.step_events(spark, sf)))


@query("retention_plan", """select job_id, artifact, keep_intermediates, keep_correction_artifacts, class, case when class = 'record' or keep_intermediates or (class = 'correction' and keep_correction_artifacts) then 'keep' else 'delete' end as plan from (
    select p_partkey as job_id, artifact, p_partkey % 3 = 0 as keep_intermediates, p_partkey % 2 = 0 as keep_correction_artifacts, class from part, (values ('transcript.json', 'record'), ('dialog.wav', 'correction'), ('audio_censored.wav', 'intermediate'), ('other.tmp', 'intermediate')) v(artifact, class))""")
def retention_plan(spark, sf):
    part = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.explode(F.array(*[F.lit(x) for x in ("transcript.json", "dialog.wav", "audio_censored.wav", "other.tmp")])).alias("artifact"), (F.col("p_partkey") % 3 == 0).alias("keep_intermediates"), (F.col("p_partkey") % 2 == 0).alias("keep_correction_artifacts"))
    return ledger.retention_plan(part)


@query("pending_segments", sql("", "tracks").rstrip() + """, segs as (select track_id as job_id, i::int as seg from tracks, unnest(range(0, greatest(1, ceil(total_duration_sec / 1800))::bigint)) t(i)) select job_id, seg from segs where (job_id + seg) % 5 = 0 or (job_id + seg) % 4 = 0""")
def pending_segments(spark, sf):
    segs = intervals.segment_assign(fx.tracks(spark, sf), 1800).select(F.col("track_id").alias("job_id"), F.col("index").alias("seg"))
    k = F.col("job_id") + F.col("seg")
    there = segs.select("job_id", "seg", F.explode(F.array_compact(F.array(F.when(k % 5 != 0, F.lit("dialog.wav")), F.when(k % 4 != 0, F.lit("score.wav"))))).alias("artifact"))
    return ledger.pending_segments(segs, there, ["dialog.wav", "score.wav"])


@query("ledger_find", """select job_id, min(dir) as dir, arg_min(status, dir) as status from (select sha256(p_brand)[1:12] as job_id, p_name || p_partkey as dir, p_type as status from part) where job_id < '8' group by job_id""")
def ledger_find(spark, sf):
    jobs = fx.table(spark, sf, "part").select(F.substring(F.sha2("p_brand", 256), 1, 12).alias("job_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("dir"), F.col("p_type").alias("status"))
    return ledger.ledger_find(jobs, jobs.filter("job_id < '8'"))


@query("required_step_join", sql("""select job_id, artifact, maker, consumer from folded, (values ('dialog.wav', '4b_flag', '5_mute'), ('score_sfx.wav', '4b_flag', '6_recombine'), ('audio_censored.wav', '6_recombine', '6b_encode')) r(artifact, maker, consumer)
    where list_contains(steps_completed, maker) and not list_contains(steps_completed, consumer) and not (job_id % 3 = 0 and artifact = 'dialog.wav')""", "folded"))
def required_step_join(spark, sf):
    folded = ledger.ledger_fold(fx.step_events(spark, sf))
    there = folded.filter("job_id % 3 = 0").select("job_id", F.lit("dialog.wav").alias("artifact"))
    return ledger.required_step_join(folded, there, [("dialog.wav", "4b_flag", "5_mute"), ("score_sfx.wav", "4b_flag", "6_recombine"), ("audio_censored.wav", "6_recombine", "6b_encode")])


@query("ledger_scan", """select dir, job_id, status, steps_completed, corrupt from (select 'j' || user_id as dir, case when user_id % 9 <> 0 then 'job' || user_id end as job_id, case when user_id % 9 <> 0 then 'running' end as status, case when user_id % 9 <> 0 then ['4b_flag'] end as steps_completed, user_id % 9 = 0 as corrupt from (select distinct user_id from events))""")
def ledger_scan(spark, sf):
    u = F.col("user_id").cast("string")
    good = F.concat(F.lit('{"job_id": "job'), u, F.lit('", "status": "running", "steps_completed": ["4b_flag"]}'))
    raw = fx.table(spark, sf, "events").select("user_id").distinct().select(F.concat(F.lit("j"), u).alias("dir"), F.when(F.col("user_id") % 9 == 0, F.lit('{"job_id": ')).otherwise(good).alias("doc"))
    fine, corrupt = ledger.split_jobs(ledger.parse_jobs(raw))
    null = F.lit(None)
    return fine.select("dir", "job_id", "status", "steps_completed", F.lit(False).alias("corrupt")).unionByName(corrupt.select("dir", null.cast("string").alias("job_id"), null.cast("string").alias("status"), null.cast("array<string>").alias("steps_completed"), F.lit(True).alias("corrupt")))


@query("stream_flag", sql("select doc_id, word_index::bigint as word_index, matched_text, entry from single", "single"))
def stream_flag(spark, sf):
    """Words written as files, streamed and matched; the result is read back."""
    import uuid

    from ..sources.sinks import shared_dir
    from ..streaming.flag import flag_stream, stream_words

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    fx.words(spark, sf).write.parquet(f"{folder}/in")
    flag_stream(stream_words(spark, f"{folder}/in"), fx.rule_list(spark), f"{folder}/out", f"{folder}/state")
    found = spark.read.parquet(f"{folder}/out")
    return found.select("doc_id", F.col("word_index").cast("long").alias("word_index"), "matched_text", "entry")


@query("stream_phrases", sql(f"select {MATCH} from phrase", "phrase"))
def stream_phrases(spark, sf):
    """Words written in bands of each document, one band after the other, and streamed a few files at a time:
    phrases that cross bands are found from the words kept as state."""
    import uuid

    from ..sources.sinks import saved, shared_dir
    from ..streaming.flag import phrase_stream, stream_words

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    words = saved(fx.words(spark, sf).withColumn("band", F.floor(F.log2(F.col("word_index") / 64 + 1)).cast("int")), "bands")
    for band in range((words.agg(F.max("band")).first()[0] or 0) + 1):
        words.filter(F.col("band") == band).drop("band").write.parquet(f"{folder}/in/{band}")
    rules = fx.rule_list(spark)
    longest = rules.agg(F.max(F.size("tokens"))).first()[0]
    phrase_stream(stream_words(spark, f"{folder}/in/*", 6), rules, f"{folder}/out", f"{folder}/state", longest)
    return bigint(spark.read.parquet(f"{folder}/out/phrases").drop("batch"))


@query("stream_intervals", sql("select doc_id, interval_start, interval_end from merged", "merged"))
def stream_intervals(spark, sf):
    """Padded intervals written as files, streamed and merged; none is late, since all times may be late by a
    day and more."""
    import uuid

    from ..sources.sinks import shared_dir
    from ..streaming.merge import interval_stream, merged_so_far, stream_spans

    folder = f"{shared_dir(spark)}/spans-{uuid.uuid4().hex}"
    fx.resolved(spark, sf).select("doc_id", "padded_start", "padded_end").write.parquet(f"{folder}/in")
    interval_stream(stream_spans(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state", 100_000.0)
    return merged_so_far(spark, f"{folder}/out").drop("closed")
