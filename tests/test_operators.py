"""Golden micro-cases, rules that are easy to get wrong, and properties."""

import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilstone.functions import clock, text
from veilstone.operators import extras, integrity, intervals, ledger, matching, media, overrides, progress, review, series, sieve, stats
from veilstone.plans import fixtures, matching_queries
from veilstone.sources import lexicon, sinks, transcripts


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("s,want", [(0.0, "0:00:00.000"), (75.5, "0:01:15.500"), (5280.267, "1:28:00.267"), (59.9996, "0:01:00.000"), (-3.0, "0:00:00.000"), (0.0005, "0:00:00.000"), (0.0025, "0:00:00.002"), (7.0625, "0:00:07.062")])
def test_fmt_timestamp(spark, s, want):
    assert one(spark, clock.fmt_timestamp(F.col("s")), s=s) == want


@pytest.mark.parametrize("t,want", [("1203.14", 1203.14), ("20:03", 1203.0), ("0:20:03.140", 1203.14), ("1:90:00", 9000.0), ("", None), ("x", None), ("-3", None), ("1:2:3:4", None), ("1e3", None), ("1:inf", None), ("1.5:00", None)])
def test_parse_timestamp(spark, t, want):
    got = one(spark, clock.parse_timestamp(F.col("t")), t=t)
    assert got == want if want is None else abs(got - want) < 1e-9


@pytest.mark.parametrize("s,want", [(0.0, "00:00:00"), (90.0, "00:01:30"), (3661.0, "01:01:01"), (7389.9, "02:03:09")])
def test_fmt_duration(spark, s, want):
    assert one(spark, clock.fmt_duration(F.col("s")), s=s) == want


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536 * 1024, "1.5 MB"), (5 * 1024**4, "5.0 TB")])
def test_fmt_size(spark, n, want):
    assert one(spark, text.fmt_size(F.col("n")), n=n) == want


@pytest.mark.parametrize("stem,want", [("Movie (1986).sd.hevc", "Movie (1986) {edition-Quiet}.sd.hevc.mkv"), ("movie", "movie {edition-Quiet}.mkv"), ("A (1999) (2001)", "A (1999) {edition-Quiet} (2001).mkv")])
def test_edition_name(spark, stem, want):
    assert one(spark, text.edition_name(F.col("s"), F.lit("plex_edition"), F.lit("Quiet"), F.lit("_censored"), F.lit("mkv")), s=stem) == want
    assert one(spark, text.edition_name(F.col("s"), F.lit("suffix"), F.lit("Quiet"), F.lit("_censored"), F.lit("mkv")), s=stem) == stem + "_censored.mkv"


def test_unknown_style_and_method_are_errors(spark):
    with pytest.raises(Exception, match="unknown naming style"):
        one(spark, text.edition_name(F.col("s"), F.lit("zip"), F.lit("H"), F.lit("c"), F.lit("mkv")), s="a")
    with pytest.raises(Exception, match="unknown censor method"):
        one(spark, series.method_guard(F.col("m"), F.lit(True)), m="beep")
    assert one(spark, series.method_guard(F.col("m"), F.lit(False)), m="beep") == "beep"


@pytest.mark.parametrize("stem", ["The Big Film", "a" * 40, "x-" * 20, "Some very long title that goes on and on", "!!"])
def test_slug(spark, stem):
    got = one(spark, text.slug(F.col("s")), s=stem)
    plain = "".join(c if c in string.ascii_lowercase + string.digits else "-" for c in stem.lower())
    while "--" in plain:
        plain = plain.replace("--", "-")
    plain = plain.strip("-")
    want = plain if len(plain) <= 32 else plain[:33].rsplit("-", 1)[0]
    assert got == want


def test_rule_notation(spark):
    raws = ["heck", "=Dick", "damn*", "*crap*", "=*Eau*", "*bad", "**", "=", "*", " go to hell ", "la la*", "# note", "", "wh*t", "*=x*", "=*x*", "wtf!", "#tag"]
    lines = spark.createDataFrame(list(enumerate(raws, 1)), "line_no int, raw string")
    got = {r.raw: (r.tokens, r.match_type, r.case_sensitive) for r in lexicon.lexicon_load(lines).collect()}
    assert got == {
        "heck": (["heck"], "exact", False), "=Dick": (["Dick"], "exact", True), "damn*": (["damn"], "startswith", False), "*crap*": (["crap"], "contains", False), "=*Eau*": (["Eau"], "contains", True),
        "go to hell": (["go", "to", "hell"], "exact", False), "la la*": (["la", "la"], "exact", False), "wh*t": (["wh*t"], "exact", False), "*=x*": (["=x"], "contains", False), "=*x*": (["x"], "contains", True), "wtf!": (["wtf!"], "exact", False),
    }
    assert {r.raw: r.reason for r in lexicon.lexicon_rejects(lines).collect()} == {"*bad": "leading_star", "**": "empty", "=": "empty", "*": "empty", "la la*": "phrase_star"}


def words_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, word_index int, word string, start double, end double, score double")


def said(spark, line, untimed=()):
    return words_of(spark, [(1, i, w, None if i in untimed else i / 2, None if i in untimed else i / 2 + 0.375, 0.5) for i, w in enumerate(line.split())])


def rules_of(spark, *raws):
    return lexicon.lexicon_load(spark.createDataFrame(list(enumerate(raws, 1)), "line_no int, raw string"))


def test_class_precedence_beats_line_order(spark):
    got = matching.first_hit(said(spark, "Damn, damned DAMN goddamn"), rules_of(spark, "*amn*", "damn*", "=DAMN", "damn")).collect()
    assert {(r.word_index, r.entry) for r in got} == {(0, "damn"), (1, "damn*"), (2, "damn"), (3, "*amn*")}


def test_phrases_overlap_and_gaps_break_them(spark):
    got = matching.phrase_matches(said(spark, "the the the ... the the", untimed=(5,)), rules_of(spark, "the the", "the the")).collect()
    assert sorted((r.word_index, r.line_no) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_skip_takes_every_match_of_its_word_but_not_a_phrase_around_it(spark):
    m = matching.find_matches(said(spark, "pissed off go to hell"), rules_of(spark, "piss*", "pissed off", "hell", "go to hell"))
    skips = spark.createDataFrame([(1, 1, "skip", 0), (1, 2, "skip", 4)], "doc_id long, seq int, action string, word_index int")
    assert [r.entry for r in overrides.skip_antijoin(m, skips).collect()] == ["go to hell"]


def test_golden_counts(spark, sf_dir):
    """Counts of an independent plain matcher on the smallest tables."""
    m = fixtures.matches(spark, sf_dir)
    by = dict(m.groupBy("entry").count().collect())
    want = {"the": 3141, "with": 354, "from": 208, "=That": 42, "bleed*": 17, "=Ther*": 35, "*schen*": 35, "=*Eau*": 10, "with*": 14, "of on": 13, "=In the": 2, "that to": 16, "the the": 250, "la la la*": 62}
    assert by == want
    assert m.select("doc_id").distinct().count() == 146
    plain = m.select("doc_id", F.greatest(F.lit(0.0), F.col("start") - 0.05).alias("padded_start"), (F.col("end") + 0.05).alias("padded_end"))
    assert intervals.merge_intervals(plain).count() == 3636
    wide = m.select("doc_id", F.greatest(F.lit(0.0), F.col("start") - 0.0625).alias("padded_start"), (F.col("end") + 0.0625).alias("padded_end"))
    assert intervals.merge_intervals(wide).count() == 3520


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(0, 12)), min_size=1, max_size=30))
def test_merged_intervals_are_disjoint_with_the_same_cover(spark, spans):
    df = spark.createDataFrame([(k, s / 2, (s + n) / 2) for k, s, n in spans], "doc_id long, padded_start double, padded_end double")
    got = [(r.doc_id, r.interval_start, r.interval_end) for r in intervals.merge_intervals(df).collect()]
    for k in {s[0] for s in spans}:
        own = sorted(g[1:] for g in got if g[0] == k)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
        want = []
        for s, e in sorted((s / 2, (s + n) / 2) for x, s, n in spans if x == k):
            if want and s <= want[-1][1]:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        assert own == [tuple(x) for x in want]


def test_reversed_words_are_left_out_of_the_merge(spark):
    df = spark.createDataFrame([(1, 5.0, 4.0), (1, 1.0, 2.0)], "doc_id long, padded_start double, padded_end double")
    assert [(r.interval_start, r.interval_end) for r in intervals.merge_intervals(df).collect()] == [(1.0, 2.0)]


@pytest.mark.parametrize("total,size,want", [(7112.0, 1800, [1800.0, 1800.0, 1800.0, 1712.0]), (100.0, 0, [100.0]), (100.0, 100, [100.0]), (0.0, 60, [0.0])])
def test_tiles(spark, total, size, want):
    tiles = intervals.segment_assign(spark.createDataFrame([(1, total)], "track_id long, total_duration_sec double"), size)
    assert [r.duration_sec for r in intervals.segment_durations(tiles).orderBy("index").collect()] == want


def test_segments_joined_again_are_the_series(spark):
    rows = spark.range(50).select(F.lit(1).alias("track_id"), F.col("id").alias("idx"), (F.col("id") * 3).alias("value"))
    got = series.concat_series(series.split_series(rows, 7)).orderBy("idx").select("idx", "value").collect()
    assert [(r.idx, r.value) for r in got] == [(i, 3 * i) for i in range(50)]


def test_cover_has_both_ends(spark):
    points = spark.createDataFrame([(1, x) for x in (0.9, 1.0, 2.0, 2.1, 700.0)], "track_id long, t double")
    spans = spark.createDataFrame([(1, 1.0, 2.0), (1, 650.0, 1300.0)], "track_id long, interval_start double, interval_end double")
    assert [r.covered for r in intervals.interval_cover(points, spans, "track_id").orderBy("t").collect()] == [False, True, True, False, True]


def test_a_point_has_one_row_where_intervals_touch(spark):
    points = spark.createDataFrame([(1, x, "p", 7.0) for x in (1.0, 0.75, 0.7500000001, 9.0)] + [(None, 1.0, "p", 7.0), (1, None, "p", 7.0)], "track_id long, t double, __bucket string, value double")
    spans = spark.createDataFrame([(1, 0.5, 1.00001), (1, 1.00002, 2.0), (1, 0.5, 0.75), (1, 0.75, 1.0), (1, None, 5.0), (None, 0.0, 9.0)], "track_id long, interval_start double, interval_end double")
    got = intervals.interval_cover(points, spans, "track_id").collect()
    assert sorted((r.t, r.covered) for r in got if r.track_id and r.t) == [(0.75, True), (0.7500000001, True), (1.0, True), (9.0, False)]
    assert len(got) == 6 and not any(r.covered for r in got if not r.track_id or r.t is None) and all(r.__getitem__("__bucket") == "p" for r in got)
    muted = series.mute_series(points, spans, "track_id").collect()
    assert len(muted) == 6 and sorted(r.value for r in muted) == [0.0, 0.0, 0.0, 7.0, 7.0, 7.0]
    tight = spark.createDataFrame([(1, 0.5, 1.00001), (1, 1.00002, 2.0)], "track_id long, interval_start double, interval_end double")
    assert series.mute_series(points.filter("t = 1.0 and track_id = 1"), tight).count() == 1


def test_empty_tables_give_empty_results(spark):
    w, rules = said(spark, "a b"), rules_of(spark, "a", "a b", "b*")
    none = w.limit(0)
    assert matching.find_matches(none, rules).count() == 0 and matching.find_matches(w, rules.limit(0)).count() == 0
    m = matching.find_matches(w, rules)
    assert review.with_context(m.limit(0), w, 2).count() == 0
    assert [r.context for r in review.with_context(m.limit(1), none, 2).collect()] == [None]
    queries = spark.createDataFrame([(1, "a b"), (2, ""), (3, "A  B"), (4, None)], "query_id long, query string")
    assert {r.query_id for r in matching.phrase_search(w, queries).collect()} == {1, 3}
    assert matching.phrase_search(none, queries).count() == 0 and matching.phrase_search(w, queries.limit(0)).count() == 0
    spans = spark.createDataFrame([(1, 0.0, 1.0)], "doc_id long, padded_start double, padded_end double")
    assert intervals.merge_intervals(spans.limit(0)).count() == 0
    points = spark.createDataFrame([(1, 0.5)], "doc_id long, t double")
    merged = intervals.merge_intervals(spans)
    assert [r.covered for r in intervals.interval_cover(points, merged.limit(0), "doc_id").collect()] == [False]
    assert intervals.interval_cover(points.limit(0), merged, "doc_id").count() == 0
    events = spark.createDataFrame([(1, 1, "5_mute", "done")], "job_id long, seq int, step string, action string")
    assert ledger.ledger_fold(events.limit(0)).count() == 0 and ledger.ledger_status(events.limit(0)).count() == 0
    cues = spark.createDataFrame([(1, 0, 0.0, 3.0, "a b")], "doc_id long, cue long, cue_start double, cue_end double, cue_text string")
    assert [r.heard for r in extras.srt_diff(none, cues).collect()] == [""] and extras.srt_diff(w, cues.limit(0)).count() == 0
    assert [r.cue for r in extras.srt_align(m, cues.limit(0), w).collect()] == [None] * m.count()


def test_columns_of_other_names_do_not_disturb(spark):
    names = ("at", "token", "key", "ordinal", "__b", "class", "hit", "anchor", "part")
    w = said(spark, "a b a c")
    more = w.withColumns({c: F.lit("z") for c in names})
    rules = rules_of(spark, "a", "a b", "c*")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(matching.find_matches(more, rules)) == rows(matching.find_matches(w, rules))
    m = matching.find_matches(w, rules)
    wide = review.with_context(m.withColumns({c: F.lit("z") for c in ("at", "block", "lo", "part", "context")}), more, 1)
    assert rows(wide.select(*m.columns, "context")) == rows(review.with_context(m, w, 1))
    queries = spark.createDataFrame([(1, "a b")], "query_id long, query string").withColumn("text", F.lit(0))
    assert [r.context for r in matching.phrase_search(more, queries, 1).collect()] == ["...a b a..."]


def test_substitutes_and_fallback(spark):
    w = said(spark, "Heck, darn the darn cat")
    m = matching.find_matches(w, rules_of(spark, "heck", "darn", "the darn", "cat"))
    subs = spark.createDataFrame([("heck", "hey"), ("the darn", "[both]")], "entry string, substitute string")
    assert extras.substitute_text(w, m, subs).first().text == "hey [censored] [both] [censored] [censored]"
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, "HECK! darn,  they said"), (1, 1, 1.0, 9.0, "nothing"), (2, 0, 0.0, 9.0, "heck")], "doc_id long, cue long, cue_start double, cue_end double, cue_text string")
    got = {(r.doc_id, r.cue): r.new_text for r in extras.substitute_cues(cues, m, subs, "***").collect()}
    assert got == {(1, 0): "hey *** they said", (1, 1): "nothing", (2, 0): "heck"}


def test_series_as_long_as_the_first(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "track_id long, idx long, value long")
    b = spark.createDataFrame([(1, 0, 7), (1, 9, 1)], "track_id long, idx long, value long")
    assert [(r.idx, r.value, r.other) for r in series.mix_join(a, b, ["track_id", "idx"]).orderBy("idx").collect()] == [(0, 5, 7), (1, 6, None)]


def test_run_times_are_rounded_in_totals(spark):
    w = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, "d")], "doc_id long, segment_index int, word string")
    runs = spark.createDataFrame([(1, 1, 1.23), (1, 2, 2.24), (3, 1, 0.06)], "doc_id long, segment_index int, elapsed_sec double")
    got = {(r.doc_id, r.segment_index): (r.word_count, r.elapsed_sec) for r in stats.transcribe_stats(w, runs).collect()}
    assert got == {(1, 1): (2, 1.2), (1, 2): (1, 2.2), (1, None): (3, 3.5), (2, 1): (1, None), (2, None): (1, None), (3, 1): (0, 0.1), (3, None): (0, 0.1), (None, None): (4, 3.5)}


def test_a_folder_that_executors_share_is_asked_for(spark):
    class Conf:
        get = staticmethod(lambda *a: None)
        set = staticmethod(lambda *a: None)

    class Cluster:
        conf = Conf
        master = "spark://host:7077"
        sparkContext = property(lambda self: self)
        getConf = staticmethod(lambda: Conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sinks.shared_dir(Cluster())
    assert sinks.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")


def test_corrections_are_idempotent_for_skips_and_all_or_nothing(spark):
    none = "doc_id long, seq int, action string, word_index int, text string, start double, end double"
    skips = spark.createDataFrame([(1, 5, 1, "x"), (1, 5, 2, "x"), (2, 7, 1, None)], "doc_id long, word_index int, req int, text string")
    adds = spark.createDataFrame([(1, 1, "beep", "1.0", "0:02"), (2, 1, "beep", "9", "3")], "doc_id long, req int, text string, start_raw string, end_raw string")
    once = overrides.apply_corrections(spark.createDataFrame([], none), skips, adds)
    assert [(r.doc_id, r.seq, r.action, r.word_index) for r in once.orderBy("doc_id", "seq").collect()] == [(1, 1, "skip", 5), (1, 2, "add", None)]
    twice = overrides.apply_corrections(once, skips, adds.limit(0))
    assert twice.filter("doc_id = 1 and action = 'skip'").count() == 1


def test_review_replay(spark):
    m = matching.find_matches(said(spark, "a x x x x x"), rules_of(spark, "x"))
    say = lambda *d: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(d)], "doc_id long, ordinal int, decision string")
    run = lambda d, c=0.0: [r.outcome for r in review.replay_decisions(m, d, c).orderBy("ordinal").collect()]
    assert run(say("Y", "N", "S", "N", "N")) == ["approved", "rejected", "approved", "approved", "approved"]
    assert run(say("Y", "N", "Q")) == []
    assert run(say("N", "N", "N", "N", "N"), 0.4) == ["auto_approved"] * 5
    assert run(say("N", "N", "N", "N", "N"), 0.5) == ["rejected"] * 5
    assert [r.word_index for r in review.review_overrides(review.replay_decisions(m, say("N", "Y", "N"))).orderBy("seq").collect()] == [1, 3]


def test_context_is_clipped(spark):
    w = said(spark, "a b c d e")
    m = spark.createDataFrame([(1, 0, 1), (1, 3, 2)], "doc_id long, word_index int, span int")
    assert [r.context for r in review.with_context(m, w, 2).orderBy("word_index").collect()] == ["...a b c...", "...b c d e..."]


def test_ledger_order_after_undo(spark):
    e = [(1, 1, "5_mute", "done"), (1, 2, "4b_flag", "done"), (1, 3, "5_mute", "undo"), (1, 4, "5_mute", "done"), (1, 5, "4b_flag", "done"), (2, 1, "5_mute", "done"), (2, 2, "5_mute", "undo")]
    got = ledger.ledger_fold(spark.createDataFrame(e, "job_id long, seq int, step string, action string")).collect()
    assert [(r.job_id, r.steps_completed) for r in got] == [(1, ["4b_flag", "5_mute"])]


def test_encoder_plan_rules(spark):
    rows = [("truehd", None, "5000000"), ("dts", "DTS-HD MA", "N/A"), ("dts", "DTS", None), ("flac", None, "900000"), ("pcm_s24le", None, None), ("AAC", None, "0"), ("weird", None, "1000")]
    got = media.encoder_plan(spark.createDataFrame(rows, "codec string, profile string, bit_rate string")).collect()
    assert [(r.encoder, r.bitrate, r.fallback_reason is None) for r in got] == [("ac3", 640000, False), ("ac3", 640000, False), ("dca", 1509000, True), ("flac", 0, True), ("pcm_s16le", 0, True), ("aac", 192000, True), ("ac3", 1000, False)]


def test_verify_lists_all_problems(spark):
    r = spark.createDataFrame([("a", 10.0, "h"), ("b", None, "h"), ("c", 10.0, None), ("d", 1.0, "z"), ("e", 0.0, "h"), ("f", 10.0, "h")], "k string, duration double, hash string")
    a = spark.createDataFrame([("a", 20.0, "g"), ("b", 1.0, None), ("c", 15.0, None), ("e", 99.0, "h"), ("f", None, "h")], "k string, duration double, hash string")
    got = dict(integrity.verify_artifact(r.withColumn("there", F.lit(1)), a, "k").collect())
    # content that can't be read now (b) and a recorded duration of 0 (e) are no problems
    assert got == {"a": ["duration", "hash"], "b": [], "c": [], "d": ["missing"], "e": [], "f": ["duration"]}


def test_progress_needs_the_next_zero(spark):
    lines = [" 0%|", " 50%|", "100%|", "100%|", "  0%|", "noise", "100%|", "100%|"]
    bag = [(1, -1, "Selected model is a bag of 2 models. You will see that many progress bars")]
    got = progress.progress_fold(spark.createDataFrame(bag + [(1, i, x) for i, x in enumerate(lines)], "job_id long, seq int, line string")).orderBy("seq").collect()
    assert [(r.model_index, r.fraction, r.label) for r in got] == [(0, 0.0, "1/2"), (0, 0.25, "1/2"), (0, 0.5, "1/2"), (0, 0.5, "1/2"), (1, 0.5, "2/2"), (1, 1.0, "2/2"), (1, 1.0, "2/2")]


def test_mix_is_clamped(spark):
    a = spark.createDataFrame([(1, 0, 30000), (1, 1, -30000), (1, 2, 5)], "track_id long, idx long, value long")
    b = spark.createDataFrame([(1, 0, 9000), (1, 1, -9000), (1, 9, 1)], "track_id long, idx long, value long")
    assert [r.value for r in series.mix_series(a, b, ["track_id", "idx"]).orderBy("idx").collect()] == [32767, -32768, 5]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_subtitles_match_plain_python(spark):
    w = said(spark, "Ünder the bridge downtown is where I drew some blood I could not get enough of it", untimed=(4,))
    cues = matching_queries  # the registered queries build their cues from the documents
    rows = [(1, 0, 0.0, 3.0, "Under the bridge downtown is where"), (1, 1, 3.0, 6.0, "quite another line"), (1, 2, 6.0, 9.0, "get enough of it")]
    df = spark.createDataFrame(rows, "doc_id long, cue long, cue_start double, cue_end double, cue_text string")
    heard = {0: "Ünder the bridge downtown where", 1: "I drew some blood I could", 2: "not get enough of it"}
    for r in extras.srt_diff(w, df).collect():
        assert r.heard == heard[r.cue]
        a, b = r.cue_text.lower(), heard[r.cue].lower()
        assert abs(r.similarity - round((1 - edit(a, b) / max(len(a), len(b))) * 100, 4)) < 1e-3
    m = matching.find_matches(w, rules_of(spark, "blood", "enough", "bridge"))
    align = lambda **how: {r.entry: (r.cue, r.aligned_start) for r in extras.srt_align(m, df, w, 80.0, **how).collect()}
    assert align() == {"blood": (None, 4.5), "enough": (2, 7.0), "bridge": (0, 1.0)} and cues  # a cue only confirms
    assert align(strategy="srt_primary") == {"blood": (None, 4.5), "enough": (2, 6.0), "bridge": (0, 0.0)}
    assert align(strategy="highest_confidence") == align(strategy="srt_primary")  # all scores are 0.5
    sure = w.withColumn("score", F.lit(0.99))
    m = matching.find_matches(sure, rules_of(spark, "blood", "enough", "bridge"))
    assert align(strategy="highest_confidence")["enough"] == (2, 7.0)
    with pytest.raises(ValueError, match="unknown strategy"):
        extras.srt_align(m, df, w, strategy="guess")
    by = lambda mode, sure: {r.cue: (r.action, r.new_text == heard[r.cue]) for r in extras.srt_correct(w, df, mode, 80.0, sure).collect()}
    assert by("report", 0.1) == {0: ("keep", False), 1: ("review", False), 2: ("keep", False)}
    assert by("auto", 0.1)[1] == by("hybrid", 0.1)[1] == ("correct", True)
    assert by("auto", 0.9)[1] == ("keep", False) and by("hybrid", 0.9)[1] == ("review", False)
    with pytest.raises(ValueError, match="unknown mode"):
        extras.srt_correct(w, df, "guess")


def test_sinks_and_sources_round_trip(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("doc_id"))
    sinks.publish(df, str(tmp_path / "t"))
    sinks.publish(df.filter("doc_id < 2"), str(tmp_path / "t"), "json")
    assert sinks.current(spark, str(tmp_path / "t")).count() == 2
    assert sinks.bucketed(df, 4).select("doc_bucket").distinct().count() <= 4
    (tmp_path / "rules.txt").write_text("a\n\n# b\r\nc*\n")
    assert [(r.line_no, r.raw) for r in lexicon.lexicon_load(lexicon.rule_lines(spark, str(tmp_path / "rules.txt"))).orderBy("line_no").collect()] == [(1, "a"), (4, "c*")]
    (tmp_path / "seg").mkdir()
    (tmp_path / "seg" / "s1.json").write_text('{"language": "de", "segment_index": 1, "segment_start_offset": 0.0, "words": [{"word": "a", "start": 0.1, "end": 0.2}, {"word": ""}]}')
    (tmp_path / "seg" / "s2.json").write_text('{"segment_index": 2, "segment_start_offset": 60.0, "words": [{"word": "b", "start": 0.1, "end": null, "score": 0.5}]}')
    seg = transcripts.read_transcripts(spark, str(tmp_path / "seg")).withColumn("doc_id", F.lit(1))
    got = transcripts.rebase_merge(transcripts.words_from_segments(seg)).orderBy("word_index").collect()
    assert [(r.word_index, r.word, r.start, r.end) for r in got] == [(0, "a", 0.1, 0.2), (1, "b", 60.1, None)]
    assert transcripts.doc_language(seg).first().language == "de"
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "a.json").write_text('{"job_id": "a", "status": "running", "steps_completed": ["4b_flag"]}')
    (tmp_path / "jobs" / "b.json").write_text('{"job_id": ')
    fine, corrupt = ledger.scan_jobs(spark, str(tmp_path / "jobs"))
    assert [r.job_id for r in fine.collect()] == ["a"] and corrupt.count() == 1


def test_stream_gives_the_batch_result_once(spark, tmp_path):
    from veilstone.streaming.flag import flag_stream, stream_words

    rules = rules_of(spark, "x", "y*")
    said(spark, "a x yes").write.parquet(str(tmp_path / "in"))
    args = (rules, str(tmp_path / "out"), str(tmp_path / "state"))
    flag_stream(stream_words(spark, str(tmp_path / "in")), *args)
    said(spark, "x x").withColumn("doc_id", F.lit(2).cast("long")).write.mode("append").parquet(str(tmp_path / "in"))
    flag_stream(stream_words(spark, str(tmp_path / "in")), *args)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "word_index", "entry").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "x"), (1, 2, "y*"), (2, 0, "x"), (2, 1, "x")]


def test_pending_segments_are_merged_and_compared_by_all_artifacts(spark):
    segs = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 2), (2, 0), (None, 0)], "job_id long, seg int")
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 1, "a"), (1, 1, "a"), (1, 1, "z"), (2, 0, None), (None, 0, "a"), (None, 0, "b")]
    there = spark.createDataFrame(rows, "job_id long, seg int, artifact string")
    found = ledger.pending_segments(segs, there, ["a", "b"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 1), (1, 2), (2, 0), (None, 0)], key=str)
    assert ledger.pending_segments(segs, there, []).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_a_sieve_loses_no_row_that_a_join_would_keep(spark):
    df = spark.range(20000).select(F.col("id"), F.concat(F.lit("t"), "id").alias("h"), F.lit(1).alias("at"))
    known = df.filter("id % 50 = 0").select(F.col("id").cast("int").alias("id"), "h")
    got = sieve.sifted(df, known, "id", "h")
    assert got.columns == df.columns and got.join(known, ["id", "h"]).count() == 400 and 400 <= got.count() < 420
    assert sieve.sifted(df, known.limit(0), "id").count() == 0


def test_runs_and_words_are_sifted_before_they_are_shuffled(spark):
    words = spark.range(4).select(F.col("id").alias("doc_id"), F.posexplode(F.split(F.lit("a b c d " * 200), " ")).alias("word_index", "word"))
    words = words.filter("word <> ''").select("*", F.col("word_index").cast("double").alias("start"))
    asked = spark.createDataFrame([(1, "a b"), (2, "b c x")], "query_id long, query string")
    found = matching.phrase_search(words, asked, 1)
    assert found.count() == 800 and {r.context for r in found.select("context").distinct().collect()} == {"...d a b c...", "...a b c..."}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sieve" in plan and "LeftSemi" not in plan  # what no span asks for isn't shuffled to a join


@pytest.mark.parametrize("width", [30.0, 7.0, 1.0])
def test_words_of_cues_that_lie_in_one_or_several_blocks(spark, width):
    said = [(d, i, f"w{i}" if i % 9 else None, None if i % 7 == 3 else (i * 5 % 31) * 2.0, i / 8 if i % 4 else None) for d in (1, 2) for i in range(31)]
    words = spark.createDataFrame(said, "doc_id long, word_index int, word string, start double, score double")
    spans = [(1, 0, 0.0, 30.0), (1, 1, 29.0, 30.5), (1, 2, 10.0, 60.0), (1, 3, 5.0, 5.0), (1, 4, 9.0, 2.0), (1, 5, None, 3.0), (2, 0, 30.0, 60.0), (2, 1, 0.0, 61.0), (3, 0, 0.0, 9.0)]
    cues = spark.createDataFrame([(*x, "t") for x in spans], "doc_id long, cue long, cue_start double, cue_end double, cue_text string")
    got = {(r.doc_id, r.cue): (r.heard, r.confidence) for r in extras.cue_texts(words, cues, width).collect()}
    for d, cue, lo, hi in spans:
        inside = [x for x in said if x[0] == d and x[3] is not None and lo is not None and lo <= x[3] < hi]
        want = " ".join(x[2] for x in inside if x[2]), sum(x[4] or 0.0 for x in inside) / len(inside) if inside else 0.0
        assert got[d, cue] == (want[0], pytest.approx(want[1])), (d, cue)


def test_texts_with_marks_need_no_join_of_words(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (1, 2, "c"), (None, 1, "n"), (2, 1, "x")]
    words = spark.createDataFrame(rows, "doc_id long, word_index int, word string")
    found = spark.createDataFrame([(1, 1, 1, "r", 1), (None, 1, 1, "r", 1), (2, 5, 1, "r", 1)], "doc_id long, word_index long, span int, entry string, line_no int")
    out = extras.redact_text(words, found)
    assert dict(map(tuple, out.collect())) == {1: "a [redacted] [redacted] c", None: "n", 2: "x"}
    subs = spark.createDataFrame([("r", "s")], "entry string, substitute string")
    assert dict(map(tuple, extras.substitute_text(words, found, subs).collect())) == {1: "a s s c", None: "n", 2: "x"}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_cues_are_cut_from_the_text_without_a_shuffle(spark, sf_dir):
    plan = matching_queries.cues(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
