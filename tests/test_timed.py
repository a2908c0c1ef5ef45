"""Subtitle files, scans of one key over many tasks, and phrases in streams."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from veilstone.operators import alignment, intervals, matching, progress, scans, worddiff
from veilstone.sources import lexicon, sinks, subtitles, transcripts
from veilstone.streaming.flag import phrase_stream, stream_words

CUE = "doc_id long, cue long, cue_start double, cue_end double, cue_text string"


def write(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def test_cues_written_and_read_again_are_the_same(spark, tmp_path):
    rows = [(1, 1, 0.0, 1.5, "Hello,\nyou"), (1, 2, 1.5, 3661.001, " <i>two</i> "), (1, 3, 359999.999, 360000.0, ""), (2, 7, 0.04, 0.5, "é ☃ 5"), (2, 8, 1.0, 1.0, "12\n13")]
    for end in ("\n", "\r\n"):
        folder = f"{tmp_path}/out{len(end)}"
        subtitles.write_srt(spark.createDataFrame(rows[::-1], CUE), folder, line_end=end)
        for how in ("\n", "\r\n"):  # the other line ends are read as well
            got = subtitles.srt_cues(subtitles.read_srt(spark, folder, how)).select("doc_id", "cue", "cue_start", "cue_end", "cue_text").collect()
            assert sorted(map(tuple, got)) == rows
        files = [f for _, _, names in os.walk(folder) for f in names if f.startswith("part-")]
        assert len(files) == 2  # one for each document
    text = open(next(os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/out1") for f in names if "doc_id=1" in d and f.startswith("part-"))).read()
    assert text.startswith("1\n00:00:00,000 --> 00:00:01,500\nHello,\nyou\n\n2\n00:00:01,500 --> 01:01:01,001\n <i>two</i> \n\n")


def test_blank_lines_inside_a_text_do_not_end_the_cue(spark, tmp_path):
    subtitles.write_srt(spark.createDataFrame([(1, 1, 0.0, 1.0, "a\n\n \n\r\nb\r\n"), (1, 2, 1.0, 2.0, None)], CUE), f"{tmp_path}/x")
    read = subtitles.read_srt(spark, f"{tmp_path}/x")
    assert [(r.cue, r.cue_text, r.problem) for r in read.orderBy("cue").collect()] == [(1, "a\nb", None), (2, "", None)]


def test_faulty_cues_are_rejected_with_a_reason(spark, tmp_path):
    blocks = [b"\xef\xbb\xbf1\n00:00:01,000 --> 00:00:02,000 X1:40 Y1:5\nfine", b"x\n00:00:01,000 --> 00:00:02,000\nno number", b"3\n00:00:01 -> 00:00:02\nno time", b"4", b"5\n0:61:00,000 --> 1:00:00,000\nminutes", b"6\n00:00:03,000 --> 00:00:02,999\nback", b"7\n1:00:00.5 --> 1:00:01.25\nshort decimals"]
    write(tmp_path, "a.srt", b"\n\n".join(blocks) + b"\n\n\n\n")
    write(tmp_path, "b.srt", b"1\r\n00:00:00,000 --> 00:00:01,000\r\nwindows\r\n \t\r\n2\r\n00:00:01,000 --> 00:00:02,000\r\nlines")
    write(tmp_path, "c.srt", b"")
    read = subtitles.read_srt(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("file", "/"), -1))
    good = sorted((r.name, r.cue, r.cue_start, r.cue_end, r.cue_text) for r in subtitles.srt_cues(read).collect())
    assert good == [("a.srt", 1, 1.0, 2.0, "fine"), ("a.srt", 7, 3600.5, 3601.25, "short decimals"), ("b.srt", 1, 0.0, 1.0, "windows"), ("b.srt", 2, 1.0, 2.0, "lines")]
    bad = subtitles.srt_rejects(read).orderBy("place").collect()
    assert [r.problem for r in bad] == ["number", "time", "time", "time", "order"] and bad[0].block.endswith("no number")


def test_cues_that_cross_read_blocks_stay_whole(spark, tmp_path):
    rows = [(9, i, i * 1.0, i + 0.5, f"line {i} " + "word " * (i % 9)) for i in range(3000)]
    subtitles.write_srt(spark.createDataFrame(rows, CUE), f"{tmp_path}/big")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = subtitles.read_srt(spark, f"{tmp_path}/big")
        assert read.rdd.getNumPartitions() > 10
        assert [r.cue for r in read.orderBy("place").collect()] == list(range(3000)) and read.filter("problem is not null").count() == 0
        assert {r.cue_text.strip() for r in read.collect()} == {r[4].strip() for r in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_one_key_merged_in_blocks_is_the_same(spark, seed):
    r = random.Random(seed)
    rows = [("k", s, s + r.choice([0.0, 0.25, 1.0, 40.0, 0.00001]), i) for i, s in enumerate(r.choice([x / 8, x / 8 + 0.00002]) for x in (r.randrange(80000) for _ in range(900)))]
    df = sinks.saved(spark.createDataFrame([*rows, ("j", 3.0, None, 0), ("j", 5.0, 4.0, 1), (None, 1.0, 2.0, 2), (None, 2.0, 3.0, 3)], "doc_id string, padded_start double, padded_end double, ord int"), "spans")
    whole = sorted(map(tuple, intervals.merge_intervals(df).collect()), key=str)
    assert sorted(map(tuple, intervals.merge_intervals(df, block_sec=70.0).collect()), key=str) == whole and len(whole) > 20
    assert sorted(map(tuple, intervals.merge_intervals(df.drop("ord"), block_sec=9.0).collect()), key=str) == sorted(map(tuple, intervals.merge_intervals(df.drop("ord")).collect()), key=str)
    assert (None, 1.0, 3.0) in [tuple(x) for x in intervals.merge_intervals(df, block_sec=1.5).collect()]


def test_running_sums_and_maxima_over_blocks(spark):
    rows = [(i % 2, i, (i * 37) % 11 - 5 if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, v int").withColumn("b", F.floor(F.col("i") / 9))
    for upto in (0, -1):
        args = {"s": (F.col("v"), "sum"), "m": (F.col("v"), "max")}
        one = sorted(map(tuple, scans.running(df, "k", [F.col("i")], None, upto, **args).select("i", "s", "m").collect()))
        many = sorted(map(tuple, scans.running(df, "k", [F.col("i")], "b", upto, **args).select("i", "s", "m").collect()))
        assert one == many
        for i, s, m in one:
            before = [v for k, j, v in rows if k == i % 2 and (j <= i if upto == 0 else j < i) and v is not None]
            assert s == sum(before) and m == (max(before) if before else None)


def test_words_of_one_document_are_numbered_by_segments(spark):
    rows = [(1, s, s * 10.0, p, f"w{s}-{p}", 0.5, 0.75, None) for s in range(1, 30) for p in range(s % 5)]
    words = spark.createDataFrame(rows, "doc_id long, segment_index int, segment_start_offset double, pos int, word string, start double, end double, score double")
    got = transcripts.rebase_merge(words.repartition(7)).orderBy("word_index").collect()
    assert [(r.word_index, r.word, r.start) for r in got] == [(i, r[4], r[2] + 0.5) for i, r in enumerate(rows)]


def test_progress_and_estimates_in_blocks_are_the_same(spark):
    lines = [("j", 0, "a bag of 3 models")] + [("j", i, f" {i * 25 % 125}%|#") for i in range(1, 90)] + [("i", 5, "x"), ("i", 6, "50%|")]
    df = spark.createDataFrame(lines, "job_id string, seq int, line string")
    assert sorted(map(tuple, progress.progress_fold(df).collect())) == sorted(map(tuple, progress.progress_fold(df, block=7).collect()))
    runs = spark.createDataFrame([("j", i, 60.0 + i % 4, 64.0 + i % 3, i % 5 == 0) for i in range(60)], "job_id string, seg int, dur double, wall double, skipped boolean")
    assert sorted(map(tuple, progress.segment_eta(runs).collect())) == sorted(map(tuple, progress.segment_eta(runs, block=8).collect()))


def words_of(texts):
    return [(d, i, w, i * 0.5, i * 0.5 + 0.25, 0.5) for d, t in texts.items() for i, w in enumerate(t.split())]


def test_streamed_phrases_equal_the_batch_also_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    texts = {d: " ".join(r.choice(["a", "b", "c", "the"]) for _ in range(60)) for d in range(8)}
    lines = spark.createDataFrame(list(enumerate(["a b", "the the", "a b c", "c c c c"], 1)), "line_no int, raw string")
    rules, kind = lexicon.lexicon_load(lines), "doc_id long, word_index int, word string, start double, end double, score double"
    rows = words_of(texts)
    want = sorted((x.doc_id, x.word_index, x.entry) for x in matching.phrase_matches(spark.createDataFrame(rows, kind), rules).collect())
    cuts = [0, 1, 2, 3, 17, 18, 40, 60]

    def go():
        phrase_stream(stream_words(spark, f"{tmp_path}/in/*", 1), rules, f"{tmp_path}/out", f"{tmp_path}/state", 4)

    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame([x for x in rows if lo <= x[1] < hi], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        if n in (2, 4):
            go()  # stops when all files are read, and starts anew from its checkpoint
    go()
    got = sorted((x.doc_id, x.word_index, x.entry) for x in spark.read.parquet(f"{tmp_path}/out/phrases").collect())
    assert got == want and any(x[2] == "c c c c" for x in want)
    again = len(got)
    go()
    assert spark.read.parquet(f"{tmp_path}/out/phrases").count() == again


def test_long_phrases_and_long_documents(spark):
    r = random.Random(5)
    text = [r.choice("abcd") for _ in range(1500)]
    words = spark.createDataFrame(words_of({1: " ".join(text), 2: " ".join(text[400:900])}), "doc_id long, word_index int, word string, start double, end double, score double")
    asked = {n: " ".join(text[i : i + n]) for i, n in ((500, 40), (250, 5), (255, 16), (509, 17), (0, 1500), (800, 3))}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    got = sorted((x.query_id, x.doc_id, x.word_index) for x in matching.phrase_search(words, queries, 2).collect())
    docs = {1: text, 2: text[400:900]}
    want = sorted((n, d, i) for n, q in asked.items() for d, t in docs.items() for i in range(len(t) - n + 1) if t[i : i + n] == q.split())
    assert got == want


def test_the_name_of_a_saved_table_is_new_each_time(spark):
    assert sinks.saved(spark.range(3), f"t-{uuid.uuid4().hex}").count() == 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_word_edits_are_the_fewest_and_turn_one_text_into_the_other(seed):
    r = random.Random(seed)
    for _ in range(150):
        a = [r.choice("abcde") for _ in range(r.randrange(25))]
        b = [x for x in a if r.random() > 0.2] if r.random() < 0.5 else [r.choice("abcde") for _ in range(r.randrange(25))]
        ops, i, j, made = worddiff.edits(a, b), 0, 0, []
        for op in ops:
            assert (op == "keep") == (op in ("keep", "replace") and a[i] == b[j])
            made += [] if op == "delete" else [b[j]]
            i, j = i + (op != "insert"), j + (op != "delete")
        assert made == b and i == len(a) and sum(op != "keep" for op in ops) == distance(a, b)
    assert worddiff.edits(list("ab"), list("axb")) == ["keep", "insert", "keep"] and worddiff.edits([], []) == []


def test_word_operations_of_cues(spark):
    said = [(1, i, w, 0.5 * i, 0.5 * i + 0.25, 0.5) for i, w in enumerate("The quick, brown fox jumps over it".split())]
    words = spark.createDataFrame(said, "doc_id long, word_index int, word string, start double, end double, score double")
    rows = [(1, 1, 0.0, 2.0, "the quick red fox", "mine"), (1, 2, 2.0, 4.0, "jumps it", "mine"), (1, 3, 4.0, 5.0, "gone", "mine"), (1, 4, 5.0, 6.0, None, "mine"), (2, 1, 0.0, 1.0, "x", "mine")]
    cues = spark.createDataFrame(rows, f"{CUE}, a string")
    ops = worddiff.word_diff(words, cues)
    got = [tuple(x) for x in ops.orderBy("doc_id", "cue", "pos").collect()]
    assert got == [
        (1, 1, 0, "keep", "the", "The"), (1, 1, 1, "keep", "quick", "quick,"), (1, 1, 2, "replace", "red", "brown"), (1, 1, 3, "keep", "fox", "fox"),
        (1, 2, 0, "keep", "jumps", "jumps"), (1, 2, 1, "insert", None, "over"), (1, 2, 2, "keep", "it", "it"), (1, 3, 0, "delete", "gone", None), (2, 1, 0, "delete", "x", None),
    ]
    new = {(x.doc_id, x.cue): x.new_text for x in worddiff.corrected_text(ops, ["replace", "insert"]).collect()}
    assert new == {(1, 1): "the quick brown fox", (1, 2): "jumps over it", (1, 3): "gone", (2, 1): "x"}
    assert worddiff.word_diff(words, cues.limit(0)).count() == 0


def test_longest_chains():
    r = random.Random(9)
    for _ in range(300):
        x = [r.randrange(12) for _ in range(r.randrange(10))]
        got = alignment.longest_chain(x)
        chosen = [[v for i, v in enumerate(x) if m >> i & 1] for m in range(1 << len(x))]
        most = max(len(c) for c in chosen if all(p < q for p, q in zip(c, c[1:])))
        assert len(got) == most and all(a < b and x[a] < x[b] for a, b in zip(got, got[1:]))


def test_cues_on_a_shifted_or_drifting_clock_get_their_times_back(spark):
    r = random.Random(4)
    text = {d: [f"w{r.randrange(400)}" for _ in range(240)] for d in (1, 2, 3)} | {4: ["la"] * 24}
    text[3][100:140] = text[3][140:180]  # repeated words give no anchors
    words = spark.createDataFrame(words_of({d: " ".join(t) for d, t in text.items()}), "doc_id long, word_index int, word string, start double, end double, score double")
    moved = {1: lambda t: t + 40, 2: lambda t: t * 1.02 + 5, 3: lambda t: t - 7.5 if t < 60 else t + 12.25, 4: lambda t: t + 1}
    rows = [(d, k, moved[d](k * 6.0), moved[d](k * 6.0 + 5.999), " ".join(t[k * 12 : k * 12 + 12]), k * 6.0) for d, t in text.items() for k in range(len(t) // 12)]
    cues = spark.createDataFrame([*rows, (None, 0, 1.0, 2.0, "x", 0.0), (1, 99, None, None, None, 0.0)], f"{CUE}, a double")
    got = alignment.realign_cues(words, cues).filter("doc_id is not null and cue <> 99").collect()
    assert len(got) == len(rows) and {x.doc_id for x in got if not x.anchored} == {4}
    for x in got:
        near = 0.02 if x.doc_id in (1, 2) else 1.5 if x.doc_id == 3 else 1.01
        if not (x.doc_id == 3 and 54 <= x.a <= 66):
            assert abs(x.cue_start - x.a) <= near, x


def test_subtitle_files_are_written_by_the_tasks_with_the_folders_of_spark(spark, tmp_path, monkeypatch):
    names = ["a b", "a/b:c%", "=", None, "é"]
    rows = [(n, c, c * 1.0, c + 0.5, f"{n} {c}") for n in names for c in (1, 0)]
    cues = spark.createDataFrame(rows, CUE.replace("doc_id long", "doc_id string"))
    subtitles.write_srt(cues, f"{tmp_path}/own")
    subtitles.write_srt(cues, f"{tmp_path}/own")  # again, in its place
    held = lambda top: {os.path.basename(d): open(f"{d}/{f}", "rb").read() for d, _, fs in os.walk(top) for f in fs if f.startswith("part-")}
    assert not any(f.startswith(".") for _, _, fs in os.walk(f"{tmp_path}/own/doc_id=é") for f in fs)
    monkeypatch.setattr(subtitles.versions, "local_path", lambda *_: None)
    subtitles.write_srt(cues, f"{tmp_path}/theirs")
    assert held(f"{tmp_path}/own") == held(f"{tmp_path}/theirs") and len(held(f"{tmp_path}/own")) == 5
