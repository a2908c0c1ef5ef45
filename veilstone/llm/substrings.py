"""Removal of repeated passages, by super-k-mers of words.

A window is ``k`` consecutive words of one document. Its minimiser is the smallest hash among the
``m``-word grams in it. Consecutive windows with one minimiser form a super-k-mer and travel as one
string to the minimiser's bucket; equal windows have equal minimisers, so they meet there. In a bucket
the window hashes are sorted, equal runs are checked word for word, and each window learns the smallest
document id that holds it. Windows of larger ids come back as word spans, which are cut out.

Texts go to the buckets packed and compressed, each distinct string of a task's batch once with the list
of places it occurs at. A sizing pass comes first: buckets are made for the corpus size, and a bucket
beyond ``HOT`` times the mean (a minimiser that a large share of documents hold) is handled window by window
with an aggregate that combines before the shuffle and a join that Spark splits where it is skewed. Tasks
hold which buckets are hot as a bit for each bucket.

Rows: windows belong to the row they are read from; (doc_id, 64-bit hash of the text) names it on the way,
so rows alike in both lose the same words. Rows with a null id neither lose words nor make others lose
any. Rows that share an id don't affect each other. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, byte_texts, release_memory, save, steady_heap, text_bytes
from .wordhash import BASE, gram_hashes, sliding_min, word_hashes

WORDS, GRAM = 13, 3
BUCKET_BYTES, MOST_BUCKETS, HOT, FLUSH_BYTES = 12_000_000, 1 << 27, 4.0, 16_000_000
GROWTH = 4.0  # bytes of super-k-mers for a byte of text, about
TASK_BYTES, MOST_TASKS = 48_000_000, 200_000
SPANS = "doc_id long, row_hash long, lo int, hi int"


def super_kmers(hashes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window + 1) of each super-k-mer of a document with k words or more."""
    least = sliding_min(gram_hashes(hashes, m), k - m + 1)
    lo = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[lo], lo, np.concatenate([lo[1:], [len(least)]])


def _documents(batches: Iterator[pa.RecordBatch], k: int, m: int, buckets: int):
    """(doc_id, row hash, line, word starts, word ends, bucket, first, last) of every row with windows; a
    line is the row's words joined by one space."""
    steady_heap()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for doc_id, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), byte_texts(part.column(2))):
                line = b" ".join(text.split()) if text and doc_id is not None else b""
                if line.count(b" ") >= k - 1:
                    starts, ends, hashes = word_hashes(line)
                    minimiser, lo, hi = super_kmers(hashes, k, m)
                    bucket = ((minimiser * np.uint64(BASE)) >> np.uint64(20)) % np.uint64(buckets)
                    yield doc_id, row, line, starts, ends, bucket, lo, hi


def bucket_sizes(docs: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """Bytes that each bucket gets: (bucket, bytes)."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for _, _, _, starts, ends, bucket, lo, hi in _documents(batches, k, m, buckets):
            got, at = np.unique(bucket, return_inverse=True)
            for b, n in zip(got.tolist(), np.bincount(at, ends[hi + k - 2] - starts[lo] + 24).tolist()):
                total[b] = total.get(b, 0) + int(n)
            if len(total) > 100_000:
                yield pa.RecordBatch.from_pydict({"bucket": list(total), "bytes": list(total.values())})
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["bucket", "bytes"])
        release_memory()

    return docs.mapInArrow(size, "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))


class Hot:
    """The hot ones of ``buckets``, as a bit each."""

    def __init__(self, found: np.ndarray, buckets: int):
        self.any, self.bits = bool(len(found)), np.zeros(-(-buckets // 8), np.uint8)
        np.bitwise_or.at(self.bits, found >> 3, (1 << (found & 7)).astype(np.uint8))

    def __call__(self, bucket: np.ndarray) -> np.ndarray:
        bucket = bucket.astype(np.int64)
        return (self.bits[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def hot_buckets(docs: DataFrame, k: int, m: int, buckets: int, hot_bytes: float) -> Hot:
    """Buckets of more than ``hot_bytes``. Their numbers reach the driver: no more than the bytes of all
    buckets allow, so ``buckets / HOT`` where the bound is HOT times the mean."""
    found = bucket_sizes(docs, k, m, buckets).filter(F.col("bytes") > hot_bytes).select("bucket").toArrow()
    return Hot(found.column(0).to_numpy(), buckets)


def _packed(docs: DataFrame, k: int, m: int, buckets: int, skip: Broadcast) -> DataFrame:
    """Super-k-mers by bucket: zstd of the distinct strings of a batch, how often each occurs, and the
    places (doc_id, row hash, first word)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, held, size = zstandard.ZstdCompressor(6), {}, 0

        def flush() -> pa.RecordBatch:
            rows: tuple[list, ...] = ([], [], [], [])
            for b, texts in held.items():
                rows[0].append(b)
                rows[1].append(press.compress(b"\n".join(texts)))
                rows[2].append(np.fromiter(map(len, texts.values()), "<i4", len(texts)).tobytes())
                doc, row, first = np.array([p for places in texts.values() for p in places], np.int64).T
                rows[3].append(press.compress(np.diff(doc, prepend=0).astype("<i8").tobytes() + row.astype("<i8").tobytes() + first.astype("<i4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "texts", "counts", "places"])

        for doc_id, row, line, starts, ends, bucket, lo, hi in _documents(batches, k, m, buckets):
            if skip.value.any:
                cold = ~skip.value(bucket)
                bucket, lo, hi = bucket[cold], lo[cold], hi[cold]
            for b, s, e, first in zip(bucket.tolist(), starts[lo].tolist(), ends[hi + k - 2].tolist(), lo.tolist()):
                held.setdefault(b, {}).setdefault(line[s:e], []).append((doc_id, row, first))
                size += e - s + 24
            if size > FLUSH_BYTES:
                yield flush()
                held, size = {}, 0
        yield flush()
        held.clear()
        release_memory()

    return docs.mapInArrow(pack, "bucket long, texts binary, counts binary, places binary")


def _smallest(texts: list[bytes], owner_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of the texts in a row: the smallest document id that holds an equal window. Also
    the first window of each text."""
    counts, hashes, part, size = [], [], [], 0
    for i, text in enumerate(texts):
        part.append(text)
        size += len(text)
        if size > 400_000 or i == len(texts) - 1:
            hashes.append(word_hashes(b"\n".join(part))[2])
            counts += [t.count(b" ") + 1 for t in part]
            part, size = [], 0
    lengths = np.array(counts, np.int64)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.concatenate([[0], np.cumsum(lengths - k + 1)])
    of = np.repeat(np.arange(len(texts)), lengths - k + 1)
    place = np.arange(at[-1]) - at[of]
    window = gram_hashes(np.concatenate(hashes), k)[base[of] + place]
    order = np.argsort(window, kind="stable")
    ranked, owner = window[order], owner_of[of]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.flatnonzero(new)
    out = np.empty(len(window), np.int64)
    out[order] = np.minimum.reduceat(owner[order], begin)[np.cumsum(new) - 1]
    sizes = np.diff(np.concatenate([begin, [len(ranked)]]))
    words: dict[int, list[bytes]] = {}
    for lo, n in zip(begin[sizes > 1].tolist(), sizes[sizes > 1].tolist()):  # equal hashes: are the words equal?
        seen: dict[tuple, list[int]] = {}
        for w in order[lo : lo + n].tolist():
            i, p = int(of[w]), int(place[w])
            if i not in words:
                words[i] = texts[i].split(b" ")
            seen.setdefault(tuple(words[i][p : p + k]), []).append(w)
        if len(seen) > 1:
            for same in seen.values():
                out[same] = owner[same].min()
    return out, at


def _bucket_spans(k: int):
    def spans(t: pa.Table) -> pa.Table:
        steady_heap()
        unpress, known, texts, of, places = zstandard.ZstdDecompressor(), {}, [], [], []
        for packed, counts, where in zip(t.column("texts").to_pylist(), t.column("counts").to_pylist(), t.column("places").to_pylist()):
            local = []
            for text in unpress.decompress(packed).split(b"\n"):
                if (i := known.setdefault(text, len(texts))) == len(texts):
                    texts.append(text)
                local.append(i)
            of.append(np.repeat(np.array(local, np.int64), np.frombuffer(counts, "<i4")))
            raw = unpress.decompress(where)
            n = len(raw) // 20
            columns = (np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<i4", n, 16 * n))
            places.append(np.stack([c.astype(np.int64) for c in columns]))
        known.clear()
        text_of, (doc, row, first) = np.concatenate(of), np.concatenate(places, axis=1)
        owner = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(owner, text_of, doc)
        least, at = _smallest(texts, owner, k)
        # places of which some window has a smaller owner, opened to their windows
        n = np.diff(at)
        any_least = np.minimum.reduceat(least, at[:-1]) if len(texts) else least
        hit = np.flatnonzero(any_least[text_of] < doc)
        found = []
        for part in np.array_split(hit, max(1, len(hit) // 200_000)):
            of_place = np.repeat(part, n[text_of[part]])
            offset = np.arange(len(of_place)) - np.repeat(np.cumsum(n[text_of[part]]) - n[text_of[part]], n[text_of[part]])
            cut = np.flatnonzero(least[at[text_of[of_place]] + offset] < doc[of_place])
            p, o = of_place[cut], offset[cut]
            head = np.concatenate([[True], (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1)]) if len(p) else np.zeros(0, bool)
            lo = np.flatnonzero(head)
            last = np.concatenate([lo[1:], [len(p)]]) - 1 if len(p) else lo
            found.append(np.stack([doc[p[lo]], row[p[lo]], first[p[lo]] + o[lo], first[p[lo]] + o[last] + k]))
        out = np.concatenate(found, axis=1)
        return pa.table({"doc_id": out[0], "row_hash": out[1], "lo": out[2].astype(np.int32), "hi": out[3].astype(np.int32)})

    return spans


def _hot_spans(docs: DataFrame, k: int, m: int, buckets: int, hot: Broadcast) -> DataFrame:
    """The same spans for the hot buckets, a row per window: minimum by window text, joined back."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, ...] = ([], [], [], [])
        names = ["window", "doc_id", "row_hash", "lo"]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
        for doc_id, row, line, _, _, bucket, lo, hi in _documents(batches, k, m, buckets):
            own = hot.value(bucket)
            words = line.split(b" ") if own.any() else []
            for first, last in zip(lo[own].tolist(), hi[own].tolist()):
                for i in range(first, last):
                    for column, value in zip(rows, (b" ".join(words[i : i + k]), doc_id, row, i)):
                        column.append(value)
            if len(rows[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)
                rows = ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    found = docs.mapInArrow(windows, "window binary, doc_id long, row_hash long, lo int")
    least = found.groupBy("window").agg(F.min("doc_id").alias("least"))
    return found.join(least, "window").filter("doc_id > least").select("doc_id", "row_hash", "lo", (F.col("lo") + k).alias("hi"))


def repeated_spans(docs: DataFrame, k: int = WORDS, m: int = GRAM, bucket_bytes: int = BUCKET_BYTES, hot: float = HOT, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """Word spans [lo, hi) of ``docs`` (doc_id, row_hash, text) whose windows also start in a document of
    smaller id. Spans may overlap. A bucket is hot beyond ``hot`` times the mean, or ``bucket_bytes`` if
    that is more, so that the share of hot buckets doesn't depend on the size of the corpus."""
    sc, total = docs.sparkSession.sparkContext, GROWTH * text_bytes(docs)
    buckets = blocks_for(total, bucket_bytes, most_buckets)
    bits = hot_buckets(docs, k, m, buckets, hot * max(bucket_bytes, total / buckets))
    shared = sc.broadcast(bits)  # a bit for each bucket: 16 MB at most
    tasks = max(blocks_for(total, TASK_BYTES, MOST_TASKS), min(buckets, sc.defaultParallelism))
    spans = _packed(docs, k, m, buckets, shared).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_bucket_spans(k), SPANS)
    return spans.unionByName(_hot_spans(docs, k, m, buckets, shared)) if bits.any else spans


def without_repeats(docs: DataFrame, k: int = WORDS, m: int = GRAM, **sizes: float) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) and, for each row, ``n_words``, ``n_removed`` and
    ``kept_text``: the words that no repeated window covers, joined by one space."""
    taken = docs.drop("n_words", "n_removed", "kept_text", "row_hash", "__spans").withColumn("row_hash", F.xxhash64("text"))
    narrow = taken.select(F.col("doc_id").cast("long").alias("doc_id"), "row_hash", "text")
    spans = save(repeated_spans(narrow, k, m, **sizes), "repeated-spans")
    spans = spans.distinct().groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))

    def keep(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        steady_heap()
        rows = []
        for text, found in zip(texts, spans):
            words = (text or "").encode().split()
            n = len(words)
            if found is not None and len(found):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [x["lo"] for x in found], 1)
                np.add.at(edge, [x["hi"] for x in found], -1)
                words = [w for w, x in zip(words, np.cumsum(edge)[:-1].tolist()) if not x]
            rows.append((n, n - len(words), b" ".join(words).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    cut = F.pandas_udf(keep, "n_words long, n_removed long, kept_text string")
    joined = taken.join(spans, ["doc_id", "row_hash"], "left").withColumn("__cut", cut("text", "__spans"))
    return joined.select(*[c for c in taken.columns if c != "row_hash"], "__cut.*")
