"""Order MinHash: document fingerprints whose likeness follows edit distance.

Every byte of a text ends a k-mer of eight bytes (the first seven reach into zeros before the text), and a
k-mer counts together with its occurrence number, the number of equal ones before it. For each of 64 random
orders the two smallest of these are selected, put back into text order, and the tuple of their k-mers is
hashed to 16 bits. Moved passages change the order inside tuples, so the share of equal tuples sees what a
set of k-mers can't.

All k-mers of the whole text are ranked in all orders, in stretches of a few thousand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, new_path, release_memory, steady_heap, text_bytes
from .wordhash import BASE, mixed

K, ORDERS, TUPLE = 8, 64, 2
STRETCH = 2048
SEED = 20240131
PART_BYTES, MOST_PARTS = 32_000_000, 100_000
ROWS = 64  # documents that are taken out of Arrow at a time

#: An odd factor for each order: a k-mer's rank is its 32-bit hash times the factor, modulo 2^32.
FACTORS = (mixed(np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(SEED)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_ROW = np.arange(ORDERS)
_ROOM = np.empty(ORDERS * STRETCH, np.uint32)


def kmers(text: bytes, before: bytes = b"") -> np.ndarray:
    """A hash of the K bytes that end at each byte of the text, which ``before`` precedes."""
    padded = np.frombuffer((b"\0" * (K - 1) + before)[-(K - 1) :] + text, np.uint8)
    return mixed(np.ndarray(len(text), "<u8", padded, strides=(1,)) + np.uint64(BASE))


def occurrences(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that have equal keys before them, and how many. Only keys that share a place in a table of
    counts with another are sorted."""
    slot = (keys >> np.uint64(64 - len(keys).bit_length() - 3)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot)[slot] > 1)
    if not len(maybe):
        return maybe, maybe
    order = np.argsort(keys[maybe], kind="stable")
    run = keys[maybe[order]]
    again = np.flatnonzero(run[1:] == run[:-1]) + 1
    start = np.arange(len(run))
    start[again] = 0
    return maybe[order[again]], again - np.maximum.accumulate(start)[again]


def ranks(keys: np.ndarray) -> np.ndarray:
    """32-bit hashes of (k-mer, occurrence number)."""
    place, count = occurrences(keys)
    ranked = keys.copy()
    ranked[place] = mixed(keys[place] + count.astype(np.uint64) * np.uint64(BASE))
    return (ranked >> np.uint64(32)).astype(np.uint32)


def smallest(ranked: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and places of the TUPLE smallest from place ``lo`` to ``hi`` in every order, of each stretch."""
    values, places = [np.empty((ORDERS, 0), np.uint32)], [np.empty((ORDERS, 0), np.int64)]
    for at in range(lo, hi, STRETCH):
        part = ranked[at : min(hi, at + STRETCH)]
        order = np.multiply(part[None], FACTORS, out=_ROOM[: ORDERS * len(part)].reshape(ORDERS, len(part)))
        for _ in range(min(TUPLE, len(part))):
            best = order.argmin(axis=1)
            values.append(order[_ROW, best][:, None])
            places.append(best[:, None] + at)
            order[_ROW, best] = 0xFFFFFFFF
    return np.concatenate(values, 1), np.concatenate(places, 1)


def merged(keys: np.ndarray, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The k-mers selected of all parts, in text order: (ORDERS, TUPLE), 0 where the text has fewer."""
    value, place = (np.concatenate(x, 1) for x in zip(*parts))
    if value.shape[1] > TUPLE:
        place = np.take_along_axis(place, np.argsort(value, axis=1, kind="stable")[:, :TUPLE], 1)
    out = np.zeros((ORDERS, TUPLE), np.uint64)
    if len(keys):
        out[:, : place.shape[1]] = keys[np.sort(place, axis=1)]
    return out


def hashed(picked: np.ndarray) -> np.ndarray:
    """Fingerprints of selections (n, ORDERS, TUPLE): an unsigned 16-bit hash for each order, 0 for a text
    without bytes."""
    out = np.broadcast_to(np.arange(1, ORDERS + 1, dtype=np.uint64), picked.shape[:2])
    for j in range(TUPLE):
        out = mixed(out * np.uint64(BASE) + picked[:, :, j])
    return np.where(picked.any(axis=2), np.maximum(out >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype("<u2")


class Fingerprinted:
    """A document with its selection; what its first half has given serves its edited text too."""

    def __init__(self, doc_id: int | None, raw: bytes):
        self.doc_id, self.raw = doc_id, raw
        text = raw.decode()
        self.n_chars, self.half = len(text), len(text) // 2
        self.cut = len(text[: self.n_chars - self.half].encode())
        self.keys = kmers(raw)
        ranked = ranks(self.keys)
        self.first = smallest(ranked, 0, self.cut)
        self.picked = merged(self.keys, self.first, smallest(ranked, self.cut, len(raw)))

    def edited(self, other: bytes) -> tuple[bytes, np.ndarray]:
        """The text with its last half (floor, in code points) replaced by as many first ones of ``other``, or
        all it has, and its selection."""
        kept, tail = self.raw[: self.cut], head(other, self.half)
        keys = np.concatenate([self.keys[: self.cut], kmers(tail, kept[-(K - 1) :])])
        return kept + tail, merged(keys, self.first, smallest(ranks(keys), self.cut, len(keys)))


def head(raw: bytes, n: int) -> bytes:
    """The first ``n`` code points of UTF-8 bytes."""
    part = raw[: 4 * n]
    return part if len(part) <= n else part.decode("utf-8", "ignore")[:n].encode()


def signature(text: bytes) -> np.ndarray:
    """The fingerprint of one text."""
    return hashed(Fingerprinted(None, text).picked[None])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples, 0 to 1."""
    return float((a == b).mean())


FOUND = "part long, place long, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text binary"
KIND = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.binary())])


def finished(part: int, place: int, docs: list[Fingerprinted], last: Fingerprinted) -> pa.RecordBatch:
    """Rows of documents, the first of them at ``place``, each before the next and ``last`` behind all."""
    changed = [a.edited(b.raw) for a, b in zip(docs, [*docs[1:], last])]
    own = hashed(np.stack([d.picked for d in [*docs, last]]))
    new = hashed(np.stack([picked for _, picked in changed]))
    n = len(docs)
    columns = [
        [part] * n, range(place, place + n), [d.doc_id for d in docs], [d.n_chars for d in docs], [hashlib.sha256(text).hexdigest() for text, _ in changed],
        [x.tobytes() for x in own[:-1]], [x.tobytes() for x in new], (own[:-1] == new).mean(axis=1), (own[:-1] == own[1:]).mean(axis=1), [None] * n,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KIND)], schema=KIND)


def edge(part: int, place: int, doc: Fingerprinted) -> pa.RecordBatch:
    """A document with its text, at the end of a partition."""
    return pa.RecordBatch.from_pylist([{"part": part, "place": place, "doc_id": doc.doc_id, "text": doc.raw}], KIND)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with n_chars, edited_sha256, fingerprint and edited_fingerprint (hex),
    near_edited and near_next.

    The next document is the one behind in descending order of doc_id, null last, ties by a hash of the text; the last one's
    is the first, and a document alone is its own. Null texts are empty; two empty texts are alike (1).

    Texts are shuffled once, by ranges of doc_id. A task holds a document and its successor; the first and last
    of each partition are written with their texts, and a second, small pass joins the last of each with the
    first of the next that has rows. An empty table gives an empty result."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        part, place, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(i, ROWS).to_pylist()
                docs = [Fingerprinted(*row) for row in zip(ids, batch.column(1).slice(i, ROWS).cast(pa.binary()).to_pylist())]
                if held is None:
                    yield edge(part, -1, docs[0])
                else:
                    docs.insert(0, held)
                held = docs.pop()
                if docs:
                    yield finished(part, place, docs, held)
                    place += len(docs)
        if held is not None:
            yield edge(part, place, held)
        release_memory()

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                yield finished(r["part"], r["place"], [Fingerprinted(r["doc_id"], r["text"])], Fingerprinted(None, r["next_text"]))

    total = text_bytes(docs)
    parts = blocks_for(total, min(PART_BYTES, max(1_000_000, total / spark.sparkContext.defaultParallelism)), MOST_PARTS)
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = new_path(spark, "fingerprints")
    dealt = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    dealt.mapInArrow(run, FOUND).withColumn("edge", F.col("text").isNotNull()).write.partitionBy("edge").parquet(path)
    found = spark.read.schema(f"{FOUND}, edge boolean").parquet(path)

    # a row for the first and the last document of each partition; sizes: the number of partitions
    edges = found.filter("edge").drop("edge")
    firsts, lasts = edges.filter("place = -1"), edges.filter("place >= 0")
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    behind = firsts.select("part", F.coalesce(F.lead("part").over(ring), F.min("part").over(whole)).alias("follows"))
    after = firsts.select(F.col("part").alias("follows"), F.col("text").alias("next_text"))
    seams = lasts.join(behind, "part").join(after, "follows").select("part", "place", "doc_id", "text", "next_text")
    done = found.filter("not edge").drop("edge").unionByName(seams.mapInArrow(seam, FOUND))
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    return done.select("doc_id", "n_chars", "edited_sha256", shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next")
