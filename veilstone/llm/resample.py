"""Importance resampling towards a target distribution, over hashed runs of one and two words.

A batch's texts are joined with a sentinel between them, one regular expression finds all words and
sentinels, and the sentinels' places are the documents' offsets: ``searchsorted`` gives every word its
document, which masks pairs across two documents before ``bincount``. A feature's CRC-32 isn't computed from
its bytes: those of a pair follow from the words' own by the linear map that appending bytes is.

The corpus is read twice: for the counts of all buckets, and for the documents' weights under the ratio of
the two distributions. Both passes hold a slice of texts; counts leave a task once, added up.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, release_memory, save, steady_heap
from .numbering import numbered

BUCKETS = 10_000
SENTINEL = b"\n"
#: Word bytes as they are, A-Z in lower case, all other bytes a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOKEN = re.compile(rb"[^ \n]+|\n")
MOST_WORDS, LONGEST_WORD = 200_000, 64  # words that a task remembers; longer ones are never kept
SLICE_ROWS, SLICE_BYTES = 128, 1_000_000  # a slice: so many rows, or so many bytes and one text more
POLY = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLY), np.uint32(0))
    return table


def _appended(n: int) -> np.ndarray:
    """What ``n`` zero bytes do to each byte of a CRC register: four tables of 256."""
    step = _byte_table()
    held = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    for _ in range(n):
        held = (held >> np.uint32(8)) ^ step[held & np.uint32(255)]
    return held


class _Words(dict):
    """CRC-32 of a word, and above it its length; -1 for the sentinel."""

    def __missing__(self, word: bytes) -> int:
        found = -1 if word == SENTINEL else zlib.crc32(word) | len(word) << 32
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = found
        return found


class Features:
    """Buckets of all features of a few documents at a time."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.words = _Words()
        self.shift = np.stack([_appended(n) for n in range(LONGEST_WORD + 1)])

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, bucket) of every feature, single words first, and the words of each document."""
        joined = SENTINEL.join([t.translate(PLAIN) for t in texts])
        tokens = TOKEN.findall(joined)
        packed = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        ends = np.flatnonzero(packed < 0)  # sentinels: document i is before the i-th
        doc = np.searchsorted(ends, np.arange(len(packed)), "left")
        real = packed >= 0
        crc, size = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
        pair = np.flatnonzero(real[:-1] & real[1:] & (doc[:-1] == doc[1:]))
        first, second, width = crc[pair], crc[pair + 1], size[pair + 1]
        # a word and a space, then the second word's bytes
        spaced = self._append(first, np.full(len(pair), 1), np.uint32(zlib.crc32(b" ")))
        both = self._append(spaced, np.minimum(width, LONGEST_WORD), second)
        for i in np.flatnonzero(width > LONGEST_WORD):
            j = pair[i]
            both[i] = zlib.crc32(tokens[j] + b" " + tokens[j + 1])
        buckets = np.concatenate([crc[real], both]) % np.uint32(self.buckets)
        return np.concatenate([doc[real], doc[pair]]), buckets.astype(np.int64), np.bincount(doc[real], minlength=len(texts))

    def _append(self, crc: np.ndarray, size: np.ndarray, other: np.ndarray | np.uint32) -> np.ndarray:
        """CRC-32 of texts with CRC ``crc``, and behind each a text of ``size`` bytes with CRC ``other``."""
        t = self.shift
        moved = t[size, 0, crc & 255] ^ t[size, 1, (crc >> np.uint32(8)) & 255] ^ t[size, 2, (crc >> np.uint32(16)) & 255] ^ t[size, 3, crc >> np.uint32(24)]
        return moved ^ other


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes, null as empty) of a column, a slice at a time."""
    start, held, size = 0, [], 0
    for i, text in enumerate(byte_texts(column)):
        held.append(text or b"")
        size += len(held[-1])
        if len(held) >= SLICE_ROWS or size >= SLICE_BYTES:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def bucket_counts(docs: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a column's texts fall into each bucket. A task adds up its own counts; at most
    ``buckets`` rows reach the driver, whatever the size of the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                total += np.bincount(features.of(texts)[1], minlength=buckets)
        release_memory()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    added = docs.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in added.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log of the target's share over the source's, each count one higher, floored."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a document's features, 0 without any.
    ``gain`` goes to the tasks; its size is the number of buckets."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        features = Features(len(gain))
        for batch in batches:
            n, sums, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for start, texts in _slices(batch.column(1)):
                doc, bucket, count = features.of(texts)
                here = slice(start, start + len(texts))
                words[here] = count
                n[here] = np.bincount(doc, minlength=len(texts))
                np.add.at(sums[here], doc, gain[bucket])
            mean = np.floor_divide(sums, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Documents (doc_id, text) with n_features, weight, score and rank. ``target`` has texts of the wanted
    distribution. ``score`` is the weight plus Gumbel noise from a hash of seed and doc_id (a row without an
    id is hashed with none); of the documents with at least ``least_words`` words the ``percent`` of highest
    score, ties to the smaller doc_id, null first, are drawn without replacement and ranked from 1, the others'
    rank is null. Null texts have no words. Rows that share an id and a score are ordered by weight and
    features. Without documents the result is empty."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = save(weights(docs, gain).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("fit", F.col("n_words") >= least_words), "scored")
    fit = scored.filter("fit").count()
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("weight"), F.asc("n_features")]
    drawn = F.col("fit") & (F.col("row_no") < percent * fit // 100)
    placed = numbered(scored, order, "ranked")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("row_no") + 1).alias("rank"))
