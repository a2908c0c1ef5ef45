"""Best-fit packing of token pieces into sequences, by pattern packing with non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` bins) reaches the driver. There, patterns of
one to three lengths that fill a sequence exactly are enumerated, repeat counts are fitted to the
histogram by least squares under x >= 0, rounded so that no length is overdrawn, and what is left is
packed best-fit from the longest down. The plan says which places the j-th piece of a length takes;
pieces are numbered inside their length in parallel and joined to the plan.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, save, slices, steady_heap
from .tokens import encoder

CAPACITY, GROUP_ROWS = 2048, 65_536
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Ids of every document, the end id last, cut at each ``capacity``: a row per piece with the CRC-32 of
    its ids (little-endian unsigned 32-bit), and the ``ids`` themselves only if they are asked for. Null
    texts are empty and give one piece, the end id. Repeated rows and rows with a null id are documents of
    their own."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: len(names)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        code, end = encoder(tokenizer, False), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_ids, texts in slices(batch):
                rows: tuple[list, ...] = tuple([] for _ in names)
                for doc_id, ids in zip(doc_ids.to_pylist(), code.batches(texts)):
                    ids += end
                    for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        for column, value in zip(rows, (doc_id, piece, lo // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """All multisets of one to three present lengths with sum ``capacity``; rows (a, b, c), 0 for none."""
    found = []
    for a in np.flatnonzero(present[1:]) + 1:
        if a == capacity:
            found.append(np.array([[a, 0, 0]]))
            continue
        b = np.arange(max(1, -(-(capacity - a) // 2)), min(a, capacity - a) + 1)
        c = capacity - a - b
        ok = present[b] & ((c == 0) | present[c]) & (c <= b)
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit_counts(hist: np.ndarray, pats: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram, by block coordinate descent:
    each round takes the patterns of largest gain that share no length (their columns are orthogonal,
    so exact steps along each hold together). The support stays small."""
    rest, x = hist.astype(float), np.zeros(len(pats))
    rest[0] = 0
    a, b, c = pats.T
    norm = np.where(a == b, np.where(b == c, 9.0, np.where(c > 0, 5.0, 4.0)), np.where(b == c, np.where(b > 0, 5.0, 1.0), np.where(c > 0, 3.0, np.where(b > 0, 2.0, 1.0))))
    scale = float(rest @ rest) or 1.0
    for _ in range(rounds):
        g = rest[a] + rest[b] + rest[c]
        step = np.maximum(g / norm, -x)
        gain = step * (2 * g - step * norm)
        top = np.argpartition(-gain, min(8192, len(gain) - 1))[:8192]
        used, taken = np.zeros(len(hist), bool), []
        for i in top[np.argsort(-gain[top])].tolist():
            p = [v for v in pats[i] if v]
            if gain[i] > 0 and not used[p].any():
                used[p] = True
                taken.append(i)
        if not taken or gain[taken].sum() < 1e-7 * scale:
            break
        x[taken] += step[taken]
        for column in (a, b, c):
            np.subtract.at(rest, column[taken], step[taken])
        rest[0] = 0
    return x


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit from the longest length down, on counts: (sequences, [(length, times), ...])."""
    open_: dict[int, list] = defaultdict(list)  # space left -> [(sequences, lengths)]
    for length in range(len(hist) - 1, 0, -1):
        left = int(hist[length])
        while left:
            space = next((s for s in range(length, capacity) if open_.get(s)), None)
            if space is None:
                each = capacity // length
                full, some = divmod(left, each)
                if full:
                    open_[capacity - each * length].append((full, [(length, each)]))
                if some:
                    open_[capacity - some * length].append((1, [(length, some)]))
                break
            n, held = open_[space].pop()
            each = min(space // length, max(1, left // n))
            take = min(n, left // each)
            open_[space - each * length].append((take, [*held, (length, each)]))
            if n > take:
                open_[space].append((n - take, held))
            left -= take * each
    return [group for groups in open_.values() for group in groups]


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Entries (length, lo, hi, first sequence, offset, times): pieces lo..hi-1 of a length go ``times``
    to a sequence, from ``offset`` on. Also the number of sequences."""
    pats = patterns(capacity, hist > 0)
    rest, groups = hist.astype(np.int64).copy(), []
    if len(pats):
        x = fit_counts(hist, pats)
        for i in np.argsort(-x):
            if x[i] < 0.5:
                break
            lengths, times = np.unique(pats[i][pats[i] > 0], return_counts=True)
            n = int(min(round(x[i]), (rest[lengths] // times).min()))
            if n:
                rest[lengths] -= n * times
                groups.append((n, list(zip(lengths.tolist()[::-1], times.tolist()[::-1]))))
    groups += best_fit(rest, capacity)
    entries, sequences, used = [], 0, np.zeros(len(hist), np.int64)
    for n, held in groups:
        offset = 0
        for length, times in held:
            entries.append((length, int(used[length]), int(used[length]) + n * times, sequences, offset, times))
            used[length] += n * times
            offset += length * times
        sequences += n
    return entries, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (a saved table with ``length`` from 1 to ``capacity``, doc_id and piece) with
    ``sequence_id`` and ``offset``, gapless in every sequence. An empty table stays empty.

    Pieces are numbered inside (length, salt), a salt for about ``group_rows`` pieces of a length, so that
    a length that most pieces have is many tasks' work. Pieces equal in doc_id, piece and length may take
    each other's places.

    The plan has an entry for each pattern and length in it: a few ten thousand at most, since the
    histogram has ``capacity`` bins, so it is broadcast whatever the number of pieces."""
    spark = pieces.sparkSession
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        hist[length] = n
    entries, _ = plan(hist, capacity)
    entries = spark.createDataFrame(entries, "length long, lo long, hi long, first_seq long, at long, times int")
    salts = F.lit((-(-np.maximum(hist, 1) // group_rows)).tolist()).cast("array<long>")  # ``capacity`` numbers
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.element_at(salts, F.col("length").cast("int") + 1))
    salted = save(pieces.withColumn("__salt", salt), "salted")
    group = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "__salt").count().withColumn("__base", F.coalesce(F.sum("count").over(group), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("__j", F.row_number().over(inside) - 1).join(bases, ["length", "__salt"]).withColumn("__j", F.col("__j") + F.col("__base"))
    i = F.col("__j") - F.col("lo")
    turn = (i - i % F.col("times")) / F.col("times")
    return (
        numbered.join(F.broadcast(entries), "length")
        .filter((F.col("__j") >= F.col("lo")) & (F.col("__j") < F.col("hi")))
        .withColumn("sequence_id", F.col("first_seq") + turn.cast("long"))
        .withColumn("offset", F.col("at") + i % F.col("times") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their places: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. The ids themselves stay in the tasks; ``cut_pieces`` gives them."""
    return pack(save(cut_pieces(docs, tokenizer, capacity=capacity), "pieces"), capacity)
