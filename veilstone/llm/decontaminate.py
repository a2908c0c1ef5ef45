"""Benchmark decontamination by SimHash over item-sized windows.

Every window of a document that has as many words as a benchmark item is fingerprinted: the 64-bit SimHash
of its five-word shingles, from running bit counts. A multi-index over four 16-bit blocks finds the items: for a
few items of that size, each block value names the least number of bits in which it differs from the block of
one of them. The four numbers together are at most the bits in which a fingerprint differs from any of the items,
so no item within the radius is missed. What it finds goes through the full Hamming check, and runs of windows
that pass are compared exactly with their item: weighted (multiset) Jaccard of the shingles, over the words
themselves.

Radius: windows of similarity 0.8 have eight ninths of their shingles in common and differ in about 9.7
bits with a deviation of 2.9, verbatim passages in none.

The documents are read once and not shuffled. Tasks hold an item's size, number and fingerprint alone, and a
worker keeps its tables from task to task; of a benchmark with more than ITEMS_AT_ONCE groups of items, they are
made part by part for each batch of documents.
Words that were found travel to the items' texts by a join on the item.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. An item with fewer than five
words has one shingle, all its words; one without words matches nothing. A document shorter than the item
is one window. Null texts and null ids of items match nothing. Rows stand for themselves: repeated rows,
rows that share an id and rows with a null doc_id are each reported with what they hold.
"""

from __future__ import annotations

import math
import string
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, byte_texts, release_memory, save, steady_heap
from .wordhash import gram_hashes, mixed, word_hashes

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15
BLOCKS, GROUP, LANES = 4, 6, 8
FAR = 31  # more bits than a block has; four of them and 127 fit a byte
ITEMS_AT_ONCE, MOST_ITEMS = 256, 4_000_000  # tables of a task: 512 kB a group at most; broadcast: 20 bytes an item
TEXT_BYTES, RUN = 1_000_000, 32
STRETCH, SIZES = 1 << 16, 64  # words, and item sizes, whose prints are held for the look-ups: 32 MB
PIECE, MOST_SUMS = 4096, 1 << 16  # words counted at a time, words that sums are held of for long items
HITS = "doc_id long, item_id long, first_word int, n_words int, bits int, similarity double"
#: Byte table: A-Z to lower case, all that is no letter, digit or non-ASCII byte to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in string.ascii_lowercase + string.digits else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Well-mixed hashes of the k-word shingles."""
    return mixed(gram_hashes(hashes, k))


_SPACE: dict[str, np.ndarray] = {}


def space(name: str, shape: tuple[int, ...], kind) -> np.ndarray:
    """An array of any content, in memory kept under ``name`` until the task ends: mapping fresh memory for each large
    array (see ``steady_heap``) takes longer than the work on it."""
    size = math.prod(shape) * np.dtype(kind).itemsize
    if name not in _SPACE or len(_SPACE[name]) < size:
        _SPACE[name] = np.empty(size, np.uint8)
    return _SPACE[name][:size].view(kind).reshape(shape)


def bit_sums(hashes: np.ndarray, kind=np.int64, order: str = "big", keep: bool = False) -> np.ndarray:
    """Running counts of each of 64 bits: row i counts the first i hashes (modulo the size of ``kind``).
    ``order`` is that of a byte's bits; with ``keep`` the next call takes the same memory."""
    runs = -(-len(hashes) // RUN)
    shape = (runs * RUN + 1, 64)
    sums = space("sums", shape, kind) if keep else np.empty(shape, kind)
    sums[0], sums[len(hashes) + 1 :] = 0, 0
    sums[1 : len(hashes) + 1] = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder=order)
    part = sums[1:].reshape(runs, RUN, 64)
    for i in range(1, RUN):  # whole rows at a time, in each run; then the runs before
        part[:, i] += part[:, i - 1]
    part[1:] += np.cumsum(part[:-1, -1], axis=0, dtype=kind)[:, None]
    return sums[: len(hashes) + 1]


def simhash(hashes: np.ndarray) -> int:
    """Fingerprint: a bit is 1 if more than half of the hashes have it."""
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(np.uint64)[0])


def window_prints(hashes: np.ndarray, lengths: list[int], out: np.ndarray) -> None:
    """Fingerprints of the windows of each of ``lengths`` hashes (ascending) into ``out``, a row for each length and a column
    for each first place. Places whose window would end beyond the last hash stay as they are. Sums of a piece serve all
    lengths while they are in the cache."""
    starts = out.shape[1]
    kinds = [np.uint8 if n < 256 else np.uint16 if n < 65536 else np.uint32 for n in lengths]
    for kind in dict.fromkeys(kinds):
        rows = [(row, n) for row, n in enumerate(lengths) if kinds[row] is kind]
        most = rows[-1][1]
        held = space("counts", (PIECE, 64), kind)
        set_ = held.view(bool) if kind is np.uint8 else space("bits", (PIECE, 64), bool)
        step = max(PIECE, min(most, MOST_SUMS) // PIECE * PIECE)
        for first in range(0, starts, step):
            sums = bit_sums(hashes[first : first + step + most], kind, "little", True)
            for at in range(0, min(step, starts - first), PIECE):
                for row, n in rows:
                    if (m := min(PIECE, step - at, starts - first - at, len(sums) - n - at)) <= 0:
                        break  # the longer ones don't fit either
                    np.subtract(sums[at + n : at + n + m], sums[at : at + m], out=held[:m])
                    np.greater(held[:m], n // 2, out=set_[:m])
                    out[row, first + at : first + at + m] = np.packbits(set_[:m].reshape(-1), bitorder="little").view(np.uint64)


def item_print(text: bytes | None) -> tuple[int, int]:
    """(words, fingerprint as a signed long) of an item."""
    if not (words := words_of(text)):
        return 0, 0
    hashes = grams(word_hashes(b" ".join(words))[2], min(SHINGLE, len(words)))
    return len(words), int(np.uint64(simhash(hashes)).astype(np.int64))


def similarity(a: list[bytes], b: list[bytes], k: int) -> float:
    """Weighted Jaccard of the k-word shingles of two word lists."""
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both) if both else 0.0


def least_bits(values: np.ndarray) -> np.ndarray:
    """For each 16-bit number, in how many bits it differs from the nearest of ``values``."""
    out = np.full(1 << 16, FAR, np.uint8)
    out[values] = 0
    for bit in range(16):
        low, high = out.reshape(-1, 2, 1 << bit).transpose(1, 0, 2)
        nearer = np.minimum(high, low + 1)
        np.minimum(low, high + 1, out=low)
        high[:] = nearer
    return out


class MultiIndex:
    """Block tables of some items of one size, GROUP items to a byte and up to LANES bytes to an entry:
    ``tables[t][block]`` holds ``least_bits`` of the block for each group of table t."""

    def __init__(self, numbers: np.ndarray, prints: np.ndarray, radius: int):
        self.numbers, self.prints, self.radius = numbers, prints, radius
        blocks, self.tables = prints.view(np.uint16).reshape(-1, BLOCKS), []
        for first in range(0, len(prints), GROUP * LANES):
            groups = [blocks[i : i + GROUP] for i in range(first, min(len(prints), first + GROUP * LANES), GROUP)]
            lanes = 1 << (len(groups) - 1).bit_length()
            table = np.full((BLOCKS, 1 << 16, lanes), FAR, np.uint8)
            for lane, group in enumerate(groups):
                for block in range(BLOCKS):
                    table[block, :, lane] = least_bits(group[:, block])
            table[0] += np.uint8(127 - radius)  # a byte of four entries' sum stays below 128 within the radius
            self.tables.append(table.view(f"<u{lanes}")[:, :, 0])

    def find(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item number, rows of ``prints`` within the radius, their differing bits), items with any. One
        search at a time: the next one takes the same memory."""
        blocks = space("blocks", (BLOCKS, len(prints)), np.intp)
        blocks[:] = prints.view(np.uint16).reshape(-1, BLOCKS).T
        for t, tables in enumerate(self.tables):
            sums = space("least", (len(prints),), tables.dtype)
            sums[:] = tables[0][blocks[0]]
            for table, values in zip(tables[1:], blocks[1:]):
                sums += table[values]
            over = sums.dtype.type(int.from_bytes(b"\x80" * sums.itemsize, "little"))
            sums &= over
            at = np.flatnonzero(sums != over)
            close = prints[at]
            for i in range(t * GROUP * LANES, min(len(self.prints), (t + 1) * GROUP * LANES)) if len(at) else ():
                differ = np.bitwise_count(close ^ self.prints[i])
                ok = np.flatnonzero(differ <= self.radius)
                if len(ok):
                    yield int(self.numbers[i]), at[ok], differ[ok]


class Scanner:
    """Looks the windows of texts up in the multi-index of some items (size, number, print). A text shorter than
    an item is looked up where its length allows a similarity of ``least``."""

    def __init__(self, sizes: np.ndarray, numbers: np.ndarray, prints: np.ndarray, radius: int, least: float = SIMILARITY):
        self.least = least
        self.sizes = {int(s): MultiIndex(numbers[sizes == s], prints[sizes == s], radius) for s in np.unique(sizes)}
        self.longest = int(sizes.max())

    def find(self, hashes: np.ndarray, left: np.ndarray, heads: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(item number, first words, bits, item size) over word hashes of several texts in a row; ``left``
        counts the words from a place to the end of its text, ``heads`` are first places of the texts."""
        for k in sorted({min(SHINGLE, s) for s in self.sizes}):
            sizes = [s for s in self.sizes if min(SHINGLE, s) == k]
            own = grams(hashes, k) if len(hashes) >= k else hashes[:0]
            for lo in range(0, len(own), STRETCH):
                for i in range(0, len(sizes), SIZES):
                    yield from self._windows(own[lo : lo + STRETCH + max(sizes)], lo, left, sizes[i : i + SIZES], k)
            # texts shorter than an item, as one window
            short = heads[(left[heads] < max(sizes)) & (left[heads] >= k)]
            if len(short):
                n = left[short]
                whole = np.array([simhash(own[s : s + m - k + 1]) for s, m in zip(short.tolist(), n.tolist())], np.uint64)
                for size in sizes:
                    fit = np.flatnonzero((n < size) & (n - k + 1 >= self.least * (size - k + 1) - 1e-9))
                    for number, rows, bits in self.sizes[size].find(whole[fit]) if len(fit) else ():
                        yield number, short[fit[rows]], bits, size

    def _windows(self, own: np.ndarray, lo: int, left: np.ndarray, sizes: list[int], k: int):
        prints = space("prints", (len(sizes), min(STRETCH, len(own))), np.uint64)
        window_prints(own, [size - k + 1 for size in sizes], prints)
        for size, held in zip(sizes, prints):
            for number, rows, bits in self.sizes[size].find(held[: max(0, len(own) - size + k)]):
                inside = left[rows + lo] >= size  # a window ends in the text that it starts in
                if inside.any():
                    yield number, rows[inside] + lo, bits[inside], size


def _lines(texts: Iterator[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
    """Folded texts with words, as (place in the batch, words joined by a space), about TEXT_BYTES at a time."""
    held, size = [], 0
    for n, text in enumerate(texts):
        if line := b" ".join(words_of(text)):
            held.append((n, line))
            size += len(line)
        if size > TEXT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


_KEPT: dict[str, Scanner] = {}


def _kept_scanner(name: str, *made_of) -> Scanner:
    """The scanner that this worker made for ``name``, the last one only."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Scanner(*made_of)
    return _KEPT[name]


def candidates(docs: DataFrame, items: DataFrame, radius: int, least: float = SIMILARITY) -> DataFrame:
    """Runs of windows of ``docs`` (doc_id, text) within ``radius`` of an item (item, size, print): a row for
    each document and item, with the first words of each run and the words from its first to its last
    window, joined by a space."""
    spark = docs.sparkSession
    got = items.select("size", "item", "print").orderBy("size", "item").toArrow()  # MOST_ITEMS rows at most
    shared = spark.sparkContext.broadcast((got.column(0).to_numpy().astype(np.int32), got.column(1).to_numpy(), got.column(2).to_numpy().astype(np.int64).view(np.uint64)))

    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        sizes = shared.value[0]
        place = np.arange(len(sizes)) - np.searchsorted(sizes, sizes)  # in the items of its size
        part = (np.cumsum(place % GROUP == 0) - 1) // ITEMS_AT_ONCE
        cuts = [tuple(c[part == p] for c in shared.value) for p in np.unique(part)]
        only = _kept_scanner(name, *cuts[0], radius, least) if len(cuts) == 1 else None
        for batch in batches:
            for cut in cuts:
                scanner = only or Scanner(*cut, radius, least)
                for held in _lines(byte_texts(batch.column(1))):
                    yield _found(scanner, held, batch.column(0))
        _SPACE.clear()
        release_memory()

    return docs.mapInArrow(scan, "doc_id long, item long, firsts array<int>, lasts array<int>, texts array<binary>")


def _found(scanner: Scanner, held: list[tuple[int, bytes]], ids) -> pa.RecordBatch:
    line = b"\n".join(text for _, text in held)
    starts, ends, hashes = word_hashes(line)
    counts = np.array([text.count(b" ") + 1 for _, text in held])
    after = np.cumsum(counts)
    heads = after - counts
    left = np.repeat(after, counts) - np.arange(len(hashes))
    runs: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
    for number, places, _, size in scanner.find(hashes, left, heads):
        texts = np.searchsorted(after, places, "right")
        for t in np.unique(texts).tolist():
            runs[t, number].append(np.stack([places[texts == t], np.full((texts == t).sum(), size)]))
    rows: tuple[list, ...] = ([], [], [], [], [])
    for (t, number), found in runs.items():
        places, sizes = np.concatenate(found, axis=1)
        places = np.sort(places)
        cut = np.flatnonzero(np.diff(places) > 1)
        firsts, lasts = places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]
        last_words = np.minimum(lasts + sizes[0], after[t]) - 1
        rows[0].append(held[t][0])
        rows[1].append(number)
        rows[2].append((firsts - heads[t]).tolist())
        rows[3].append((lasts - heads[t]).tolist())
        rows[4].append([line[s:e] for s, e in zip(starts[firsts].tolist(), ends[last_words].tolist())])
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
    columns = [ids.take(pa.array(rows[0], pa.int64())), *(pa.array(c, t) for c, t in zip(rows[1:], kinds))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item", "firsts", "lasts", "texts"])


def _verified(least: float):
    """Best window of each row of candidates, if it is similar enough: the first of equals."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for r in batch.slice(i, 256).to_pylist():
                    own = words_of(r["item_text"].encode())
                    k, best = min(SHINGLE, len(own)), None
                    item = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
                    for first, last, text in zip(r["firsts"], r["lasts"], r["texts"]):
                        words = text.split(b" ")
                        size = len(words) - (last - first)
                        # shingles of the item up to each place: no window can have more in common
                        shared = [0, *accumulate(tuple(words[j : j + k]) in item for j in range(len(words) - k + 1))]
                        for s in range(last - first + 1):
                            if shared[s + size - k + 1] - shared[s] < least / (1 + least) * (size + len(own) - 2 * k + 2) - 1e-9:
                                continue
                            got = similarity(words[s : s + size], own, k)
                            if got >= least and (best is None or got > best[2]):
                                best = (first + s, size, got, words[s : s + size])
                    if best:
                        bits = (item_print(b" ".join(best[3]))[1] ^ r["print"]) & 0xFFFFFFFFFFFFFFFF
                        for column, value in zip(rows, (r["doc_id"], r["item_id"], *best[:2], bits.bit_count(), best[2])):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "item_id", "first_word", "n_words", "bits", "similarity"])

    return verify


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_text, size, print) of the rows of ``benchmark`` with an id and words, saved."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [item_print(t) for t in byte_texts(batch.column(1))]
            columns = [pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["item_id", "item_text", "size", "print"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_id is not null and item_text is not null")
    made = rows.mapInArrow(mark, "item_id long, item_text string, size int, print long").filter("size > 0")
    return save(made.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """A row for each document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) of
    which it holds a window within ``radius`` bits and with weighted shingle similarity ``least`` or more:
    the best window, the first of equals."""
    items = benchmark_items(benchmark)
    narrow, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    passes = blocks_for(items.count(), MOST_ITEMS, 1 << 30)  # one, up to four million items
    for n in range(passes):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == n)
        got = candidates(narrow, own, radius, least).join(items.drop("size"), "item")
        got = got.select("doc_id", "item_id", "item_text", "print", "firsts", "lasts", "texts").mapInArrow(_verified(least), HITS)
        found = got if found is None else found.unionByName(got)
    return found
