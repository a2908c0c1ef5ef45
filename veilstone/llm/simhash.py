"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits; bit i is set if more than half of the shingle hashes have it. Two
fingerprints link at ``radius`` or fewer differing bits. The bits stand in radius+1 segments on a ring,
so each segment's share of the budget is radius/(radius+1) < 1. By the pigeonring principle a linked pair
has a segment from which every chain of consecutive segments stays within its proportional budget: one
segment differs in 0 bits, two in at most 1, three in at most 2 ... A join key is a chain of two segments or
more: its first segment as it is, the next ones with every change the budgets allow (on one side). Longer
chains give more probes and rarer keys, so beyond 2^27 fingerprints a chain has three. Pairs that meet at
a key go through the budgets of all longer chains before the full Hamming check. No linked pair is lost at
any chain length.

Equal fingerprints are one node, made with an aggregate that combines before the shuffle, so exact copies
are never paired. For components, a key's fingerprints are first compared with two of them; then only
those that are not connected yet meet each other, at keys that hold more than one component. A large group
of near copies thus costs rows in about proportion to its size.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, steady_heap
from .components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of lower-cased words; 0 for no words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n, counts = len(words) - k + 1, np.zeros(64, np.int64)
    lo, hi = starts[:n].tolist(), (ends[k - 1 :] - 1).tolist()
    for i in range(0, n, 65536):
        hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(lo[i : i + 65536], hi[i : i + 65536])), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [fingerprint(t, shingle) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.int64())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, "doc_id long, fingerprint long")


def segments(radius: int) -> list[list[int]]:
    """Bits of each of radius+1 segments, as even as can be."""
    return [[int(b) for b in part] for part in np.array_split(np.arange(64), radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_probes(radius: int, start: int, length: int) -> tuple[int, list[int]]:
    """(mask of the chain's bits, every change to it that keeps the budgets) for a chain from ``start``."""
    parts = segments(radius)
    mask, changes = sum(1 << b for b in parts[start]), [(0, 0)]
    for step in range(1, length):
        bits = parts[(start + step) % len(parts)]
        mask |= sum(1 << b for b in bits)
        grown = []
        for value, used in changes:
            options = [(0, 0)]
            for extra in range(step - used + 1):
                grown += [(value | v, used + extra) for v, _ in options]
                options = list({v | (1 << b): (v | (1 << b), 0) for v, _ in options for b in bits if not v >> b & 1}.values())
        changes = grown
    return mask, [v for v, _ in changes]


def chain_length(n: int, radius: int) -> int:
    """Segments of a key: two, and three where two would let too many fingerprints meet by chance."""
    return min(radius + 1, 2 if n <= 1 << 27 else 3)


def chains(nodes: DataFrame, radius: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Keys of distinct ``nodes.fingerprint``: an index (seg, key, a), a row for each segment, and probes
    (seg, key, b), a row for each segment and change within the budgets. Spark takes them to be about as
    large as ``nodes``, so their join asks for a merge: as a broadcast they wouldn't fit the driver."""
    made = [(i, *chain_probes(radius, i, length)) for i in range(radius + 1)]

    def keys(node: str, rows: list[tuple[int, int, int]]) -> DataFrame:
        # a constant array of (segment, mask, change), so that a row makes no arrays of its own
        table = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(_signed(m)).alias("mask"), F.lit(_signed(c)).alias("change")) for i, m, c in rows])
        opened = nodes.select(F.col("fingerprint").alias(node), F.explode(table).alias("k"))
        return opened.select("k.seg", F.col(node).bitwiseXOR(F.col("k.change")).bitwiseAND(F.col("k.mask")).alias("key"), node)

    return keys("a", [(i, mask, 0) for i, mask, _ in made]), keys("b", [(i, mask, c) for i, mask, changes in made for c in changes])


def linked(pairs: DataFrame, radius: int) -> DataFrame:
    """Those of ``pairs`` (seg, a, b) whose chains from segment seg keep every budget (the pigeonring
    filter), and then those of them that differ in at most ``radius`` bits in all."""
    parts, differ = segments(radius), F.col("a").bitwiseXOR(F.col("b"))

    def budgets(i: int) -> Column:
        ok, mask = F.lit(True), 0
        for step in range(radius):
            mask |= sum(1 << b for b in parts[(i + step) % (radius + 1)])
            ok = ok & (F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) <= step)
        return ok

    ring = F.lit(False)
    for i in range(radius + 1):
        ring = F.when(F.col("seg") == i, budgets(i)).otherwise(ring)
    return pairs.filter(ring).filter(F.bit_count(differ) <= radius)


def links(nodes: DataFrame, radius: int = RADIUS, length: int | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of distinct ``nodes.fingerprint`` within ``radius`` bits."""
    index, probes = chains(nodes, radius, length or chain_length(nodes.count(), radius))
    met = index.hint("merge").join(probes, ["seg", "key"]).filter("a < b")
    return linked(met, radius).select("a", "b").distinct()


def meetings(nodes: DataFrame, radius: int = RADIUS, length: int | None = None) -> DataFrame:
    """Probes that meet another fingerprint at their key: (seg, key, b, centres), the centres being two of
    the key's indexed fingerprints. An order by hash picks them, so a group has few centres over all keys."""
    index, probes = chains(nodes, radius, length or chain_length(nodes.count(), radius))
    picked = [F.min_by("a", F.xxhash64("a", F.lit(seed))).alias(f"c{seed}") for seed in (1, 2)]
    centres = index.groupBy("seg", "key").agg(*picked)  # combines before the shuffle
    met = probes.hint("merge").join(centres, ["seg", "key"]).filter("c1 <> b or c2 <> b")
    return save(met.select("seg", "key", "b", F.array_distinct(F.array("c1", "c2")).alias("centres")), "meetings")


def to_centres(met: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, of ``meetings`` between a fingerprint and a centre of its keys: two for each
    fingerprint at most, to the first of all linked centres in either order."""
    pairs = met.select("seg", "b", F.explode("centres").alias("a")).filter("a <> b")
    first = [F.min_by("a", F.xxhash64("a", F.lit(seed))) for seed in (1, 2)]
    best = linked(pairs, radius).groupBy("b").agg(F.array(*first).alias("own")).select("b", F.explode("own").alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connecting_links(nodes: DataFrame, radius: int = RADIUS, length: int | None = None) -> DataFrame:
    """Links (a, b) of distinct ``nodes.fingerprint`` within ``radius`` bits that have the components of
    all of them: those to centres, and all between fingerprints that these leave unconnected."""
    length = length or chain_length(nodes.count(), radius)
    met = meetings(nodes, radius, length)
    near = save(to_centres(met, radius), "centre-links")
    roots = save(components(near), "centre-roots")

    def rooted(rows: DataFrame, node: str) -> DataFrame:
        return rows.join(roots.withColumnRenamed("id", node), node, "left").withColumn("root", F.coalesce("root", node))

    asked = rooted(met.select("seg", "key", "b"), "b")
    index, _ = chains(nodes, radius, length)
    held = rooted(index.join(met.select("seg", "key").distinct(), ["seg", "key"], "left_semi"), "a")
    both = asked.select("seg", "key", "root").unionByName(held.select("seg", "key", "root"))
    mixed = save(both.groupBy("seg", "key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("seg", "key"), "open-keys")
    x, y = held.join(mixed, ["seg", "key"]).withColumnRenamed("root", "r"), asked.join(mixed, ["seg", "key"]).withColumnRenamed("root", "s")
    # a centre's own probe isn't among the meetings, so pairs come in either order
    rest = linked(x.join(y, ["seg", "key"]).filter("a <> b and r <> s"), radius)
    return near.unionByName(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable
    over links. Null texts have no words: fingerprint 0, linked like any other. A null doc_id takes
    part but is never the smallest; a component of null ids alone has a null component_id. Repeated rows
    each have a row."""
    marked = save(fingerprints(docs, shingle), "fingerprints")
    nodes = save(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(connecting_links(nodes, radius))
    grouped = nodes.join(roots.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = save(grouped.join(least, "root").select("fingerprint", "component_id"), "named")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
