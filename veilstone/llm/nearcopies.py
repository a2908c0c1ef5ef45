"""Near copies by the exact Jaccard similarity of word shingles: the form of the SimHash operator that
deduplication stages use.

Words are split and lower-cased as in ``simhash``; a text's shingles are its runs of ``shingle`` words (all
its words if it has fewer), as a set. Two texts link at similarity ``least`` or more. The pigeonring join
of ``simhash`` proposes the first pairs, from fingerprints of the shingle sets. No radius that its keys can
serve guarantees a similarity (0.8 is about 10 bits away), so a prefix filter, which loses none, proposes
the rest: with the shingles of all texts in one order, two linked texts share a shingle among the first
n - ceil(least * n) + 1 of the larger set and the first n - ceil(2 * least / (1 + least) * n) + 1 of the
smaller one. Any order is right; shingles that are common stand last, so that few texts meet at a key: those
common in a sample, and then those that stand in the prefixes of more than ``crowd`` texts, which moves a
passage behind the rest of its texts. Texts that meet must also pass a bitmap filter (Sandes, Teodoro and
Melo, 2017), which loses none either: with a set's hashes counted by parity in 1024 bits, the bits in which two
bitmaps differ are at most the shingles that one set has and the other doesn't, and those are at most
(1 - least) / (1 + least) of both sizes. Where many rows meet a few, the bitmap folded to 256 bits, of which the
same is true, goes first. What passes is compared over the words themselves.

Texts with the same shingles are one node (a 128-bit digest of the sorted 64-bit shingle hashes), so exact
copies are never paired. Once the first links have joined texts, each key's texts are compared with a few
of them that pass the filter; then only texts that are not yet connected meet, at keys that hold more than one
component. A
group whose texts are linked with a few thus costs rows in about proportion to its size; one without such texts costs
its links. Pairs just below ``least`` mostly fail the filter, where folded bitmaps would pass most of them. A pair has many keys in common, and the filters have to hold at the first of them only, so
each key brings the EARLIER keys that stand before it in its text, and two texts that share one of them don't
meet there: a pair is left about once rather than once for each common key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import byte_texts, passing, release_memory, save, steady_heap
from .components import components
from .simhash import LOWER
from .wordhash import gram_hashes, mixed, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
SAMPLE, MOST_COMMON = 20_000, 200_000  # they set the order of shingles, so the work, not the result
TINY = 1e-9
CROWD, ROUNDS = 256, 3  # as do these
EARLIER = 4  # and this
CENTRES = 0, 1, 2  # and these
BITS = tuple(f"b{i}" for i in range(16))
FOLDED = ("f0", "f1", "f2", "f3")
ADDED = ("component_id", "kept", "__row", "__digest", "__print", *[f"__{b}" for b in BITS])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def shingles(text: bytes | None, k: int = SHINGLE) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def shingle_hashes(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = words_of(text)
    return np.unique(gram_hashes(word_hashes(b" ".join(words))[2], min(k, len(words)))) if words else np.zeros(0, np.uint64)


def set_print(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingle hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = mixed(hashes[i : i + 65536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view("<i8")[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """1024 bits as signed longs: whether an odd number of the hashes fell on each."""
    counts = np.bincount((mixed(hashes) >> np.uint64(54)).astype(np.int64), minlength=64 * len(BITS))
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Small parts of the batches, and their texts as bytes."""
    steady_heap()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield part, list(byte_texts(part.column("text")))


def _marked(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with __row, __digest (of the shingle set), __print (its fingerprint) and its bitmap, saved."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            held = [shingle_hashes(t, k) for t in texts]
            made = [pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in held], pa.binary()), pa.array(list(map(set_print, held)), pa.int64())]
            bits = np.array([parities(h) for h in held], np.int64).reshape(-1, len(BITS))
            made += [pa.array(bits[:, i]) for i in range(len(BITS))]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "__digest", "__print", *[f"__{b}" for b in BITS]])
        release_memory()

    taken = docs.select(*[c for c in docs.columns if c not in ADDED])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema)
    made = taken.mapInArrow(mark, f"{kinds}, __digest binary, __print long, " + ", ".join(f"__{b} long" for b in BITS))
    return save(made.withColumn("__row", F.monotonically_increasing_id()), "near-rows", "zstd")


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of shingles that several texts of a sample hold, in how many, and for how many texts one
    of the sample stands. At most MOST_COMMON reach the driver."""
    step = math.ceil(max(1, texts.count()) / SAMPLE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _texts(batches):
            hashes = np.concatenate([shingle_hashes(t, k) for t in held]) if held else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64), pa.int64())], names=["key"])

    sample = texts.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("id", "text")
    found = sample.mapInArrow(each, "key long").groupBy("key").count().filter("count > 2").orderBy(F.desc("count"), "key").limit(MOST_COMMON).toArrow()
    keys, counts = found.column(0).to_numpy().astype(np.int64).view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order].astype(float), step


def _keys(texts: DataFrame, k: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The first shingles of each of ``texts`` (id, text), those of ``common`` last: (key, id, n, pos, indexed)."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for part, held in _texts(batches):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for node, text in zip(part.column("id").to_pylist(), held):
                own = shingle_hashes(text, k)
                if not (n := len(own)):
                    continue
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.argsort(np.where(common[at] == own, counts[at], 0), kind="stable")]
                size = n - math.ceil(least * n - TINY) + 1
                pos = np.arange(size)
                indexed = pos < n - math.ceil(2 * least / (1 + least) * n - TINY) + 1
                for column, value in zip(columns, (own[:size].view(np.int64), np.full(size, node), np.full(size, n), pos, indexed)):
                    column.append(value)
            kinds = (np.int64, np.int64, np.int32, np.int32, bool)
            made = [pa.array(np.concatenate(c).astype(t) if c else np.zeros(0, t)) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(made, names=["key", "id", "n", "pos", "indexed"])

    return texts.select("id", "text").mapInArrow(first, "key long, id long, n int, pos int, indexed boolean")


def _spread_keys(texts: DataFrame, k: int, least: float, crowd: int) -> DataFrame:
    """``_keys`` at keys that several texts hold, once keys of more than ``crowd`` texts have moved back in the
    order, to where their number puts them among the common shingles of the sample.

    A key only moves back, and the others keep their order, so the prefix of a text that has none of the moved
    keys in it stays what it is: only the other texts are read again. A round brings forward few new shingles
    of a passage; after ROUNDS the rest stays. At most MOST_COMMON keys a round reach the driver."""
    common, counts, step = _common(texts, k)
    keys = save(_keys(texts, k, least, (common, counts)), "near-keys")
    for last in (*[False] * ROUNDS, True):
        held = save(keys.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1"), "near-held")
        top = None if last else held.filter(F.col("texts") > crowd).orderBy(F.desc("texts"), "key").limit(MOST_COMMON).toArrow()
        found = top.column("key").to_numpy().astype(np.int64).view(np.uint64) if top is not None else np.zeros(0, np.uint64)
        new = ~np.isin(found, common)
        if not new.any():
            return save(keys.join(held.select("key"), "key"), "near-hits", lasting=True)
        common, counts = np.append(common, found[new]), np.append(counts, top.column("texts").to_numpy()[new] / step)
        order = np.argsort(common)
        common, counts = common[order], counts[order]
        moved = texts.sparkSession.createDataFrame([(int(x),) for x in found[new].view(np.int64)], "key long")
        ids = save(keys.join(moved, "key", "left_semi").select("id").distinct(), "near-moved")
        again = _keys(texts.join(ids, "id", "left_semi"), k, least, (common, counts))
        keys = save(keys.join(ids, "id", "left_anti").unionByName(again), "near-keys")


def folded(bitmaps: DataFrame) -> DataFrame:
    """(id, FOLDED) of ``bitmaps`` (id, BITS): the parities of a quarter of the bits."""
    quarters = [reduce(Column.bitwiseXOR, [F.col(b) for b in BITS[i :: len(FOLDED)]]).alias(f) for i, f in enumerate(FOLDED)]
    return bitmaps.select("id", *quarters)


def _alike(x: str, y: str, least: float, bits: tuple[str, ...]) -> Column:
    """Whether the bitmaps of the sets of rows x and y differ in few enough bits."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in bits])
    return differ <= n + m - 2 * F.ceil(least / (1 + least) * (n + m) - TINY)


def _fits(x: str, y: str, least: float, bits: tuple[str, ...] = BITS) -> Column:
    """Whether the sets of rows x and y that meet at a key can be similar enough: by their sizes, by what can
    follow the key, and by the bits in which their bitmaps differ."""
    n, m, pos, at = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
    most = F.least(n - pos, m - at)
    both = F.ceil(least / (1 + least) * (n + m) - TINY)
    return (F.least(n, m) >= least * F.greatest(n, m) - TINY) & (most >= both) & _alike(x, y, least, bits)


def _similar(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar, compared over the words themselves. Only their texts
    move."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, kept, last, x = batch.slice(i, 256), [], None, set()
                left, right = (byte_texts(part.column(c)) for c in (2, 3))
                for n, (s, t) in enumerate(zip(left, right)):
                    if s != last:
                        last, x = s, shingles(s, k)
                    y = shingles(t, k)
                    both = len(x & y)
                    if both >= least * (len(x) + len(y) - both) - TINY:
                        kept.append(n)
                got = part.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], names=["a", "b"])
        release_memory()

    near = save(pairs.select("a", "b"), "near-pairs")
    ids = save(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    wanted = texts.join(ids, "id", "left_semi")
    s, t = (wanted.select(F.col("id").alias(c), F.col("text").alias(n)) for c, n in (("a", "s"), ("b", "t")))
    # Spark takes whole texts for short strings, and would broadcast them
    both = near.join(s, "a").join(t.hint("merge"), "b").select("a", "b", "s", "t")
    return save(both.mapInArrow(compare, "a long, b long"), "similar")


def _unconnected(hits: DataFrame, links: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``hits`` with their root over ``links`` and their bitmap, at the keys that still hold several roots.
    Bitmaps, the widest part, are joined when the table is read."""
    roots = save(components(links), "near-roots")
    known = hits.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = known.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
    return save(known.join(mixed, "key"), "near-open").join(bitmaps, "id")


def _to_centres(hits: DataFrame, bitmaps: DataFrame, seeds: tuple[int, ...], least: float) -> DataFrame:
    """Candidates (a, b): each node of ``hits``, which have the folded bitmaps, with one node of its keys for each
    of ``seeds``. An order of the ids picks a centre of each key, and the first of the centres that fit, by whole
    bitmaps too, for each node, so there are no more candidates than nodes times seeds. Seed 0 puts first the nodes
    that share the most of their keys with others: those with which most of a loose group is linked. The other
    orders are by hash."""
    names = ("id", "n", "pos", "root", *FOLDED)
    shared = hits.groupBy("id").agg(F.count("*").alias("shared"))
    known = hits.join(shared, "id")
    order = {i: F.struct((F.lit(0) if i else -F.col("shared")).cast("long").alias("shared"), F.xxhash64("id", F.lit(i)).alias("hash")) for i in seeds}
    picked = known.groupBy("key").agg(*[F.min_by(F.struct(*names, order[i].alias("order")), order[i]).alias(f"c{i}") for i in seeds])
    centres = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), *[F.col(f"c{i}.{c}").alias(c) for c in (*names, "order")]) for i in seeds])).alias("c")
    met = hits.join(picked, "key").select(*names, centres).filter(F.col("root") != F.col("c.root")).filter(_fits("", "c.", least, FOLDED))
    pairs = met.select("id", "n", "c.seed", F.col("c.id").alias("centre"), F.col("c.n").alias("m"), "c.order").distinct()
    own, other = (bitmaps.select(F.col("id").alias(c), F.struct(*BITS).alias(x)) for c, x in (("id", "x"), ("centre", "y")))
    held = pairs.join(own, "id").join(other, "centre").select("id", "seed", "centre", "order", F.struct("n", "x.*").alias("x"), F.struct(F.col("m").alias("n"), "y.*").alias("y"))
    best = held.filter(_alike("x.", "y.", least, BITS)).groupBy("id", "seed").agg(F.min_by("centre", "order").alias("centre"))
    return best.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _with_earlier(hits: DataFrame) -> DataFrame:
    """``hits`` with ``earlier``, the keys that stand just before each key among its node's, in the order of
    shingles."""
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(-EARLIER, -1)
    return hits.withColumn("earlier", F.collect_list("key").over(before))


def _meeting(open_: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) among ``open_``: the nodes of other roots that fit at a key, less where they meet again
    after one of the keys just before it. The first key that two sets have in common, at which ``_fits`` rejects no
    linked pair, has no such key before it, so no link is lost."""
    known = _with_earlier(open_)
    x, y = known.alias("x"), known.filter("indexed").alias("y")
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.id") < F.col("x.id")))
    fits = _fits("x.", "y.", least) & ~F.arrays_overlap("x.earlier", "y.earlier")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & smaller & fits)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _by_print(nodes: DataFrame, radius: int) -> DataFrame:
    """Candidates (a, b) of ``nodes`` (id, print): the nodes of one fingerprint with one of them, and the
    pigeonring's links to centres, for one node of each fingerprint."""
    prints = save(nodes.groupBy("print").agg(F.min("id").alias("rep")), "near-prints")
    same = nodes.join(prints, "print").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = simhash.to_centres(simhash.meetings(prints.select(F.col("print").alias("fingerprint")), radius), radius)
    a, b = (prints.select(F.col("print").alias(c), F.col("rep").alias(f"id_{c}")) for c in ("a", "b"))
    named = links.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return same.unionByName(named).distinct()


def near_copies(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, radius: int = simhash.RADIUS, crowd: int = CROWD) -> DataFrame:
    """``docs`` (with doc_id and text) with ``component_id``, the smallest doc_id reachable over links, and
    ``kept``, true for one row of each component: the one of smallest doc_id, null ids last, the first such
    row. Texts without words are one node. Repeated rows and rows that share an id are rows of their own,
    of which at most one is kept; a component of null ids alone has a null component_id. ``crowd`` bounds the
    work, not the result."""
    marked = _marked(docs, shingle)
    with passing(docs.sparkSession):
        named = _components_of(marked, least, shingle, radius, crowd)
    out = marked.join(named, "__digest").withColumn("kept", F.col("__row") == F.col("__best"))
    return out.select(*[c for c in marked.columns if c not in ADDED], "component_id", "kept")


def _components_of(marked: DataFrame, least: float, shingle: int, radius: int, crowd: int) -> DataFrame:
    """(__digest, component_id, __best) for each digest of ``marked``, saved: __best is the __row that is kept."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row"))
    nodes = save(marked.groupBy("__digest").agg(F.min("__row").alias("id"), F.min(rank).alias("first"), F.min("__print").alias("print"), *[F.min(f"__{b}").alias(b) for b in BITS]), "near-nodes")
    first = nodes.select("__digest", "id")
    copies = save(marked.select("__row", "__digest").join(first, "__digest").filter("__row <> id").select(F.col("__row").alias("id")), "near-exact")
    texts = marked.select(F.col("__row").alias("id"), "text").join(copies, "id", "left_anti")

    links = _similar(_by_print(nodes.select("id", "print"), radius), texts, shingle, least)
    with passing(marked.sparkSession):
        hits = _spread_keys(texts, shingle, least, crowd)
    bitmaps = nodes.select("id", *BITS)
    links = links.unionByName(_similar(_to_centres(_unconnected(hits, links, folded(bitmaps)), bitmaps, CENTRES, least), texts, shingle, least))
    more = _similar(_meeting(_unconnected(hits, links, bitmaps), least).distinct(), texts, shingle, least)

    roots = components(links.unionByName(more))
    grouped = nodes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("best"))
    named = grouped.join(smallest, "root").select("__digest", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("__best"))
    return save(named, "near-named", lasting=True)
