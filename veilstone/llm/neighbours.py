"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own; a cell is a pair of centroids. A
query walks the cells in order of summed distance with a heap (the multi-sequence walk) until the cells
walked hold the wanted share of all entries; those entries are ranked by their exact distance.

Codebooks are fitted on at most ``SAMPLE`` vectors, and every row is indexed. The share to walk is
measured on the sample, against brute force there, for a recall of ``recall``: little for clustered
vectors, about half for vectors without structure.

Of equal vectors only the k+1 of smallest id can be among a query's k nearest, so no more are kept: the
limit per vector works before the shuffle, and many copies of one vector don't meet. Equal query vectors
are searched once. Cells are ranked in blocks of ``BLOCK`` entries and ``QUERIES`` queries, so neither a cell
that many vectors lie in nor one that many queries visit is one task's.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows with a null id. Rows that repeat an id and vector count as one. Fewer than k other rows
give as many as there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SAMPLE, BLOCK, QUERIES, MOST_CENTROIDS, PROBES = 20_000, 8192, 4096, 256, 256


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = distances(x, centroids).argmin(1)
        sums, n = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, for ranking cells only."""
    return (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None, :]


class MultiIndex:
    """Two codebooks, the number of entries in each cell, and the entries a walk must hold."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.counts: dict[int, int] = {}

    @classmethod
    def fit(cls, sample: np.ndarray, centroids: int) -> MultiIndex:
        half = sample.shape[1] // 2
        return cls(kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids, seed=1))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return distances(x[:, :half], self.first), distances(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, entries: int) -> list[int]:
        """Cells with entries, nearest first by a + b, until they hold ``entries`` (or all)."""
        i_order, j_order = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b = a[i_order].tolist(), b[j_order].tolist()
        i_order, j_order = i_order.tolist(), j_order.tolist()
        heap, seen, out, width = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], len(b)
        while heap and entries > 0:
            _, i, j = heapq.heappop(heap)
            cell = i_order[i] * width + j_order[j]
            if n := self.counts.get(cell, 0):
                out.append(cell)
                entries -= n
            for p in ((i + 1, j), (i, j + 1)):
                if p[0] < len(a) and p[1] < width and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (a[p[0]] + b[p[1]], *p))
        return out

    def share(self, sample: np.ndarray, k: int, recall: float) -> float:
        """Share of entries a walk must hold to meet ``recall`` of the sample's true k nearest."""
        if len(sample) <= k + 1:
            return 1.0
        own = self.cells(sample)
        sizes = np.bincount(own, minlength=len(self.first) * len(self.second))
        probes = np.arange(0, len(sample), max(1, len(sample) // PROBES))
        need = []
        for lo in range(0, len(probes), 32):
            rows = probes[lo : lo + 32]
            d = distances(sample[rows], sample)
            d[np.arange(len(rows)), rows] = np.inf
            near = np.argpartition(d, k, axis=1)[:, :k]
            a, b = self.halves(sample[rows])
            order = (a[:, :, None] + b[:, None, :]).reshape(len(rows), -1).argsort(1)
            held = np.empty(order.shape)
            np.put_along_axis(held, order, np.cumsum(sizes[order], 1).astype(float), 1)
            need.append(np.take_along_axis(held, own[near], 1).ravel())
        return min(1.0, float(np.quantile(np.concatenate(need), recall)) / len(sample))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.95, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) with ``is_query``: its k nearest other rows found,
    as query_id, rank (from 1), vec_id, score (Euclidean distance in double precision)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == lengths[0]["d"]).withColumn("q", F.coalesce("q", F.lit(False)))
    few = Window.partitionBy("v").orderBy("vec_id")
    entries = save(rows.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1).drop("n"), "entries")
    queries = save(rows.filter("q").select("vec_id", "v").distinct(), "query-rows")
    total = entries.count()

    # at most SAMPLE vectors
    sample = _matrix(entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0))
    index = MultiIndex.fit(sample, int(min(MOST_CENTROIDS, max(2, round(total**0.25)))))
    wanted = int(np.ceil(index.share(sample, k, recall) * total)) + k
    shared = spark.sparkContext.broadcast((index.first, index.second))  # MOST_CENTROIDS rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MultiIndex(*shared.value)
        for b in batches:
            cells = own.cells(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), b.column(0), b.column(1)], names=["cell", "vec_id", "v"])

    kind = dict(entries.dtypes)["v"]
    placed = save(entries.mapInArrow(place, f"cell long, vec_id long, v {kind}"), "cells")
    counts = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}  # MOST_CENTROIDS squared at most
    sizes = spark.sparkContext.broadcast(counts)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MultiIndex(*shared.value)
        own.counts = sizes.value
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [own.walk(x, y, wanted) for x, y in zip(*own.halves(_matrix(part.column(1))))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["qid", "v", "cells"])

    searched = queries.groupBy("v").agg(F.min("vec_id").alias("qid"))
    walked = save(searched.select("qid", "v").mapInArrow(walk, f"qid long, v {kind}, cells array<long>"), "walks")
    # blocks of a cell: MOST_CENTROIDS squared rows at most
    held = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    asked = walked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / query_block).alias("parts"))
    cut = save(held.join(asked, "cell"), "cell-blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    visits = walked.select("qid", "v", F.explode("cells").alias("cell")).join(cut, "cell")
    visits = visits.withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts"))).withColumn("block", each("blocks")).select("cell", "block", "part", "qid", "v")
    dealt = placed.join(cut, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    dealt = dealt.withColumn("part", each("parts")).select("cell", "block", "part", "vec_id", "v")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = left.column("vec_id").to_numpy(), ([], [], [])
        if left.num_rows and right.num_rows:
            held = _matrix(left.column("v"))
            for qid, q in zip(right.column("qid").to_pylist(), _matrix(right.column("v"))):
                gap = held - q
                d = np.sqrt((gap * gap).sum(1))
                top = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                top = top[np.lexsort((ids[top], d[top]))][: k + 1]
                for column, value in zip(found, ([qid] * len(top), ids[top].tolist(), d[top].tolist())):
                    column.extend(value)
        return pa.table({"qid": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    deal = ["cell", "block", "part"]
    ranked = dealt.groupBy(*deal).cogroup(visits.groupBy(*deal)).applyInArrow(rank, "qid long, vec_id long, score double")
    best = Window.partitionBy("qid").orderBy("score", "vec_id")
    top = ranked.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # k + 1 each
    named = queries.join(searched, "v").select(F.col("vec_id").alias("query_id"), "qid").join(lists, "qid")
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    out = named.select("query_id", F.posexplode(own).alias("n", "f"))
    return out.select("query_id", (F.col("n") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
