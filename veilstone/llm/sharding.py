"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Every row gets a number 0..N-1 that depends on its content alone. A generalised Feistel network
permutes the rectangle a x b that just covers N; a number that lands outside 0..N-1 walks its cycle
until it is inside. The permuted number p gives ``shard = p % shards`` and ``slot = p div shards``,
so shard sizes differ by one at most and slots have no gaps (the law ``rows``).

Only DataFrame expressions are used. Two narrow shuffles (no payload column is moved): one counts
equal rows before anything is sorted, one numbers rows inside content-hash blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, save

ROWS_PER_BLOCK = 4096
MOST_BLOCKS = 65536
ROUNDS = 6
PRIME = 2147483647  # products of two residues stay inside a signed 64-bit integer


def block_of(keys: list[Column], blocks: int) -> Column:
    """Block of a row, from its content: a polynomial of the keys, so no key value is hot."""
    h = F.lit(7).cast("long")
    for k in keys:
        h = (h * 1000003 + F.pmod(F.coalesce(k.cast("long"), F.lit(-1)), F.lit(PRIME))) % PRIME
    return h % blocks


def rectangle(n: int) -> tuple[int, int]:
    """Sides (a, b) with a*b >= n and the fewest cells beyond n, near the square root."""
    root = max(1, math.isqrt(max(n, 1)))
    best = min(range(max(1, root - 2048), root + 1), key=lambda a: (a * -(-n // a) - n, -a))
    return best, max(1, -(-n // best))


def round_keys(seed: int) -> list[tuple[int, int]]:
    state, keys = seed % PRIME, []
    for _ in range(2 * ROUNDS):
        state = (state * 48271 + 11) % PRIME
        keys.append(state + 1)
    return list(zip(keys[::2], keys[1::2]))


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network: a bijection of 0..a*b-1. Rounds add a keyed quadratic residue of one
    half to the other half, in turn."""
    state = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    keys = F.array(*[F.struct(F.lit(i % 2).alias("odd"), F.lit(k[0]).cast("long").alias("m"), F.lit(k[1]).cast("long").alias("c")) for i, k in enumerate(round_keys(seed))])

    def turn(s: Column, k: Column) -> Column:
        half = F.when(k["odd"] == 0, s["r"]).otherwise(s["l"])
        t = (half * k["m"] + k["c"]) % PRIME
        t = (t * t + half + k["c"]) % PRIME
        return F.struct(
            F.when(k["odd"] == 0, (s["l"] + t) % a).otherwise(s["l"]).alias("l"),
            F.when(k["odd"] == 0, s["r"]).otherwise((s["r"] + t) % b).alias("r"),
        )

    return F.aggregate(keys, state, turn, lambda s: s["r"] * a + s["l"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """Place of row number ``x`` among 0..n-1. A cycle leaves 0..n-1 at most a*b-n times in a row, so
    that many further passes always end the walk; they run only for rows that land outside."""
    a, b = rectangle(n)
    outside = a * b - n
    once = feistel(x, a, b, seed)
    if not outside:
        return once
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(outside)), once,
        lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed)),
    )


def feistel_shards(df: DataFrame, keys: list[str], shards: int, seed: int = 20240131) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long).

    ``keys`` are integer columns that identify a row; give a narrow frame (identity and digests) and
    join the payload to the result where it is needed. Rows equal in every column are interchangeable
    and share out the places of their group. Null keys count as a value of their own; an empty table
    gives an empty result. Columns named shard or slot are replaced; other names don't matter.
    """
    df = df.drop("shard", "slot")
    given = {c: f"c{i}" for i, c in enumerate(df.columns)}  # names of our own for all columns until the end
    df, names, keys = df.toDF(*given.values()), list(given.values()), [given[k] for k in keys]
    groups = save(df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")), "shard-rows")
    n = int(groups.agg(F.sum("__n")).first()[0] or 0)
    blocks = blocks_for(n, ROWS_PER_BLOCK, MOST_BLOCKS)
    groups = groups.withColumn("__block", block_of([F.col(k) for k in keys], blocks))
    # At most MOST_BLOCKS rows, whatever the size of the input.
    sizes = groups.groupBy("__block").agg(F.sum("__n").alias("__size")).collect()
    base, bases = 0, []
    for block, size in sorted((r[0], r[1]) for r in sizes):
        bases.append((block, base))
        base += size
    bases = df.sparkSession.createDataFrame(bases, "__block long, __base long")
    before = Window.partitionBy("__block").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    step = 65536  # a large group opens in two steps, so no array of all its rows is ever built
    numbered = (
        groups.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .join(F.broadcast(bases), "__block")
        .withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / step).cast("long"))))
        .withColumn("__i", F.explode(F.sequence(F.col("__part") * step, F.least(F.col("__n"), (F.col("__part") + 1) * step) - 1)))
        .withColumn("__row", F.col("__base") + F.col("__from") + F.col("__i"))
        .withColumn("__p", permuted(F.col("__row"), max(n, 1), seed))
    )
    shown = [F.col(own).alias(c) for c, own in given.items()]
    return numbered.select(*shown, (F.col("__p") % shards).cast("int").alias("shard"), F.floor(F.col("__p") / shards).cast("long").alias("slot"))
