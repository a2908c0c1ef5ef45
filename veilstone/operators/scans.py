"""Prefix scans in two levels, for keys that are too large for one task.

A window over a whole key runs in one task. Here the rows of a key are cut into blocks that follow each other
in the scan's order; windows run inside (key, block), a small window runs over a row per block, and each block
gets what stands before it by a join on (key, block). A task holds a block, or the block summaries of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh

FIRST = Window.unboundedPreceding


def carried(rows: DataFrame, key: str, block: str, **sums: tuple[Column, str]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: (value, "sum" or "max") of all rows of the key in earlier
    blocks, null for max and 0 for sum in the first. ``rows`` is read twice; write it before where it is
    costly to make."""
    of = {"sum": F.sum, "max": F.max}
    total = rows.groupBy(key, block).agg(*[of[how](value).alias(name) for name, (value, how) in sums.items()])
    before = Window.partitionBy(key).orderBy(block).rowsBetween(FIRST, -1)
    scans = {name: of[how](name).over(before) for name, (_, how) in sums.items()}
    scans = {name: F.coalesce(c, F.lit(0)) if sums[name][1] == "sum" else c for name, c in scans.items()}
    carry = total.select(key, block, *[c.alias(name) for name, c in scans.items()])
    right = [fresh(f"__{c}", rows, carry) for c in (key, block)]
    carry = carry.withColumnsRenamed({key: right[0], block: right[1]})
    return rows.join(carry, rows[key].eqNullSafe(carry[right[0]]) & rows[block].eqNullSafe(carry[right[1]])).drop(*right)


def running(rows: DataFrame, key: str, order: list[Column], block: str | None = None, upto: int = 0, **sums: tuple[Column, str]) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum or maximum of the value from the key's first row up
    to this one (``upto`` 0) or the one before it (-1), in the order of (block, ``order``). Without ``block`` it
    is one window per key. Empty sums are 0, empty maxima null."""
    of = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy(key, *([block] if block else [])).orderBy(*order).rowsBetween(FIRST, upto)
    made = {n: of[how](value).over(inside) for n, (value, how) in sums.items()}
    made = {n: F.coalesce(c, F.lit(0)) if sums[n][1] == "sum" else c for n, c in made.items()}
    if not block:
        return rows.withColumns(made)
    names = {n: fresh(f"__{n}", rows) for n in sums}
    held = carried(rows, key, block, **{names[n]: s for n, s in sums.items()})
    both = {n: F.col(names[n]) + c if sums[n][1] == "sum" else F.greatest(F.col(names[n]), c) for n, c in made.items()}
    return held.withColumns(both).drop(*names.values())
