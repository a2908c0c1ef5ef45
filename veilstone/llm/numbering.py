"""Row numbers in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from .common import save

PART_BITS = 33  # monotonically_increasing_id keeps the partition above so many bits


def numbered(df: DataFrame, order: list[Column], name: str, column: str = "row_no") -> DataFrame:
    """``df`` with ``column``: 0, 1, 2... in ``order`` over the whole table. A column of that name is replaced.

    Rows are dealt by ranges of the order, sorted inside their partition and written; a row's number is its
    place there plus the rows of all partitions before. Only the partitions' sizes meet in one task, and
    their sums are broadcast: a row for each partition of the shuffle. Equal rows get successive numbers."""
    df = df.drop(column)
    m, part, base = (fresh(c, df) for c in ("__m", "__part", "__base"))
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(m, F.monotonically_increasing_id())
    placed = save(ordered, name).withColumn(part, F.shiftright(m, PART_BITS))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    place = F.col(m).bitwiseAND(F.lit((1 << PART_BITS) - 1)) + F.col(base)
    return placed.join(F.broadcast(bases), part).withColumn(column, place).drop(m, part, base)
