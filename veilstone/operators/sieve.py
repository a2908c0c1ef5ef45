"""A sieve of bits, by which rows are left out before they are shuffled to a join that they would not pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh

BITS = 27  # a sieve has two to the power of this bits, so 16 MB


def sifted(df: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """``df`` less most of the rows whose ``keys`` (cast to the types of ``df``) aren't among those of ``known``; none
    of the others is lost, so a join that follows decides. There is a bit for each hash, in rows of 64
    longs, of which 2^15 are broadcast at most."""
    h, at, held = (fresh(c, df, known) for c in ("h", "at", "sieve"))
    hashed = lambda x: x.withColumn(h, F.pmod(F.xxhash64(*keys), F.lit(1 << BITS))).withColumn(at, F.shiftright(h, 12))
    word, bit = F.shiftright(h, 6).bitwiseAND(F.lit(63)), F.expr(f"shiftleft(1L, int({h} & 63))")
    longs = [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(64)]
    asked = known.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys])
    sieve = hashed(asked).groupBy(at).agg(F.array(*longs).alias(held))
    met = hashed(df).join(F.broadcast(sieve), at)
    return met.filter(F.get(held, word.cast("int")).bitwiseAND(bit) != 0).select(*df.columns)
