"""Column names that no input column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(base: str, *frames: DataFrame) -> str:
    """``base``, with as many underscores behind it as the columns of ``frames`` make necessary. Spark
    compares names without case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base
