"""Connected components of a link table, without a link reaching the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Links (a, b) of long ids -> (id, root), root the smallest id reachable, for every linked id.

    Rounds of large-star and small-star (each link moves to the smallest neighbour known) until nothing
    moves; about log(n) rounds. Every round is a written table, so lineage stays short and a lost
    executor costs at most one round. Star aggregates use a minimum that combines before the shuffle."""
    edges = save(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = state(edges)
    for _ in range(most_rounds):
        if not last[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = save(large, "large-star")
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = save(small.select("e.*").filter("u <> v").distinct(), "small-star")
        now = state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components: no end after {most_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
