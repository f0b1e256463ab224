"""Connected components by alternating star contraction; lineage is cut in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.lineage import checkpointed


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) of every end of the edges (a, b); component is the smallest id of it.

    Large star, then small star, until no edge changes; the number of rounds grows with the logarithm of the
    longest path.  Minima are pre-aggregated, so a vertex with very many edges is combined before the shuffle.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = checkpointed(current)
    before = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = checkpointed(small.where("u <> v").distinct())
        state = current.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    found = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
