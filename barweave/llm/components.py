"""Connected components by alternating star contraction; nothing of the graph comes to the driver but two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of the component, and has a row too.

    In each round every node hands its larger neighbours, then its smaller ones, to the smallest node it knows. The
    number of rounds grows with the logarithm of the component's size; edges never become more than they were. A node's
    edges meet in one task by its key: of a component of millions of nodes the hub's rows (two longs each) do, unless the
    adaptive skew join splits them.
    """
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    before = _sums(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))
        ).distinct()
        now = written(small, "components")
        after = _sums(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
