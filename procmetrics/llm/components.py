"""Connected components as alternating star joins (large star, small star), a published map-reduce method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmetrics.llm.common import clear, cut, shared_dir


def _with_least(neighbours: DataFrame) -> DataFrame:
    """Adds to each (u, v) the least of u and all its v; counted before the shuffle, joined back so that a hub's rows may be split."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return neighbours.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) of long ids; root is the least node of its component.

    Nulls and loops take no part; repeated edges count once. Each round is written to the shared folder. An empty edge table
    gives an empty result. Rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    path = shared_dir(spark, "components")
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current, seen, turn = cut(edges.distinct(), f"{path}/0"), None, 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        turn += 1
        current = cut(stars.where("u <> v").distinct(), f"{path}/{turn}")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        clear(spark, path, (str(turn),))  # a round reads the one before alone
        if state == seen:
            break
        seen = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
