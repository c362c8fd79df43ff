"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join, which adaptive
execution may split where one node has many neighbours. No component is ever gathered in
one place. Each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node u to the smaller v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node that points does so once, at one that does not: then the edges are stars."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").take(1)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node that it can reach.

    edges: two columns of comparable ids, in any direction, repeats and loops allowed; edges with
    a null end are ignored. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    now = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", narrow=True)
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        after = stage(_small_star(_large_star(now)), "edges", narrow=True)
        unstage(spark, now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
