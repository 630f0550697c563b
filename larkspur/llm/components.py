"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a minimum by node, which is aggregated before the shuffle, and a join of that minimum back
to the edges. The number of edges never grows, and nothing is collected but one bit a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one: then parents name the components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).filter("child > 1 OR (child = 1 AND parent = 1)").isEmpty()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for the nodes of an edge list of longs; a component is named by its least node."""
    now = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        now = materialize(_small_star(_large_star(now)), "edges")
        if _is_forest_of_stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
