"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(u, v) of any integers -> (id, component) for every id in an edge; component is the smallest id reachable.

    Each round is two aggregates and two joins on the edge table, whose size never grows, and one look whether only stars are left; a hub's
    rows meet only in aggregates with map-side partials and in joins that AQE may split. Null ends and loops count for nothing.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = scratch.keep(edges, "edges")
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, large.u == least.c).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        small = scratch.keep(small, "small")
        scratch.drop(large, edges)
        edges = small
        # done when every edge leads straight to a least node: what stands on the left does so once, and never on the right
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("left"), F.lit(0).alias("right")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("left").alias("left"), F.max("right").alias("right")).where("left > 1 OR left = 1 AND right = 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
