"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v): every node's larger (or smaller) neighbours are tied to its smallest neighbour.

    A hub's rows are never gathered: its smallest neighbour comes from an
    aggregation with partial minima, is written, and is joined back; both sides
    of that join are shuffled for it, so Spark can split the hub's.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = common.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none: a forest of stars."""
    ends = edges.select(F.greatest("u", "v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.least("u", "v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0")
    return odd.isEmpty()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the edges (u long, v long).

    Self-links and nulls are ignored; nodes without links are not returned.
    Each round's table is written to the shared folder.
    """
    pair = edges.select(F.greatest(F.col("u").cast("long"), F.col("v").cast("long")).alias("u"), F.least(F.col("u").cast("long"), F.col("v").cast("long")).alias("v"))
    edges = common.save(pair.where("u <> v").distinct(), "links")
    for _ in range(most):
        if _settled(edges):
            break
        after = common.save(_star(_star(edges, True), False), "links")
        common.drop(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
