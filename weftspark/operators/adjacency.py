"""Edges that stay in place over the rounds of a fixpoint.

They are written once, bucketed by one end. A round ships what the vertices of
a front send to the buckets, and the messages to the vertices that get them; no
edge is shuffled again. A hub's edges are dealt out over several parts by their
other end, so that no bucket holds much more than its share, and the hub's row
in the front is copied to each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark import storage

#: Edges at one end that never make a hub.
HUB = 1 << 16


class Adjacency:
    """Edges by the end `key`; degrees (v, deg) of the vertices that have edges there."""

    def __init__(self, edges: DataFrame, key: str = "s", other: str = "d", hub: int | None = None):
        self.key = key
        degrees = edges.groupBy(F.col(key).alias("v")).agg(F.count(F.lit(1)).alias("deg"))
        self.degrees = storage.save_bucketed(degrees, ["v"], "degrees", dealt=True, total=F.sum("deg"), most=F.max("deg"))
        self.total = self.degrees._weft_seen.get("total") or 0
        share = max(HUB if hub is None else hub, math.ceil(self.total / storage.buckets(edges.sparkSession)))
        self.split = (self.degrees._weft_seen.get("most") or 0) > share
        by, rows = [key], edges
        if self.split:
            # no more hubs than buckets: each has more than a bucket's share of all edges
            self.hubs = F.broadcast(self.degrees.where(F.col("deg") > share).select("v", F.ceil(F.col("deg") / share).cast("int").alias("parts")))
            part = F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0)).cast("int")
            rows, by = edges.join(self.hubs.withColumnRenamed("v", key), key, "left").withColumn("part", part).drop("parts"), [key, "part"]
        self.edges = storage.save_bucketed(rows, by, "edges")

    def send(self, front: DataFrame, small: bool = False) -> DataFrame:
        """The edges of the vertices (v) of a front, with its other columns; small: it was counted and may be broadcast."""
        rows, on = front.withColumnRenamed("v", self.key), [self.key]
        if self.split:
            parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
            rows, on = rows.join(self.hubs.withColumnRenamed("v", self.key), self.key, "left").withColumn("part", parts).drop("parts"), [self.key, "part"]
        out = self.edges.join(F.broadcast(rows) if small else rows, on)
        return out.drop("part") if self.split else out

    def drop(self) -> None:
        storage.drop(self.edges, self.degrees)
