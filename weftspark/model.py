"""Data model: tensors in coordinate form and graphs as edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tensor:
    """Non-zero entries: index columns (outermost first), a value column, and the size of each dimension. A missing entry is 0."""

    df: DataFrame
    index: tuple[str, ...]
    shape: tuple[int, ...]
    value: str = "v"

    def __post_init__(self):
        if len(self.index) != len(self.shape):
            raise ValueError("a size for each index is needed")

    def port(self, alias: str) -> Tensor:
        """A second way to the same values."""
        return Tensor(self.df.alias(alias).select("*"), self.index, self.shape, self.value)

    def rename(self, *names: str) -> Tensor:
        return Tensor(self.df.select(*[F.col(a).alias(b) for a, b in zip(self.index, names, strict=True)], self.value), names, self.shape, self.value)

    def nonzero(self) -> Tensor:
        return Tensor(self.df.where(F.col(self.value) != 0), self.index, self.shape, self.value)

    def dense(self) -> Tensor:
        """All entries, zeros included: for results that a program writes out in full."""
        n = 1
        for d in self.shape:
            n *= d
        ids = self.df.sparkSession.range(n)
        full = ids.select(*unflatten(F.col("id"), self.index, self.shape))
        value = F.coalesce(F.col(self.value), F.lit(0)).alias(self.value)
        return Tensor(full.join(self.df, list(self.index), "left").select(*self.index, value), self.index, self.shape, self.value)

    def fill(self, value: Column) -> Tensor:
        """Every entry from a function of the index columns."""
        n = 1
        for d in self.shape:
            n *= d
        full = self.df.sparkSession.range(n).select(*unflatten(F.col("id"), self.index, self.shape))
        return Tensor(full.withColumn(self.value, value), self.index, self.shape, self.value)

    def transform(self, value: Column) -> Tensor:
        return Tensor(self.df.select(*self.index, value.alias(self.value)), self.index, self.shape, self.value)

    def resize(self, *shape: int) -> Tensor:
        """Other sizes: entries beyond them go, what is new is 0."""
        keep = F.lit(True)
        for c, d in zip(self.index, shape, strict=True):
            keep = keep & (F.col(c) < d)
        return Tensor(self.df.where(keep), self.index, shape, self.value)

    def with_values(self, points: DataFrame) -> Tensor:
        """New values at the points (index columns, value column; each index once), stored before or not."""
        new = points.select(*self.index, F.col(self.value).cast("bigint").alias("_new"))
        both = self.df.join(new, list(self.index), "full_outer")
        return Tensor(both.select(*self.index, F.coalesce("_new", self.value).alias(self.value)), self.index, self.shape, self.value)

    def listing(self) -> DataFrame:
        """(place, line): a line of text for each entry, place being its row-major number; sort by it to print."""
        cells = F.concat_ws(", ", *[F.col(c).cast("string") for c in self.index])
        return self.df.select(flatten([F.col(c) for c in self.index], self.shape).alias("place"), F.concat(F.lit("["), cells, F.lit("] = "), F.col(self.value).cast("string")).alias("line"))

    def storage(self) -> dict[str, int]:
        """Entries stored, and what a dense array would hold."""
        dense = 1
        for d in self.shape:
            dense *= d
        return {"entries": self.df.count(), "dense": dense}

    def reshape(self, index: tuple[str, ...], shape: tuple[int, ...]) -> Tensor:
        """The same flat order under other dimensions."""
        flat = flatten([F.col(c) for c in self.index], self.shape)
        return Tensor(self.df.select(flat.alias("_flat"), self.value).select(*unflatten(F.col("_flat"), index, shape), self.value), index, shape, self.value)


def flatten(columns: list[Column], shape: tuple[int, ...]) -> Column:
    """Row-major place of an index."""
    out = F.lit(0).cast("long")
    for c, d in zip(columns, shape, strict=True):
        out = out * F.lit(d) + c
    return out


def unflatten(flat: Column, names: tuple[str, ...], shape: tuple[int, ...]) -> list[Column]:
    """Index columns of a row-major place."""
    out, rest = [], flat
    for name, d in zip(reversed(names), reversed(shape), strict=True):
        out.append((rest % d).cast("int").alias(name))
        rest = F.floor(rest / d)
    return out[::-1]


@dataclass(frozen=True)
class Graph:
    """Edges (s, d and, where it matters, w and pos: the place of an edge in its row) over vertices 0 to n - 1."""

    edges: DataFrame
    n: int

    @property
    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(self.n).select(F.col("id").cast("int").alias("v"))

    def out_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("s").alias("v")).agg(F.count(F.lit(1)).alias("deg"))

    def in_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("d").alias("v")).agg(F.count(F.lit(1)).alias("deg"))

    def degrees(self) -> DataFrame:
        """(v, out_deg, in_deg) of all vertices."""
        out, into = self.out_degree().withColumnRenamed("deg", "o"), self.in_degree().withColumnRenamed("deg", "i")
        return self.vertices.join(out, "v", "left").join(into, "v", "left").select("v", F.coalesce("o", F.lit(0)).alias("out_deg"), F.coalesce("i", F.lit(0)).alias("in_deg"))

    def symmetric(self) -> Graph:
        """Edges both ways, once each, without loops."""
        both = self.edges.select("s", "d").unionByName(self.edges.select(F.col("d").alias("s"), F.col("s").alias("d")))
        return Graph(both.where("s <> d").distinct(), self.n)

    @staticmethod
    def from_adjacency(matrix: Tensor, edge: Column | None = None) -> Graph:
        """Edges where the predicate holds (by default: entry not 0) of a square matrix."""
        s, d = matrix.index
        return Graph(matrix.df.where(F.col(matrix.value) != 0 if edge is None else edge).select(F.col(s).alias("s"), F.col(d).alias("d"), F.col(matrix.value).alias("w")), matrix.shape[0])

    @staticmethod
    def from_rows(offsets: DataFrame, targets: DataFrame, n: int, by_source: bool = True) -> Graph:
        """From offsets (v, off; n + 1 rows) and targets (pos, t): sources' rows, or destinations' if not by_source.

        Rows' ranges are met by the positions inside them block by block; no
        range is spread out, so a hub's row is many tasks.
        """
        from weftspark.operators import scans

        nxt = offsets.select((F.col("v") - 1).alias("v"), F.col("off").alias("stop"))
        ranges = offsets.join(nxt, "v").select("v", F.col("off").alias("start"), "stop")
        own, other = ("s", "d") if by_source else ("d", "s")
        return Graph(scans.with_owner(targets, ranges, "pos", "v").select(F.col("v").alias(own), F.col("t").alias(other), "pos"), n)
