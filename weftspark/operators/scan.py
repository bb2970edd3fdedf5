"""Strided scans of hyper-rectangles, and point arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.model import Tensor, flatten, unflatten

Point = Sequence[Column | int]


def _cols(p: Point) -> list[Column]:
    return [x if isinstance(x, Column) else F.lit(x) for x in p]


def translate(p: Point, by: Point) -> list[Column]:
    return [a + b for a, b in zip(_cols(p), _cols(by), strict=True)]


def translate_bounded(p: Point, by: Point, bounds: Point) -> list[Column]:
    """Sums that stop below the bounds."""
    return [F.least(a + b, c - 1) for a, b, c in zip(_cols(p), _cols(by), _cols(bounds), strict=True)]


def scale(p: Point, by: Point) -> list[Column]:
    return [a * b for a, b in zip(_cols(p), _cols(by), strict=True)]


def multiple_of(p: Point, of: Point) -> Column:
    out = F.lit(True)
    for a, b in zip(_cols(p), _cols(of), strict=True):
        out = out & (a % b == 0)
    return out


def permute(p: Point, order: Sequence[int]) -> list[Column]:
    c = _cols(p)
    return [c[i] for i in order]


def drop_dimension(p: Point, dim: int) -> list[Column]:
    return [x for i, x in enumerate(_cols(p)) if i != dim]


def shift(p: Point, into: Column | int) -> list[Column]:
    """Coordinates one dimension inward, a new outermost one."""
    return [*_cols([into]), *_cols(p)[:-1]]


def all_compare(a: Point, op: str, b: Point) -> Column:
    """Whether every component compares so (`<=`, `>=`, `>`, `==`)."""
    test = {"<=": Column.__le__, ">=": Column.__ge__, ">": Column.__gt__, "==": Column.__eq__}[op]
    out = F.lit(True)
    for x, y in zip(_cols(a), _cols(b), strict=True):
        out = out & test(x, y)
    return out


def flat(p: Point, shape: tuple[int, ...]) -> Column:
    return flatten(_cols(p), shape)


def unflat(value: Column, names: tuple[str, ...], shape: tuple[int, ...]) -> list[Column]:
    return unflatten(value, names, shape)


def flat_sizes(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Entries between neighbours of each dimension."""
    out, n = [], 1
    for d in reversed(shape):
        out.append(n)
        n *= d
    return tuple(out[::-1])


def strided(t: Tensor, base: Sequence[int], count: Sequence[int], stride: Sequence[int], order: Sequence[int] | None = None) -> DataFrame:
    """Entries at base + k * stride (k < count) in each dimension; with order, sorted by the dimensions so.

    Bounds reach the scan as pushed-down filters; a sorted result is range
    partitioned, never gathered.
    """
    keep = F.lit(True)
    for c, b, n, s in zip(t.index, base, count, stride, strict=True):
        keep = keep & (F.col(c) >= b) & (F.col(c) < b + n * s) & ((F.col(c) - b) % s == 0)
    out = t.df.where(keep)
    return out if order is None else out.orderBy(*[t.index[i] for i in order])


def find_key(t: Tensor, at: Sequence[int]) -> DataFrame:
    """The entry at a point, if stored."""
    return t.df.where(all_compare([F.col(c) for c in t.index], "==", at))


def has(t: Tensor, points: DataFrame) -> DataFrame:
    """points (the tensor's index columns) with whether each is stored."""
    stored = t.df.select(*t.index, F.lit(True).alias("_has")).dropDuplicates(list(t.index))
    return points.join(stored, list(t.index), "left").withColumn("has", F.coalesce("_has", F.lit(False))).drop("_has")
