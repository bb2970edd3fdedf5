"""Static footprints of index programs, from interval arithmetic over the loops.

A program is a nest of loops, each with constant bounds [lo, hi), and accesses
with affine indices, each under some of the loops and run with a probability.
An access touches, in each dimension, as many places as its index's interval is
wide; it runs as often as its loops turn.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators.einsum import Affine


@dataclass(frozen=True)
class Loop:
    var: str
    lo: int
    hi: int
    spatial: bool = False


@dataclass(frozen=True)
class Use:
    tensor: str
    index: tuple[str, ...]
    depth: int  # number of loops around it, from the outermost
    update: bool = False
    probability: float = 1.0
    level: int = 0  # loops outside the buffer that serves it


def interval(a: Affine, loops: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """Half-open range of an affine index; a variable that no loop binds stands for 0."""
    lo = hi = a.constant
    for v, c in a.terms:
        b, e = loops.get(v, (0, 1))
        lo, hi = lo + min(c * b, c * (e - 1)), hi + max(c * b, c * (e - 1))
    return lo, hi + 1


def index_variables(uses: list[Use]) -> list[tuple[str, int, str]]:
    """(tensor, dimension, variable) of every index expression."""
    return sorted({(u.tensor, k, v) for u in uses for k, text in enumerate(u.index) for v, _ in Affine.parse(text).terms})


def totals(accesses: DataFrame) -> DataFrame:
    """(tensor, volume, backing, local) from analyse(): the largest volume, which is the buffer needed, and the sums of the accesses."""
    return accesses.groupBy("tensor").agg(F.max("volume").alias("volume"), F.sum("backing").alias("backing"), F.sum("local").alias("local"))


def analyse(spark: SparkSession, loops: list[Loop], uses: list[Use]) -> DataFrame:
    """(tensor, place, kind, volume, executions, backing, local): backing = probability * volume for each turn of the loops outside the buffer, local = probability * executions."""
    rows = []
    for place, u in enumerate(uses):
        around = loops[: u.depth]
        inner = {x.var: (x.lo, x.hi) for x in around[u.level :]}
        volume = prod(max(0, hi - lo) for lo, hi in (interval(Affine.parse(t), inner) for t in u.index))
        turns = prod(max(0, x.hi - x.lo) for x in around[: u.level])
        executions = prod(max(0, x.hi - x.lo) for x in around)
        rows.append((u.tensor, place, "U" if u.update else "R", volume, executions, float(u.probability * volume * turns), float(u.probability * executions)))
    return spark.createDataFrame(rows, "tensor string, place int, kind string, volume bigint, executions bigint, backing double, local double")
