"""Random tensors and graphs, the same for a seed on any cluster: every draw is a hash of seed and place."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftspark.model import Graph, Tensor, unflatten
from weftspark.operators.sparse import degree_order, exclusive_sum, relabel


def uniform(seed: int, *place: Column | str) -> Column:
    """A number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *place), 11) / F.lit(float(1 << 53))


def normal(seed: int, *place: Column | str) -> Column:
    a, b = uniform(seed, *place, F.lit(1)), uniform(seed, *place, F.lit(2))
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def random_tensor(spark: SparkSession, index: tuple[str, ...], shape: tuple[int, ...], lo: int, hi: int, seed: int = 0, monotonic: bool = False) -> Tensor:
    """Whole numbers in [lo, hi); monotonic: their running sums in flat order."""
    n = math.prod(shape)
    draw = spark.range(n).withColumn("v", (F.floor(uniform(seed, "id") * (hi - lo)) + lo).cast("bigint"))
    if monotonic:
        draw = exclusive_sum(draw, "id", "v", "_before").withColumn("v", F.col("_before") + F.col("v")).drop("_before")
    return Tensor(draw.select(*unflatten(F.col("id"), index, shape), "v"), index, shape)


#: Fixed values of the long-tailed law: the chance of a first entry, where chances stop rising, and how much of what is left each adds.
LONG_TAIL = (0.2, 0.9, 0.3)
#: Exponent of the power law.
POWER = 20


def long_tail(draw: Column) -> Column:
    """How many rolls in a row succeed, their chances rising from entry to entry until they saturate."""
    chance, most, scale = LONG_TAIL
    steps, reached = [], 1.0
    while chance < most:
        reached *= chance
        steps.append(reached)
        chance += (1 - chance) * scale
    early = sum(((draw < p).cast("int") for p in steps), F.lit(0))
    late = F.floor(F.log(draw / reached) / math.log(chance))
    return F.when(draw < reached, len(steps) + late).otherwise(early).cast("double")


def power_law(draw: Column, n: int) -> Column:
    """n less a number of [0, n] whose density rises with the power POWER: few entries mostly, n at most."""
    return n - n * F.pow(draw, F.lit(1 / (POWER + 1)))


#: Draws of a row's expected entries from its place: name -> (seed, n, mean, row) -> Column.
DISTRIBUTIONS = {
    "uniform": lambda seed, n, mean, row: F.floor(uniform(seed, row) * (2 * mean)) + 1.0,
    "binomial": lambda seed, n, mean, row: F.greatest(F.lit(0.0), mean + normal(seed, row) * math.sqrt(mean * (1 - mean / n))),
    "normal": lambda seed, n, mean, row: F.greatest(F.lit(0.0), mean + normal(seed, row) * (mean / 4)),
    "exponential": lambda seed, n, mean, row: -F.log(1 - uniform(seed, row)) * mean,
    "power-law": lambda seed, n, mean, row: power_law(uniform(seed, row), n),
    "long-tail": lambda seed, n, mean, row: long_tail(F.greatest(uniform(seed, row), F.lit(2.0**-53))),
}


def sparse_graph(spark: SparkSession, n: int, mean: float | None = None, distribution: str = "uniform", seed: int = 0, symmetric: bool = True, by_degree: bool = True) -> Graph:
    """A random pattern: each row draws its entries' number, then each of them a column. by_degree: vertices by falling degree.

    mean is for the laws that have one (n / 2 if not given, which makes uniform numbers of 1 to n).
    """
    mean = n / 2 if mean is None else mean
    per_row = F.least(DISTRIBUTIONS[distribution](seed, n, mean, F.col("s")), F.lit(float(n)))
    # the fraction is rounded by a draw of its own, so the mean is kept
    rows = spark.range(n).select(F.col("id").cast("int").alias("s")).withColumn("_n", F.floor(per_row + uniform(seed, "s", F.lit(4))).cast("int")).where("_n > 0")
    drawn = rows.select("s", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k")).select("s", F.floor(uniform(seed, "s", "_k", F.lit(5)) * n).cast("int").alias("d"))
    g = Graph(drawn.where("s <> d").distinct(), n)
    g = g.symmetric() if symmetric else g
    return relabel(g, degree_order(g)) if by_degree else g


def encode_nonzero(dense: Tensor) -> Tensor:
    """A dense tensor's entries that aren't 0."""
    return dense.nonzero()


