"""Comparison of a result with a reference tensor, entry by entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.model import Tensor


def differences(got: Tensor, wanted: Tensor, tolerance: float = 0.0) -> DataFrame:
    """Rows (index, got, wanted) that differ; a missing entry is 0. Whole numbers compare exactly, others within the tolerance."""
    if got.shape != wanted.shape:
        raise ValueError(f"shapes differ: {got.shape} and {wanted.shape}")
    a = got.rename(*wanted.index).df.select(*wanted.index, F.col(got.value).alias("got"))
    b = wanted.df.select(*wanted.index, F.col(wanted.value).alias("wanted"))
    both = a.join(b, list(wanted.index), "full_outer").select(*wanted.index, F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("wanted", F.lit(0)).alias("wanted"))
    return both.where(F.abs(F.col("got") - F.col("wanted")) > tolerance)


def warnings(got: Tensor, wanted: Tensor, tolerance: float = 0.0) -> int:
    """How many entries differ."""
    return differences(got, wanted, tolerance).count()
