"""Producer-consumer programs: stages between which rows flow, and groups ended by markers.

A stage takes and gives a DataFrame; stages without a shuffle between them run
as one pipeline of iterators. A stream with end-of-group markers of several
nesting levels becomes rows with grouping columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark import storage
from weftspark.model import Tensor
from weftspark.operators import scans
from weftspark.operators.linalg import matmul, matmul_tiled, scale

Stage = Callable[[DataFrame], DataFrame]


def run(source: DataFrame, *stages: Stage, decoupled: bool = False) -> DataFrame:
    """Applies the stages; decoupled: what each gives is written before the next begins."""
    for stage in stages:
        source = stage(source)
        if decoupled:
            source = storage.save(source, "stage")
    return source


def node(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Stage:
    """A stage that consumes and produces batches."""
    return lambda df: df.mapInPandas(work, schema)


def fan_out(source: DataFrame, *consumers: Stage) -> list[DataFrame]:
    """One producer for several consumers; its rows are made once."""
    made = storage.save(source, "fan")
    return [c(made) for c in consumers]


def groups(stream: DataFrame, levels: int, key: str | None = None, nested: bool = False, stride: int = scans.STRIDE) -> DataFrame:
    """Rows of a punctuated stream (seq, tag, value) with a column g0 to g{levels-1} per nesting level.

    tag is null for a value; a marker's tag k ends the group of level k (0 is
    innermost) and all inside it. g counts the groups that have ended before, in
    the whole stream, or, if nested, in the group around (the outer group's end
    starts the count again). With key, each key is a stream of its own. Streams
    are counted in stretches of `stride` numbers and carries between them, so a
    single stream is many tasks.
    """
    ends = lambda k: F.coalesce(F.col("tag") >= k, F.lit(False))
    parts = {f"g{k}": (ends(k + 1) if nested else F.lit(False), (ends(k) & ~ends(k + 1) if nested else ends(k)).cast("bigint")) for k in range(levels)}
    return scans.segmented_sums(stream, "seq", parts, [key] if key else [], stride, 2).where("tag IS NULL").drop("tag")


def pair(left: DataFrame, right: DataFrame, on: list[str], how: str = "both") -> DataFrame:
    """Groups that are done in all queues ("both") or in any of them ("any")."""
    return left.join(right, on, "inner" if how == "both" else "full_outer")


def multiply_then_scale(a: Tensor, b: Tensor, by: int, form: str = "fused", tile: tuple[int, int, int] | None = None) -> Tensor:
    """(A B) * by: fused in one aggregation, staged with the product written between, or decoupled into stages; tiled if a tile is given."""
    product = matmul_tiled(a, b, tile) if tile else None
    if form == "fused":
        return matmul_tiled(a, b, tile, by) if tile else matmul(a, b, by)
    z = product or matmul(a, b)
    rows = run(z.df, lambda df: scale(Tensor(df, z.index, z.shape), by).df, decoupled=form == "decoupled") if form != "staged" else scale(Tensor(storage.save(z.df, "product"), z.index, z.shape), by).df
    return Tensor(rows, z.index, z.shape)
