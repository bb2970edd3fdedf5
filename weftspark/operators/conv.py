"""Valid correlations in one and two dimensions, with and without channels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftspark import storage

from weftspark.model import Tensor
from weftspark.operators.einsum import einsum


def conv1d(inputs: Tensor, weights: Tensor) -> Tensor:
    """out[q] = sum of in[q + s] * wt[s]: each input meets the weights by its offsets."""
    return einsum("O[q] += I[q+s] * W[s]", {"I": inputs, "W": weights})


def conv1d_scatter(inputs: Tensor, weights: Tensor) -> Tensor:
    """The same, input-stationary: each input is sent to all outputs it reaches, within bounds."""
    w, s = inputs.shape[0], weights.shape[0]
    i = inputs.rename("w").df.withColumnRenamed(inputs.value, "_x")
    sent = i.select("_x", "w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("w") - (w - s)), F.least(F.lit(s - 1), F.col("w")))).alias("s"))
    rows = sent.join(weights.rename("s").df.withColumnRenamed(weights.value, "_y"), "s")
    return Tensor(rows.groupBy((F.col("w") - F.col("s")).cast("int").alias("q")).agg(F.sum(F.col("_x").cast("bigint") * F.col("_y").cast("bigint")).alias("v")), ("q",), (w - s + 1,))


def conv2d(inputs: Tensor, weights: Tensor) -> Tensor:
    """out[p, q] = sum of in[p + r, q + s] * wt[r, s]."""
    return einsum("O[p,q] += I[p+r,q+s] * W[r,s]", {"I": inputs, "W": weights})


def conv_channels(inputs: Tensor, weights: Tensor) -> Tensor:
    """out[k, q, p] = sum of in[c, q + s, p + r] * wt[k, c, s, r]."""
    if inputs.shape[0] != weights.shape[1]:
        raise ValueError("channels differ")
    return einsum("O[k,q,p] += I[c,q+s,p+r] * W[k,c,s,r]", {"I": inputs, "W": weights})


def _inside(kernels: int, at: list[int], tile: tuple[int, ...], out: tuple[int, ...]) -> np.ndarray:
    """Which places of a tile are in the output."""
    keep = np.ones((kernels, *tile), bool)
    for i, size in enumerate(tile):
        keep &= (np.arange(size) + at[i] < out[i]).reshape(-1, *(1,) * (len(tile) - 1 - i))
    return keep


def tiled(inputs: Tensor, weights: Tensor, tile: tuple[int, ...]) -> Tensor:
    """conv1d, conv2d or conv_channels by tiles of the output, told apart by the weights' one, two or four dimensions.

    Each input is sent to the tiles whose windows reach it, so what is shuffled
    is the inputs and the tiles' rims, not the products; a task holds one tile.
    An output has a row if its window holds an input. Weights travel to the
    tasks; beyond storage.BROADCAST_BYTES the plain form is used.
    """
    n, rank = len(tile), len(weights.shape)
    if (n, rank) not in ((1, 1), (2, 2), (2, 4)):
        raise ValueError("a tile size for each direction is needed")
    if rank == 4 and inputs.shape[0] != weights.shape[1]:
        raise ValueError("channels differ")
    if int(np.prod(weights.shape)) * 8 > storage.BROADCAST_BYTES:
        return {1: conv1d, 2: conv2d, 4: conv_channels}[rank](inputs, weights)
    w = np.zeros(weights.shape, np.int64)
    for r in weights.df.collect():
        w[tuple(r[c] for c in weights.index)] = r[weights.value]
    w = w.reshape(*((1, 1) if rank < 4 else ()), *w.shape)
    window, channels = w.shape[2:], w.shape[1]
    out = tuple(a - b + 1 for a, b in zip(inputs.shape[-n:], window, strict=True))
    names = {1: ("q",), 2: ("p", "q"), 4: ("k", "q", "p")}[rank]
    df = inputs.df.select((F.col(inputs.index[0]) if rank == 4 else F.lit(0)).alias("c"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(inputs.index[-n:])], F.col(inputs.value).cast("bigint").alias("v"))
    for i in range(n):
        x = F.col(f"x{i}")
        lo, hi = F.floor(F.greatest(F.lit(0), x - (window[i] - 1)) / tile[i]), F.floor(F.least(F.lit(out[i] - 1), x) / tile[i])
        df = df.where(lo <= hi).withColumn(f"t{i}", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    places = [f"t{i}" for i in range(n)]

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [int(pdf[t].iloc[0]) * tile[i] for i, t in enumerate(places)]
        block = np.zeros((2, channels, *(a + b - 1 for a, b in zip(tile, window, strict=True))), np.int64)
        cell = tuple([pdf.c.to_numpy(), *(pdf[f"x{i}"].to_numpy() - at[i] for i in range(n))])
        block[0][cell], block[1][cell] = pdf.v.to_numpy(), 1
        views = np.lib.stride_tricks.sliding_window_view(block, window, axis=tuple(range(2, 2 + n)))
        sums = np.tensordot(w, views[0], axes=(range(1, 2 + n), (0, *range(1 + n, 1 + 2 * n))))
        held = views[1].any(axis=(0, *range(1 + n, 1 + 2 * n)))
        keep = np.broadcast_to(held, sums.shape) & _inside(len(w), at, tile, out)
        found = np.nonzero(keep)
        columns = dict(zip(names, [*((found[0],) if rank == 4 else ()), *(found[1 + i] + at[i] for i in range(n))], strict=True))
        return pd.DataFrame({k: v.astype(np.int32) for k, v in columns.items()} | {"v": sums[found]})

    rows = df.groupBy(*places).applyInPandas(correlate, ", ".join([*(f"{c} int" for c in names), "v bigint"]))
    return Tensor(rows, names, (*(w.shape[:1] if rank == 4 else ()), *out))
