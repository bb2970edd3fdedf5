"""Dense and sparse linear algebra over tensors in coordinate form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark import storage
from weftspark.model import Tensor
from weftspark.operators.einsum import einsum


def dot(a: Tensor, b: Tensor) -> DataFrame:
    """One row v: the sum of products over the coordinates both hold (0 if none)."""
    return einsum("Z += A[k] * B[k]", {"A": a, "B": b}).df.select(F.coalesce("v", F.lit(0)).cast("bigint").alias("v"))


def dot_in_parts(a: Tensor, b: Tensor, parts: int) -> DataFrame:
    """dot() by partial sums of contiguous ranges, then their sum."""
    width = -(-a.shape[0] // parts)
    rows = a.rename("k").df.join(b.rename("k").df.withColumnRenamed(b.value, "_b"), "k")
    partial = rows.groupBy(F.floor(F.col("k") / width).alias("p")).agg(F.sum(F.col(a.value).cast("bigint") * F.col("_b").cast("bigint")).alias("v"))
    return partial.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("v"))


def outer(a: Tensor, b: Tensor) -> Tensor:
    """Z[a, b] = A[a] * B[b]: every pair is an entry of the result, so the join has no key; no aggregation follows."""
    x, y = a.rename("a").df.withColumnRenamed(a.value, "_a"), b.rename("b").df.withColumnRenamed(b.value, "_b")
    return Tensor(x.crossJoin(y).select("a", "b", (F.col("_a").cast("bigint") * F.col("_b").cast("bigint")).alias("v")), ("a", "b"), a.shape + b.shape)


def matmul(a: Tensor, b: Tensor, scale: int = 1, salts: int | None = None) -> Tensor:
    """Z[m, n] = scale * sum of A[m, k] * B[k, n], in one aggregation.

    Where there are fewer inner indices than shuffle partitions, the entries of
    the matrix with more rows or columns are dealt out over `salts` keys for
    each, and the other's copied to them, so that few k are many tasks.
    """
    if a.shape[1] != b.shape[0]:
        raise ValueError("inner sizes differ")
    long = a.shape[0] >= b.shape[1]
    if salts is None:
        salts = max(1, min(max(a.shape[0], b.shape[1]), storage.buckets(a.df.sparkSession) // max(1, a.shape[1])))
    if salts == 1:
        return einsum(f"Z[m,n] += A[m,k] * B[k,n] * {scale}", {"A": a, "B": b})
    dealt, copied = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    x = a.rename("m", "k").df.select("m", "k", F.col(a.value).cast("bigint").alias("_a"), (dealt("m") if long else copied).alias("_salt"))
    y = b.rename("k", "n").df.select("k", "n", F.col(b.value).cast("bigint").alias("_b"), (copied if long else dealt("n")).alias("_salt"))
    z = x.join(y, ["k", "_salt"]).groupBy("m", "n").agg((F.sum(F.col("_a") * F.col("_b")) * scale).alias("v"))
    return Tensor(z, ("m", "n"), (a.shape[0], b.shape[1]))


def matmul_tiled(a: Tensor, b: Tensor, tile: tuple[int, int, int], scale: int = 1) -> Tensor:
    """matmul() by tiles of (m, k, n): tiles meet in a join on their k, are multiplied as small dense blocks, and the blocks are added up.

    A task holds two tiles at a time. Shuffled rows are tiles, not products, so
    for dense matrices the shuffle shrinks by the tile's size. Where tiles have
    fewer different k than there are shuffle partitions, those of the longer
    matrix are dealt out over several keys and the other's repeated for each.
    Entries are those of matmul(): where a product met, even if the sum is 0.
    """
    if a.shape[1] != b.shape[0]:
        raise ValueError("inner sizes differ")
    tm, tk, tn = tile

    def tiles(t: Tensor, rows: int, cols: int, names: tuple[str, str], cells: str) -> DataFrame:
        i, j = t.index
        place = (F.col(i) % rows) * cols + F.col(j) % cols
        return t.df.groupBy(F.floor(F.col(i) / rows).alias(names[0]), F.floor(F.col(j) / cols).alias(names[1])).agg(F.collect_list(F.struct(place.cast("int").alias("p"), F.col(t.value).cast("bigint").alias("x"))).alias(cells))

    parallel = int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long, wide = -(-a.shape[0] // tm), -(-b.shape[1] // tn)
    salts = max(1, min(max(long, wide), parallel // -(-a.shape[1] // tk)))
    dealt, copied = lambda c: (F.col(c) % salts).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    xa = tiles(a, tm, tk, ("m1", "k1"), "xa").withColumn("salt", dealt("m1") if long >= wide else copied)
    xb = tiles(b, tk, tn, ("k1", "n1"), "xb").withColumn("salt", copied if long >= wide else dealt("n1"))
    pairs = xa.join(xb, ["k1", "salt"])

    def block(places: np.ndarray, values: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
        out, seen = np.zeros(rows * cols, np.int64), np.zeros(rows * cols, np.float32)
        out[places], seen[places] = values, 1
        return out.reshape(rows, cols), seen.reshape(rows, cols)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[tuple, list[np.ndarray]] = {}
            for m1, n1, pa, va, pb, vb in pdf.itertuples(index=False):
                (x, sx), (y, sy) = block(pa, va, tm, tk), block(pb, vb, tk, tn)
                if float(np.abs(x).max()) * float(np.abs(y).max()) * tk >= 2.0**62:
                    raise OverflowError("a tile's sum may leave 64 bits")
                made = sums.setdefault((m1, n1), [])
                made.append((x @ y, sx @ sy > 0))
                if len(made) > 1:
                    (z, seen), (w, also) = made
                    if max(float(np.abs(z).max()), float(np.abs(w).max())) >= 2.0**62:
                        raise OverflowError("a tile's sum may leave 64 bits")
                    sums[m1, n1] = [(z + w, seen | also)]
            parts = [pd.DataFrame({"m": (i // tn + m1 * tm).astype(np.int32), "n": (i % tn + n1 * tn).astype(np.int32), "v": z.ravel()[i]}) for (m1, n1), [(z, seen)] in sums.items() if len(i := np.flatnonzero(seen.ravel()))]
            if parts:
                yield pd.concat(parts)

    z = pairs.select("m1", "n1", "xa.p", "xa.x", F.col("xb.p").alias("q"), F.col("xb.x").alias("y")).mapInPandas(multiply, "m int, n int, v bigint").groupBy("m", "n").agg((F.sum("v") * scale).alias("v"))
    return Tensor(z, ("m", "n"), (a.shape[0], b.shape[1]))


def spmv(a: Tensor, x: Tensor | None = None) -> Tensor:
    """out[m] = sum of A[m, n] * x[n]; without x, of ones. Only rows with entries are written."""
    if x is None:
        return Tensor(a.df.groupBy(F.col(a.index[0]).alias("m")).agg(F.sum(F.col(a.value).cast("bigint")).alias("v")), ("m",), a.shape[:1])
    return einsum("Z[m] += A[m,n] * X[n]", {"A": a, "X": x})


def scale(a: Tensor, by: int) -> Tensor:
    return a.transform(F.col(a.value).cast("bigint") * by)
