"""Exact correlation with long kernels, by number-theoretic transforms in two steps.

The direct form makes a product for each input and tap, and one by pieces a
product for each block of inputs and piece of taps. Here inputs and taps are
cut into blocks of one length, about the root of theirs, and each is
transformed once modulo two primes. At each place of the transforms the blocks
are a short sequence; a task has some places of all blocks and multiplies these
sequences by transforms again. What comes back is sent to its output block, and
the two remainders give the whole number. So each value is shipped a fixed
number of times, and a task holds a block or some places of all.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftspark.model import Tensor

#: Primes of the form k * 2**n + 1 with n over 20, and a primitive root of each.
PRIMES = ((998244353, 3), (469762049, 3))
#: Places of a block at least, unless there are fewer.
PIECE = 1 << 10
#: Numbers that a task holds of some places of all blocks, about; places are cut into so many chunks at least.
HELD, CHUNKS = 1 << 20, 64


@functools.lru_cache(8)
def _roots(size: int, p: int, root: int) -> list[np.ndarray]:
    """Powers for each level of a transform of `size` places."""
    out, n = [], size
    while n > 1:
        w, k = pow(root, (p - 1) // n, p), n // 2
        powers = np.ones(k, np.int64)
        have = 1
        while have < k:
            more = min(have, k - have)
            powers[have : have + more] = powers[:more] * pow(w, have, p) % p
            have += more
        out.append(powers)
        n = k
    return out


def transform(x: np.ndarray, p: int, root: int, inverse: bool = False) -> np.ndarray:
    """Transform of each row modulo p; forward results come in bit-reversed places, which the inverse takes. The length is a power of two."""
    n = x.shape[-1]
    levels = _roots(n, p, pow(root, -1, p) if inverse else root)
    x = x.copy()
    if not inverse:
        for powers in levels:
            k = len(powers)
            v = x.reshape(*x.shape[:-1], -1, 2, k)
            a, b = v[..., 0, :].copy(), v[..., 1, :]
            v[..., 0, :], v[..., 1, :] = (a + b) % p, (a - b) % p * powers % p
        return x
    for powers in reversed(levels):
        k = len(powers)
        v = x.reshape(*x.shape[:-1], -1, 2, k)
        a, b = v[..., 0, :].copy(), v[..., 1, :] * powers % p
        v[..., 0, :], v[..., 1, :] = (a + b) % p, (a - b) % p
    return x * pow(n, -1, p) % p


def _whole(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whole numbers, smaller in size than half the primes' product, from their remainders."""
    (p, _), (q, _) = PRIMES
    high = (y - x) % q * pow(p, -1, q) % q  # the result is x + p * high
    return np.where(high > q // 2, (high - q) * p + x, high * p + x)


def cyclic(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cyclic convolution of whole numbers whose results are smaller in size than half the primes' product."""
    return _whole(*(transform(transform(a % m, m, r) * transform(b % m, m, r) % m, m, r, True) for m, r in PRIMES))


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.astype(np.int32).ravel())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def conv1d(inputs: Tensor, weights: Tensor, piece: int = PIECE) -> Tensor:
    """out[q] = sum of in[q + s] * wt[s] for every q of 0 to n - k, zeros included.

    Raises where a sum might reach half the primes' product (2.3e17): a bound
    from the largest input and tap, both counted first. piece: places of a
    block at least; blocks get longer with the root of the inputs' length.
    """
    n, k = inputs.shape[0], weights.shape[0]
    if k > n:
        raise ValueError("the kernel is longer than the inputs")
    x = inputs.rename("i").df.select(F.col("i").cast("bigint").alias("i"), F.col(inputs.value).cast("bigint").alias("v"))
    w = weights.rename("s").df.select(F.col("s").cast("bigint").alias("s"), F.col(weights.value).cast("bigint").alias("v"))
    big = [float(df.agg(F.coalesce(F.max(F.abs("v")), F.lit(0))).first()[0]) for df in (x, w)]
    if big[0] * big[1] * k >= PRIMES[0][0] * PRIMES[1][0] / 2:
        raise OverflowError("sums may leave the primes' range")
    power = lambda m: 1 << max(0, m - 1).bit_length()
    block = power(max(min(piece, n), math.isqrt(n)))
    size, long = 2 * block, power(-(-n // block) + -(-k // block))  # places of a block's transform; blocks of a sequence's
    wide = power(max(1, min(HELD // long, size // CHUNKS)))  # places in a chunk
    # with the taps turned round, out[q] is place q + k - 1 of the product
    turned = w.select(F.lit(True).alias("tap"), (k - 1 - F.col("s")).alias("i"), "v")
    places = x.select(F.lit(False).alias("tap"), "i", "v").unionByName(turned)
    cells = F.collect_list(F.struct((F.col("i") % block).cast("int").alias("i"), F.col("v").alias("v"))).alias("x")  # a block's rows at most
    blocks = places.groupBy("tap", F.floor(F.col("i") / block).cast("int").alias("j")).agg(cells).select("tap", "j", F.col("x.i").alias("i"), F.col("x.v").alias("v"))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = max(1, HELD // 4 // size)
        for batch in batches:
            for at in range(0, batch.num_rows, few):
                tap, j, i, v = (batch.column(c).slice(at, few) for c in range(4))
                row = np.repeat(np.arange(len(j)), i.value_lengths().to_numpy())
                a = np.zeros((len(j), size), np.int64)
                a[row, i.flatten().to_numpy()] = v.flatten().to_numpy()
                chunks = size // wide
                parts = [_lists(transform(a % m, m, r).reshape(-1, wide)) for m, r in PRIMES]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(chunks, dtype=np.int32), len(j))), pa.array(np.repeat(tap.to_numpy(zero_copy_only=False), chunks)), pa.array(np.repeat(j.to_numpy(), chunks)), *parts], names=["f", "tap", "j", "x", "y"])

    first, last = max(0, (k - 1) // block - 1), (n - 1) // block  # blocks that reach an output

    def products(t: pa.Table) -> pa.Table:
        tap, j = t.column("tap").to_numpy().astype(bool), t.column("j").to_numpy()
        out = []
        for name, (m, r) in zip("xy", PRIMES, strict=True):
            values, sides = _matrix(t.column(name)), []
            for side in (False, True):
                a = np.zeros((wide, long), np.int64)
                a[:, j[tap == side]] = values[tap == side].T
                sides.append(transform(a, m, r))
            z = transform(sides[0] * sides[1] % m, m, r, True)
            out.append(_lists(np.ascontiguousarray(z[:, first : last + 1].T)))
        made = last - first + 1
        return pa.table({"m": pa.array(np.arange(first, last + 1, dtype=np.int32)), "f": pa.array(np.full(made, t.column("f")[0].as_py(), np.int32)), "x": out[0], "y": out[1]})

    def back(t: pa.Table) -> pa.Table:
        order, at = np.argsort(t.column("f").to_numpy()), t.column("m")[0].as_py()
        y = _whole(*(transform(_matrix(t.column(name))[order].reshape(1, -1), m, r, True)[0] for name, (m, r) in zip("xy", PRIMES, strict=True)))
        q = at * block + np.arange(size) - (k - 1)
        keep = (q >= 0) & (q <= n - k)
        return pa.table({"q": pa.array(q[keep].astype(np.int32)), "v": pa.array(y[keep])})

    sent = blocks.mapInArrow(forward, "f int, tap boolean, j int, x array<int>, y array<int>")
    made = sent.groupBy("f").applyInArrow(products, "m int, f int, x array<int>, y array<int>").groupBy("m").applyInArrow(back, "q int, v bigint")
    sums = made.groupBy("q").agg(F.sum("v").alias("v"))
    every = inputs.df.sparkSession.range(n - k + 1).select(F.col("id").cast("int").alias("q"))
    return Tensor(every.join(sums.hint("merge"), "q", "left").select("q", F.coalesce("v", F.lit(0)).alias("v")), ("q",), (n - k + 1,))
