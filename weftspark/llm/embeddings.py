"""Embedding near-dedup by sorted projection passes.

In each pass, vectors are sorted by label and by a key of several concatenated
random hashes (quantised random projections); runs of equal keys and their
neighbours in that order are compared BLOCK vectors or more at a time, in
single precision first and in double precision where that can't decide. A run
of more than TILE vectors is split into tiles by hash, and each pair of its
tiles is a task of its own, so the window drops nothing that the hashes hold
together. A pair is counted in the first pass in which its keys agree, which
any task can tell from the two vectors alone; so pairs are counted once and
never written out. The links that connect what a task found go to a common
union over all passes.

The number of hashes in a key grows with the logarithm of the largest label's
vectors, and the number of passes so that a pair at the threshold is missed
with a probability of MISS at most (pairs above it: far less).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common
from weftspark.llm.components import components
from weftspark.llm.simhash import forest

THRESHOLD = 0.98
#: Neighbours in a pass's order that are compared together, at least.
BLOCK = 512
#: Vectors of one key that one task compares with each other; longer runs are split.
TILE = 4096
#: Rows of a comparison that are looked at in one step.
STRIP = 256
#: Width of a projection's cell, in standard deviations of a random unit vector's projection, and what such a cell tells apart (bits).
WIDTH, BITS = 2.0, 1.09
MISS = 1e-5
#: Vectors of one label that may share a key by chance, about.
CROWD = 1024
#: Rows of a pass in one task, about.
TASK_ROWS = 1 << 14


def plan(largest: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Hashes in a key, and passes, for so many vectors of the largest label."""
    hashes = max(1, math.ceil(math.log2(max(1, largest / CROWD)) / BITS))
    # two unit vectors at the threshold: their projections differ by a normal value of this deviation
    apart = math.sqrt(2 - 2 * threshold)
    together = max(1e-3, 1 - apart * math.sqrt(2 / math.pi) / WIDTH) ** hashes
    return hashes, max(1, math.ceil(math.log(MISS) / math.log(1 - together))) if together < 1 else 1


@functools.lru_cache(4)
def _directions(seed: int, passes: int, hashes: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, passes, hashes, dim])
    return rng.standard_normal((passes * hashes, dim)), rng.random(passes * hashes)


def unit(rows: pa.Array) -> np.ndarray:
    """Vectors of one length, normalised, in double precision."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys_of(x: np.ndarray, seed: int, passes: int, hashes: int) -> np.ndarray:
    """(vectors, passes, hashes): the cells that unit vectors lie in, as bytes in order."""
    p, shift = _directions(seed, passes, hashes, x.shape[1])
    # row by row the same sums, whatever the rows beside it
    cells = np.floor(np.einsum("ij,kj->ik", x, p) / WIDTH + shift)
    return (np.clip(cells, -128, 127) + 128).astype(np.uint8).reshape(len(x), passes, hashes)


def _keys(batches: Iterator[pa.RecordBatch], seed: int, passes: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """(cid, grp, vec) with the keys of all passes."""
    for b in batches:
        lengths = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            own = b.filter(pa.array(lengths == dim))
            key, n = keys_of(unit(own.column(2)), seed, passes, hashes), len(own)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(hashes), n * passes, [None, pa.py_buffer(np.ascontiguousarray(key))]).cast(pa.binary())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, n * passes + 1, passes, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*own.columns, keys], names=["cid", "grp", "vec", "m", "keys"])


def _pairs(x: np.ndarray, lo: int, hi: int, others: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows lo to hi and others whose cosine reaches the threshold in double precision."""
    small, doubt = x[1], 4e-7 * x[0].shape[1] + 1e-6
    sims = small[lo:hi] @ small[others].T
    i, j = np.nonzero(sims >= threshold - doubt)
    near = sims[i, j] < threshold + doubt
    i, j = i + lo, j + (others.start or 0)
    if near.any():
        good = ~near
        good[near] = np.einsum("ij,ij->i", x[0][i[near]], x[0][j[near]]) >= threshold
        i, j = i[good], j[good]
    return i, j


PAIRS = "cid long, n long, root long"


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, seed: int, passes: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """Rows (pass, grp, key, ti, tj, side, cid, m, vec) in order: new links of each vector and a tree that connects what was found, chunk by chunk."""
    held: list[pa.RecordBatch] = []

    def chunk():
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cid, m, n = t.column(6).to_numpy(), t.column(7).to_numpy(), len(t)
        which, left = t.column(0)[0].as_py(), int((t.column(5).to_numpy() == 0).sum())
        double = unit(t.column(8))
        x, keys = (double, double.astype(np.float32)), None
        count, label = np.zeros(n, np.int64), np.arange(n)
        for lo in range(0, left, STRIP):
            hi = min(left, lo + STRIP)
            i, j = _pairs(x, lo, hi, slice(left, n) if left < n else slice(lo, n), threshold)
            some = i < j
            i, j = i[some], j[some]
            if not len(i):
                continue
            if keys is None:
                k = keys_of(double, seed, passes, hashes).astype(np.uint64)
                keys = np.zeros((n, passes), np.uint64)
                for h in range(hashes):  # equal keys have equal numbers
                    keys = common.mix(keys + k[:, :, h] + np.uint64(1))
            new = keys[i, which] == keys[j, which]
            for q in range(which):
                new &= keys[i, q] != keys[j, q]
            a, b = i[new], j[new]
            count += np.bincount(a, weights=m[b], minlength=n).astype(np.int64) + np.bincount(b, weights=m[a], minlength=n).astype(np.int64)
            u, v = label[i], label[j]
            apart = u != v
            if apart.any():
                label = forest(u[apart], v[apart], n)[label]
        hit = np.flatnonzero((count > 0) | (label != np.arange(n)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(count[hit]), pa.array(cid[label[hit]])], names=["cid", "n", "root"])

    rows, last = 0, None
    for b in batches:
        if not len(b):
            continue
        # where pass or label change, a chunk ends; where the key or tile do, it may; tiles stand alone
        codes = [b.column(k) if k in (0, 3, 4) else b.column(k).dictionary_encode().indices for k in range(5)]
        codes = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes], axis=1)
        cuts = (np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
            now = tuple(b.column(k)[lo].as_py() for k in range(5))
            if rows and now != last and (now[:2] != last[:2] or rows >= BLOCK or now[3] >= 0 or last[3] >= 0):
                yield chunk()
                rows = 0
            last = now
            held.append(b.slice(lo, hi - lo))
            rows += hi - lo
    if rows:
        yield chunk()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Rows with a null id, label or vector, an empty or zero vector, or null or
    non-finite components link with nothing: no links, their own component,
    kept. Vectors of different lengths don't link. Equal vectors of a label are
    one in all comparisons and count as many. A repeated vec_id gives a row for
    each of its rows, with what its own vector links; component_id is the
    smallest vec_id of any row reachable. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.concat_ws("|", F.size(vec_col), F.col(label_col).cast("string")).alias("grp"), F.col(label_col).isNotNull().alias("labelled"))
    fine = F.expr("vec_id IS NOT NULL AND labelled AND vec IS NOT NULL AND exists(vec, x -> x <> 0) AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    # a class: the rows with one vector and label, numbered apart from vec_id; its two hashes find it again
    marks = (F.xxhash64("grp", "vec").alias("h1"), F.xxhash64("vec", "grp").alias("h2"))
    classes = rows.where(fine).groupBy("grp", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    classes = common.save(classes.select(F.monotonically_increasing_id().alias("cid"), "grp", "vec", "rep", "m", *marks), "vectors")
    largest = classes.groupBy("grp").count().agg(F.max("count"), F.sum("count")).first()
    (hashes, passes), total = plan(largest[0] or 0, threshold), largest[1] or 0
    keyed = classes.select("cid", "grp", "vec", "m").mapInArrow(lambda it: _keys(it, seed, passes, hashes), f"cid long, grp string, vec {classes.schema['vec'].dataType.simpleString()}, m long, keys array<binary>")
    keyed = common.save(keyed, "keyed")
    placed = keyed.select("cid", "grp", "vec", "m", F.posexplode("keys").alias("pass", "key"))
    runs = keyed.select("grp", F.posexplode("keys").alias("pass", "key")).groupBy("pass", "grp", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    runs = common.save(runs.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).drop("n"), "runs")
    placed = placed.join(common.small(runs, 64), ["pass", "grp", "key"], "left").withColumn("t", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    tiles = F.expr("if(tiles IS NULL, array(named_struct('ti', -1, 'tj', -1, 'side', 0)), transform(sequence(0, tiles - 1), o -> named_struct('ti', least(t, o), 'tj', greatest(t, o), 'side', int(o < t))))")
    spread = placed.select("pass", "grp", "key", F.explode(tiles).alias("p"), "cid", "m", "vec").select("pass", "grp", "key", "p.ti", "p.tj", "p.side", "cid", "m", "vec")
    parts = max(total * passes // TASK_ROWS, min(total * passes // BLOCK, spark.sparkContext.defaultParallelism), 1)
    ordered = spread.repartitionByRange(parts, "pass", "grp", "key", "ti", "tj").sortWithinPartitions("pass", "grp", "key", "ti", "tj", "side")
    found = common.save(ordered.mapInArrow(lambda it: _compare(it, threshold, seed, passes, hashes), PAIRS), "found")
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    # classes with links or several rows; all others are components of their own
    known = classes.select("cid", "rep", "m", "h1", "h2").join(links, "cid", "left").join(roots, "cid", "left").where("m > 1 OR n > 0 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "cid"))
    known = common.save(known, "known")
    least = known.groupBy("component").agg(F.min("rep").alias("least"))
    known = known.join(least, "component").select("h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "least")
    known = common.save(known, "linked")
    common.drop(keyed, runs, found)
    out = rows.withColumn("ok", fine).select("vec_id", F.when(F.col("ok"), marks[0]).alias("h1"), F.when(F.col("ok"), marks[1]).alias("h2")).join(common.small(known, 48), ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
