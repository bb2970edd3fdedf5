"""Products of a matrix in blocks with a vector in slices, round after round.

A block is one row: its place (br, bc) and the entries inside it. Blocks are
written once, by block column; a round ships each slice of the vector to the
blocks of its column and the partial sums of a task to their block rows. No
entry of the matrix is shuffled again, a long row is many blocks, and a block
column of very many blocks is dealt out over several buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark import storage
from weftspark.model import Graph, Tensor
from weftspark.operators.adjacency import Adjacency

#: Products that a task holds before it adds them up and hands them on.
HELD = 1 << 20
#: Columns of a block, and entries in it, where none are given.
WIDTH, ENTRIES = 1 << 12, 1 << 14
#: Sums beyond this may leave 64 bits; such a product raises.
LIMIT = float(1 << 62)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (rows + 1, from 0) of a list column."""
    off = column.offsets.to_numpy()
    return column.flatten().to_numpy(), off - off[0]


class BlockMatrix:
    """entries (br, r, bc, c, v): block row, row in it, block column, column in it and value; height and width: a block's size."""

    def __init__(self, entries: DataFrame, height: int, width: int):
        self.height, self.width = height, width
        cells = F.collect_list(F.struct(*[F.col(x).cast(kind).alias(x) for x, kind in (("r", "int"), ("c", "int"), ("v", "bigint"))])).alias("cells")  # height * width at most
        blocks = entries.groupBy(F.col("bc").cast("int").alias("bc"), F.col("br").cast("int").alias("br")).agg(cells)
        arrays = [F.col(f"cells.{c}").alias(c) for c in ("r", "c", "v")]
        with storage.partitions_for(entries) as self.partitions:
            self.blocks = Adjacency(storage.save(blocks.select("bc", "br", *arrays), "blocks"), "bc", "br", hub=1)

    @staticmethod
    def from_graph(g: Graph, height: int = 0, width: int = 0) -> BlockMatrix:
        """Rows are the edges' ends, columns their starts.

        Without sizes blocks are as high as it takes to have some ENTRIES, so a
        sparse graph has few blocks, and a round ships no more of the vector
        than there are edges.
        """
        value = F.col("w") if "w" in g.edges.columns else F.lit(1)
        rows = g.edges
        if not (height and width):
            rows = storage.save(rows, "edges")
            width = max(1, min(g.n, WIDTH))
            height = max(1, min(g.n, ENTRIES * g.n * g.n // (width * max(1, rows.count()))))
        return BlockMatrix(rows.select(F.floor(F.col("d") / height).alias("br"), (F.col("d") % height).alias("r"), F.floor(F.col("s") / width).alias("bc"), (F.col("s") % width).alias("c"), value.alias("v")), height, width)

    @staticmethod
    def from_tiles(t: Tensor) -> BlockMatrix:
        """A five-level form as it is: (d1) by (s2, s1) are blocks, d0 and s0 the places in them."""
        if set(t.index) != {"d1", "s2", "s1", "d0", "s0"}:
            raise ValueError("not a five-level form")
        size = dict(zip(t.index, t.shape, strict=True))
        return BlockMatrix(t.df.select(F.col("d1").alias("br"), F.col("d0").alias("r"), (F.col("s2") * size["s1"] + F.col("s1")).alias("bc"), F.col("s0").alias("c"), F.col(t.value).alias("v")), size["d0"], size["s0"])

    def multiply(self, x: DataFrame, modulus: int = 0) -> DataFrame:
        """(v, y): y = A x for a vector (v, x); rows without entries are not returned. With a modulus, remainders."""
        width, height = self.width, self.height
        slices = x.groupBy(F.floor(F.col("v") / width).cast("int").alias("v")).agg(F.collect_list(F.struct((F.col("v") % width).cast("int").alias("i"), F.col("x").cast("bigint").alias("x"))).alias("s"))
        met = self.blocks.send(slices.select("v", F.col("s.i").alias("at"), F.col("s.x").alias("x"))).select("br", "r", "c", "v", "at", "x")

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            n = 0

            def out() -> pa.RecordBatch:
                place, y, far = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(place, kind="stable")
                place = place[order]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                if (np.add.reduceat(far[order], first) > LIMIT).any():
                    raise OverflowError("a sum leaves 64 bits")
                place, y = place[first], np.add.reduceat(y[order], first)
                return pa.RecordBatch.from_arrays([pa.array(place // height), pa.array(place), pa.array(y % modulus if modulus else y)], names=["b", "v", "y"])

            for batch in batches:
                (r, at), (c, _), (v, _), (where, start), (value, _) = (_lists(batch.column(k)) for k in range(1, 6))
                for k, b in enumerate(batch.column(0).to_pylist()):
                    part = np.zeros(width, np.int64)
                    part[where[start[k] : start[k + 1]]] = value[start[k] : start[k + 1]]
                    mine = slice(at[k], at[k + 1])
                    x = part[c[mine]]
                    far = np.abs(v[mine].astype(float) * x)
                    if (far > LIMIT).any():
                        raise OverflowError("a sum leaves 64 bits")
                    held.append((b * height + r[mine].astype(np.int64), v[mine] * x, far))
                    n += len(x)
                    if n >= HELD:
                        yield out()
                        held.clear()
                        n = 0
            if n:
                yield out()

        sent = met.mapInArrow(products, "b bigint, v bigint, y bigint")
        total = F.sum("y") % modulus if modulus else F.sum("y")
        return sent.groupBy(F.col("v").cast("int").alias("v")).agg(total.alias("y"))

    def rounds(self, x: DataFrame, n: int, rounds: int, modulus: int = 0) -> DataFrame:
        """(v, x) after `rounds` products, each with the result of the one before; n: the vector's size. What is not written is 0."""
        vertices = x.sparkSession.range(n).select(F.col("id").cast("int").alias("v"))
        state = storage.save(x.select("v", F.col("x").cast("bigint").alias("x")), "vector")
        with storage.partitions_for(self.blocks.edges, self.partitions):
            for _ in range(rounds):
                old, state = state, storage.save(self.multiply(state, modulus).withColumnRenamed("y", "x"), "vector")
                storage.drop(old)
        return vertices.join(state, "v", "left").select("v", F.coalesce("x", F.lit(0)).alias("x"))
