"""Tensors stored so that a box of them lies in few files.

Entries are dealt into cells, a power of two wide in each dimension; a cell's
number interleaves the bits of its coordinates (a Z-order key) and is a
partition of the table, rows inside it being in order of the index. A box
becomes the list of cells it reaches, which prunes whole folders before any
task starts, and bounds on the index, which prune row groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.model import Tensor

#: Cells of a stored tensor at most; a box's cells are listed on the driver.
CELLS = 4096


def z_number(cell: Sequence[int], bits: int) -> int:
    """The interleaved bits of a cell's coordinates."""
    return sum((c >> b & 1) << (b * len(cell) + len(cell) - 1 - k) for b in range(bits) for k, c in enumerate(cell))


def z_column(cells: Sequence[Column], bits: int) -> Column:
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(cells):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(cells) + len(cells) - 1 - k))
    return out


@dataclass(frozen=True)
class Clustered:
    """A stored tensor: cells are 2 ** shift[i] wide in dimension i, and have `bits` bits for each."""

    path: str
    index: tuple[str, ...]
    shape: tuple[int, ...]
    bits: int
    shift: tuple[int, ...]
    value: str = "v"

    @staticmethod
    def write(t: Tensor, path: str, cells: int = CELLS) -> Clustered:
        """Writes a tensor; `cells` is rounded down to a power of two for each dimension."""
        bits = max(0, (cells.bit_length() - 1) // len(t.shape))
        shift = tuple(max(0, (d - 1).bit_length() - bits) for d in t.shape)
        out = Clustered(path, t.index, t.shape, bits, shift, t.value)
        z = z_column([F.shiftright(c, s) for c, s in zip(map(F.col, t.index), shift, strict=True)], bits)
        # a full cell is several files, as its rows are also dealt by their place
        rows = t.df.select(*t.index, t.value, z.alias("z")).repartitionByRange("z", *t.index).sortWithinPartitions("z", *t.index)
        rows.write.partitionBy("z").parquet(path)
        return out

    def cells(self, base: Sequence[int], count: Sequence[int], stride: Sequence[int]) -> list[int]:
        """Numbers of the cells that hold points base + k * stride, k < count, in order."""
        sides = []
        for b, n, s, d, h in zip(base, count, stride, self.shape, self.shift, strict=True):
            first, last = max(0, -(-max(0, -b) // s)), min(n - 1, (d - 1 - b) // s)
            sides.append(sorted({b + k * s >> h for k in range(first, last + 1)}) if s >= 1 << h else list(range(b + first * s >> h, (b + last * s >> h) + 1)) if first <= last else [])
        return sorted(z_number(c, self.bits) for c in itertools.product(*sides))

    def scan(self, spark: SparkSession, base: Sequence[int], count: Sequence[int], stride: Sequence[int]) -> DataFrame:
        """Entries at base + k * stride (k < count) in each dimension; only the files of their cells are read."""
        schema = ", ".join([*(f"{c} int" for c in self.index), f"{self.value} bigint", "z bigint"])
        keep = F.col("z").isin(self.cells(base, count, stride))
        for c, b, n, s in zip(self.index, base, count, stride, strict=True):
            keep = keep & (F.col(c) >= b) & (F.col(c) < b + n * s) & ((F.col(c) - b) % s == 0)
        return spark.read.schema(schema).parquet(self.path).where(keep).select(*self.index, self.value)


def out_of_order(df: DataFrame, *columns: str) -> int:
    """How many rows come before one that they should follow, by the columns: inside partitions and between them.

    A row per partition comes to the driver.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names = list(columns)

    def run(batches):
        first = last = None
        bad = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if last is not None:
                t = pa.concat_tables([pa.Table.from_pylist([last], schema=t.schema), t])
            first = first or t.slice(0, 1).to_pylist()[0]
            tie, less = pa.array([True] * (t.num_rows - 1)), pa.array([False] * (t.num_rows - 1))
            for c in names:
                x, y = t.column(c).slice(0, t.num_rows - 1), t.column(c).slice(1)
                less = pc.or_(less, pc.and_(tie, pc.greater(x, y)))
                tie = pc.and_(tie, pc.equal(x, y))
            bad += pc.sum(less).as_py() or 0
            last, kind = t.slice(t.num_rows - 1).to_pylist()[0], pa.struct(list(t.schema))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], kind), pa.array([last], kind), pa.array([bad])], names=["first", "last", "bad"])

    kind = df.select(*names).schema.simpleString()
    ends = df.select(*names).mapInArrow(run, f"first {kind}, last {kind}, bad long").select(F.spark_partition_id().alias("p"), "*").collect()
    ends.sort(key=lambda r: r.p)
    return sum(r.bad for r in ends) + sum(tuple(a["last"]) > tuple(b["first"]) for a, b in itertools.pairwise(ends))
