"""Text archives of dense and compressed tensors, read and written in parallel.

An archive is one line of tokens: a fixed head, then counts and values. A dense
one holds the dimensions, innermost first, and the values in row-major order. A
compressed one holds rank, entries, dimensions, names, the last coordinate, and
per level, outermost first, segments and then coordinates, and the values.

The line is read with a blank as the end of a record, so Spark splits a file at
byte ranges as it does any text; tokens are numbered inside a split and moved up
by the splits before it. It is written the same way: tasks write ranges of
tokens, and the files of the folder, in the order of their names, are the line.
Only heads (dimensions and counts) and a row per split come to the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark import storage
from weftspark.model import Tensor, flatten, unflatten
from weftspark.operators import scans, sparse

#: Fixed values of the format: the tokens every archive starts with.
HEAD = ["22", "serialization::archive", "15"]
#: Tokens in a file that is written, at most, and in one that is worth a task of its own.
FILE, LEAST = 1 << 20, 1 << 8
#: Splits that are looked for one by one where a section is read.
NEAR = 16


class Tokens:
    """The tokens of an archive: a file, or a folder whose files in the order of their names are the line."""

    def __init__(self, spark: SparkSession, path: str):
        file = F.col("_metadata.file_path").alias("file")
        raw = spark.read.option("lineSep", " ").text(path).select(F.xxhash64(file).alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
        # a record is a token, but at double blanks and line ends; v: the number that it is, t: another token
        number = F.col("value").try_cast("bigint")
        parts = F.array_remove(F.split("value", r"\s+"), "")
        found = raw.select("file", "start", F.explode(F.when(number.isNotNull(), F.array("value")).otherwise(parts)).alias("t")).withColumn("v", F.col("t").try_cast("bigint"))
        # tokens are numbered as their task reads them: those of a split follow each other, and a task has several splits
        found = found.select(F.monotonically_increasing_id().alias("id"), "file", "start", "v", F.when(F.col("v").isNull(), F.col("t")).alias("t"))
        self.rows = storage.save(found, "tokens")
        # names come from the folder's list, so that no token carries one
        names = spark.read.format("binaryFile").load(path).select(file).select(F.xxhash64("file").alias("file"), F.col("file").alias("name"))
        splits = self.rows.groupBy("file", "start").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        counts = splits.join(names, "file").orderBy("name", "start").select("id", "n").collect()  # a row per split
        self.splits, self.before = [r.id for r in counts], [0]
        for r in counts:
            self.before.append(self.before[-1] + r.n)
        self.held: dict[int, str] = {}

    def word(self, i: int, ahead: int = 64) -> str:
        """Token i; some after it are fetched with it."""
        if i not in self.held and 0 <= i < self.before[-1]:
            which = bisect_right(self.before, i) - 1
            stop = min(i + ahead, self.before[which + 1])
            shift = self.splits[which] - self.before[which]
            near = self.rows.where(F.col("id").between(i + shift, stop + shift - 1))
            self.held |= {r.id - shift: str(r.v) if r.t is None else r.t for r in near.select("id", "v", "t").collect()}
        if i not in self.held:
            raise ValueError("the archive ends early")
        return self.held[i]

    def number(self, i: int) -> int:
        return int(self.word(i))

    def section(self, first: int, n: int, place: str, value: str) -> DataFrame:
        """(place, value): n whole numbers from token `first` on, numbered from 0."""
        spark = self.rows.sparkSession
        # of each split that has some: its task, the first and last of its tokens that are wanted, and what is added to get a place
        known = []
        for at, b, c in zip(self.splits, self.before, self.before[1:], strict=False):
            lo, hi = max(b, first), min(c, first + n)
            if lo < hi:
                known.append((at >> 33, at + lo - b, at + hi - b - 1, b - first - at))
        bases = spark.createDataFrame(known, "part long, lo long, hi long, base long")
        if len(known) * 64 <= storage.BROADCAST_BYTES:
            bases = F.broadcast(bases)
        # ids lie in the files in their order, so a short section is read from few of them
        near = [(lo, hi) for _, lo, hi, _ in known] if len(known) <= NEAR else [(min(k[1] for k in known), max(k[2] for k in known))]
        rows = self.rows.where(reduce(lambda x, y: x | y, (F.col("id").between(lo, hi) for lo, hi in near), F.lit(False)))
        rows = rows.join(bases, (F.shiftright("id", 33) == F.col("part")) & (F.col("id") >= F.col("lo")) & (F.col("id") <= F.col("hi")))
        return rows.select((F.col("base") + F.col("id")).alias(place), F.coalesce("v", F.col("t").cast("bigint")).alias(value))  # other tokens need not be numbers


def read_dense(spark: SparkSession, path: str, index: tuple[str, ...], value: str = "v") -> Tensor:
    """A dense tensor; index names its dimensions, outermost first."""
    line, rank = Tokens(spark, path), len(index)
    if [line.word(i) for i in range(3)] != HEAD or line.number(5) != rank:
        raise ValueError(f"{path} is no archive of rank {rank}")
    shape = tuple(line.number(7 + k) for k in range(rank))[::-1]
    size, first = line.number(7 + rank), 7 + rank + 2
    flat = line.section(first, size, "_p", value)
    return Tensor(flat.select(*unflatten(F.col("_p"), index, shape), value), index, shape, value)


def _write(tokens: list[DataFrame], n: int, path: str) -> None:
    """Writes n tokens (i, t), i from 0 on, in order, each file a range of them."""
    every = reduce(DataFrame.unionByName, tokens)
    files = max(min(every.sparkSession.sparkContext.defaultParallelism, n // LEAST), -(-n // FILE))
    dealt = every.repartitionById(files, F.expr(f"int(i div {-(-n // files)})"))
    dealt.sortWithinPartitions("i").select(F.col("t").alias("value")).write.option("lineSep", " ").text(path)


def _head(spark: SparkSession, first: int, words: list) -> DataFrame:
    return spark.createDataFrame([(first + k, str(w)) for k, w in enumerate(words)], "i long, t string")


def write_dense(t: Tensor, path: str) -> None:
    """Writes a dense tensor."""
    n = 1
    for d in t.shape:
        n *= d
    head = [*HEAD, 0, 0, len(t.shape), 0, *t.shape[::-1], n, 0]
    place = flatten([F.col(c) for c in t.index], t.shape) + len(head)
    _write([_head(t.df.sparkSession, 0, head), t.dense().df.select(place.alias("i"), F.col(t.value).cast("bigint").cast("string").alias("t"))], len(head) + n, path)


def read_compressed(spark: SparkSession, path: str, index: tuple[str, ...], value: str = "v") -> Tensor:
    """A compressed tensor as coordinates; index names its levels, outermost first.

    Each level's positions find the fiber that holds them block by block, so a
    fiber of any length is many tasks.
    """
    line = Tokens(spark, path)
    if [line.word(i) for i in range(3)] != HEAD:
        raise ValueError(f"{path} is no archive")
    rank = line.number(5)
    if rank != len(index) or line.number(7) != rank:
        raise ValueError(f"{path} has rank {rank}")
    shape = tuple(line.number(9 + k) for k in range(rank))[::-1]
    at = 9 + rank
    at += 4 + 2 * line.number(at + 2)  # names
    at += 2 + line.number(at)  # the last coordinate
    sections = []
    for _ in range(2 * rank + 1):
        at += 3  # a list of one number, the length of what follows
        n = line.number(at)
        sections.append((at + 2, n))
        at += 2 + n
    rows = None
    for level, name in enumerate(index):
        bounds = line.section(*sections[level], "_f", "start")
        ranges = bounds.join(bounds.select((F.col("_f") - 1).alias("_f"), F.col("start").alias("stop")), "_f")
        # the values lie at the places of the innermost coordinates
        beside = line.section(*sections[-1], "_p", value) if level == rank - 1 else None
        own = scans.with_owner(line.section(*sections[rank + level], "_p", name), ranges, "_p", "_f", beside=beside, tasks=-(-2 * sections[rank + level][1] // sparse.SORTED))
        own = own.withColumn(name, F.col(name).cast("int"))
        if rows is not None:
            above = rows.withColumnRenamed("_p", "_f")
            own = own.join(F.broadcast(above) if sections[rank + level - 1][1] * 64 <= storage.BROADCAST_BYTES else above, "_f")
        rows = own.select("_p", *index[: level + 1], *([value] if beside is not None else []))
    return Tensor(rows.select(*index, value), index, shape, value)


def write_compressed(t: Tensor, path: str) -> None:
    """Writes a compressed tensor."""
    spark, rank = t.df.sparkSession, len(t.shape)
    c = sparse.encode(t)
    # the last entry's prefixes are the last points of their levels, and each point above has a fiber
    ends = {r.level: r for r in c.coords.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max_by("coord", "pos").alias("last")).collect()}
    points = [ends[k].n if k in ends else 0 for k in range(rank)]
    fibers, entries = [min(points[0], 1), *points[:-1]], points[-1]
    final = [ends[k].last for k in range(rank)] if entries else None
    head = [*HEAD, 0, 0, rank, entries, rank, 0, *t.shape[::-1], 0, 0, 0, 0, rank, 0, *(reversed(final) if final else [0] * rank)]
    parts, at = [_head(spark, 0, head)], len(head)

    def add(n: int, first: list, rows: DataFrame, place: str, value: str) -> None:
        nonlocal at
        words = [1, 0, n, n, 0, *first]
        body = rows.select((F.col(place) + (at + len(words))).cast("long").alias("i"), F.col(value).cast("string").alias("t"))
        parts.extend([_head(spark, at, words), body])
        at += 5 + n

    for k in range(rank):
        # a fiber's segment begins where the one before ends; without entries the root's is empty
        none = [0] if k == 0 and not entries else []
        add(fibers[k] + 1 + len(none), [0, *none], c.segments.where(F.col("level") == k), "parent_pos", "stop")
    for k in range(rank):
        add(points[k], [], c.coords.where(F.col("level") == k), "pos", "coord")
    add(entries, [], c.values, "pos", "v")
    _write(parts, at, path)
