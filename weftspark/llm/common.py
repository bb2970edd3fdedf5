"""Shared pieces: scratch tables in the shared folder, Arrow helpers, word splitting and hashing."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch, about: one row more than fits, so a longer text is a batch of its own.
ARROW_BYTES = 2 << 20
#: Bytes of text that one numpy step looks at; a longer text is cut between words.
STEP_BYTES = 1 << 18
#: A side of a join is broadcast only if it was counted and is below this many bytes.
BROADCAST_BYTES = 16 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one of our own only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weft-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/weft/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes saved tables that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df._weft_path)


def drop_path(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session are bounded by bytes from now on, however many rows that is; a tighter bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not have or not 0 < int(have[1]) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size is below BROADCAST_BYTES, else unchanged (a shuffled join)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


@functools.lru_cache(1)
def keep_memory() -> None:
    """Memory that a task's arrays give back stays with its process from now on, up to some 60 MB: the C library
    takes its thresholds from the largest block given back, which by itself is so small that each step's arrays
    are returned to the system and cleared again, page by page. The block is never written to."""
    np.empty(31 << 20, np.uint8)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1, from 0) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(off: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about `most` bytes; a longer text is alone."""
    most = most or STEP_BYTES
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def is_space(raw: np.ndarray) -> np.ndarray:
    return _SPACE[raw]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word [^\\x20\\x09-\\x0D]+ and, per text, the index of its first word (rows + 1 values)."""
    inside = ~_SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def text_steps(raw: np.ndarray, off: np.ndarray, overlap: int = 0, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(lo, hi, bytes, offsets, before): whole texts lo to hi, or a part of text lo with `before` words ahead of it.

    A text longer than `most` bytes is cut at spaces into parts that share
    `overlap` words, so every sequence of overlap + 1 words is in one part only.
    """
    most = most or STEP_BYTES
    for lo, hi in steps(off, most):
        at, end, before = int(off[lo]), int(off[hi]), 0
        if hi > lo + 1 or end - at <= most:
            yield lo, hi, raw[at:end], off[lo : hi + 1] - at, 0
            continue
        size = most
        while True:
            cut = at + size
            while cut < end and not (space := np.flatnonzero(_SPACE[raw[cut : cut + 4096]])).size:
                cut += 4096
            cut = min(end, cut + int(space[0])) if cut < end else end
            part = np.array([0, cut - at])
            starts = word_spans(raw[at:cut], part)[0]
            if cut < end and len(starts) <= overlap:
                size *= 2
                continue
            yield lo, hi, raw[at:cut], part, before
            if cut == end:
                break
            before += len(starts) - overlap
            at, size = (at + int(starts[-overlap]) if overlap else cut), most


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Bytes of text that the tables of powers reach over.
_REACH = 1 << 17


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BYTE_BASE**i and BYTE_BASE**-i modulo 2**64 for i up to _REACH."""
    out = []
    for b in (BYTE_BASE, pow(BYTE_BASE, -1, 1 << 64)):
        p, have = np.ones(_REACH + 1, np.uint64), 1
        while have < len(p):
            more = min(have, len(p) - have)
            p[have : have + more] = p[:more] * np.uint64(pow(b, have, 1 << 64))
            have += more
        out.append(p)
    return out[0], out[1]


BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, from prefix sums over at most _REACH bytes at a time."""
    out, (p, q), lo, n = np.empty(len(starts), np.uint64), _powers(), 0, len(starts)
    one = np.uint64(1)
    while lo < n:
        at = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, at + _REACH, side="right")))
        size = int(ends[hi - 1]) - at
        if size <= _REACH:
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((raw[at : at + size].astype(np.uint64) + one) * p[:size], out=sums[1:])
            a = starts[lo:hi] - at
            out[lo:hi] = (sums[ends[lo:hi] - at] - sums[a]) * q[a]
        else:  # one word of more bytes
            total = 0
            for k in range(0, size, _REACH):
                part = raw[at + k : at + min(size, k + _REACH)].astype(np.uint64) + one
                total += int((part * p[: len(part)]).sum(dtype=np.uint64)) * pow(BYTE_BASE, k, 1 << 64)
            out[lo] = total % (1 << 64)
        lo = hi
    return mix(out + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each `width` neighbouring values, by doubling: no table of powers, whatever the length."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    every, have, out, at = values, 1, np.zeros(n, np.uint64), 0
    while True:
        if width & have:
            out += every[at : at + n] * np.uint64(pow(base, at, 1 << 64))
            at += have
        if at == width:
            return mix(out + np.uint64(width))
        every = every[:-have] + every[have:] * np.uint64(pow(base, have, 1 << 64))
        have *= 2


def batches(columns: dict[str, pa.Array | Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip((columns[f.name] for f in schema), schema, strict=True)], schema=schema)
