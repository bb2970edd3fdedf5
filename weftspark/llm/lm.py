"""Language-model scoring in Spark: a unigram base and the context-mixing model of mixing.py.

Three passes: token and byte counts of the training texts; counts and weights
of the bit predictors (each task learns on its part, counts are added up,
weights averaged by the bits they saw); and scoring. The predictors' tables
grow with the square root of the training bytes; a file for each lies in the
shared folder and is memory-mapped by the tasks (a byte a slot; a learning task
holds four). The HEAD most frequent tokens travel to all tasks. Rarer
tokens of a text are joined with the token table, so any vocabulary
does, and no frequent token is ever a join key. A long text is learnt from and
scored in parts, whatever its length.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common, mixing
from weftspark.llm.decontam import Lookup

#: Tokens whose counts travel to all tasks (16 bytes each), at most.
HEAD = 1_000_000
#: Distinct tokens, and bytes of them, that a task holds before it passes their counts on.
HELD, HELD_BYTES = 400_000, 1 << 25
#: Slots of a table in one row of the exchange.
PART = 1 << 17
#: Tasks whose counts meet in one task of the first of two rounds of adding up, as one in so many.
SALT = 16


@dataclass(frozen=True)
class Base:
    """Token counts: all tokens, distinct ones, ends, and the frequent ones by hash."""

    tokens: int
    distinct: int
    ends: int
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def total(self) -> int:
        return self.tokens + self.distinct + 1


def _steps(batches: Iterator[pa.RecordBatch], column: int):
    """(batch, lo, hi, stream, skip, first, last): whole texts lo to hi, or a part of text lo, of whose stream the first `skip` bytes were in the part before."""
    common.keep_memory()
    for b in batches:
        held = None
        for lo, hi, raw, off, before in common.text_steps(*common.texts_of(b.column(column)), mixing.SHARED):
            if before and len(common.word_spans(raw, off)[0]) == mixing.SHARED:
                continue  # white space is all that follows
            if held:  # only what follows tells whether a part is a text's last
                yield _step(b, *held, held[0] != lo)
            held = lo, hi, raw, off, before
        if held:
            yield _step(b, *held, True)


def _step(b, lo, hi, raw, off, before, last):
    stream, skip = mixing.part_of(raw, off, before, last)
    return b, lo, hi, stream, skip, before == 0, last


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of count_tokens() of a task, a token in more than one where the task passes on what it holds."""
    parts, rows, size, pairs, ends = [], 0, 0, np.zeros(1 << 16, np.int64), 0

    def added() -> pa.Table:
        return pa.Table.from_batches(parts).group_by("token").aggregate([("n", "sum")]).select(["token", "n_sum"]).rename_columns(["token", "n"])

    for _, lo, hi, stream, skip, _, last in _steps(batches, 0):
        pairs += np.bincount(stream.pairs()[skip:], minlength=1 << 16)
        ends += (hi - lo) * last
        counts = stream.word_array(skip).value_counts()
        parts.append(pa.RecordBatch.from_arrays(counts.flatten(), names=["token", "n"]))
        rows, size = rows + len(counts), size + parts[-1].nbytes
        if rows > HELD or size > HELD_BYTES:
            every = added()
            if every.num_rows > HELD // 2 or every.nbytes > HELD_BYTES // 2:
                yield from every.to_batches()
                parts, rows, size = [], 0, 0
            else:
                parts, rows, size = every.combine_chunks().to_batches(), every.num_rows, every.nbytes
    if parts:
        yield from added().to_batches()
    some = np.flatnonzero(pairs).tolist()
    yield pa.RecordBatch.from_arrays([pa.array(["\n", *(f"\n{v}" for v in some)]), pa.array([ends, *pairs[some].tolist()], pa.int64())], names=["token", "n"])


def count_tokens(train: DataFrame) -> DataFrame:
    """(token, n) over the column text, saved. Keys that start with a line end are no words: alone, the ends; with a number, a pair of neighbouring bytes of the normalised texts."""
    return common.save(train.select("text").mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 0"), "tokens")


def base_of(tokens: DataFrame) -> tuple[Base, np.ndarray]:
    """The base's numbers, and the counts of byte pairs, from count_tokens()."""
    word = ~F.col("token").startswith("\n") | (F.col("token") == "\n")
    total = tokens.where(word).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("token") == "\n", F.col("n"))), F.lit(0)).alias("e")).first()
    values = np.zeros(1 << 16, np.int64)
    for r in tokens.where(~word).collect():  # a row per pair of bytes at most, 65,536
        values[int(r.token)] = r.n
    words = tokens.where(~F.col("token").startswith("\n"))
    # the lowest count whose tokens and all more frequent ones are HEAD at most, by eighths of powers of two
    level = F.floor(F.log2("n") * 8).cast("int")
    least, room = None, HEAD
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundred rows
        room -= r["count"]
        if room < 0:
            break
        least = r.level

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = common.texts_of(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(common.word_hashes(raw, off[:-1], off[1:]).view(np.int64)), b.column(1)], names=["h", "n"])

    if least is None:
        return Base(total.n, total.v, total.e, np.zeros(0, np.uint64), np.zeros(0, np.int64)), values
    head = words.where(level >= least).select("token", "n").mapInArrow(hashed, "h long, n long").toArrow()  # HEAD rows at most
    h = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Base(total.n, total.v, total.e, h[order], head.column("n").to_numpy()[order]), values


def _pack(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


PARTS = "k int, j int, salt int, blob binary"


def _parts(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    k, j, salt, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(salt, pa.int32()), pa.array(blob, pa.binary())], names=["k", "j", "salt", "blob"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each (k, j): counts as 64-bit numbers, weights as they are; a task holds its keys' sums only."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for k, j, salt, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = _unpack(blob, np.float64 if k < 0 else np.uint16 if salt >= 0 else np.uint64)
            have = sums.get((k, j))
            if have is None:
                sums[k, j] = x.astype(np.uint64 if k >= 0 else np.float64)
            else:
                have += x
    for (k, j), x in sums.items():
        yield _parts([(k, j, -1, _pack(x))])


def learn(train: DataFrame, code: mixing.Code, bits: tuple[int, ...]) -> tuple[list[str], np.ndarray]:
    """Files of the tables of log odds, a byte a slot, and mixing weights, from the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = mixing.Learner(code, bits)
        for _, _, _, stream, skip, _, _ in _steps(batches, 0):
            learner.learn(stream, skip)
        if not learner.seen:
            return
        salt = TaskContext.get().partitionId() % SALT
        for k in range(len(bits)):
            counts = learner.counts(k).reshape(-1)
            for j in range(0, len(counts), 2 * PART):
                part = counts[j : j + 2 * PART]
                if part.any():
                    yield _parts([(k, j // (2 * PART), salt, _pack(part))])
        yield _parts([(-1, 0, salt, _pack(np.append(learner.weights.ravel() * learner.seen, float(learner.seen))))])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _added(batches):
            k, j, _, blob = (c[0].as_py() for c in b.columns)
            yield _parts([(k, j, 0, _pack(mixing.odds(_unpack(blob, np.uint64).reshape(-1, 2))) if k >= 0 else blob)])

    folder = common.scratch_path(train.sparkSession, "tables")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a predictor's parts, which come in order, one after another; of tasks that are repeated, only the file named in the result is read."""
        out, k, at = None, -1, 0
        for b in batches:
            for key, j, _, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key < 0:
                    yield _parts([(key, 0, 0, blob)])
                    continue
                if out is None:
                    store, path = pafs.FileSystem.from_uri(folder)
                    store.create_dir(path, recursive=True)
                    name, k = f"{key}-{uuid.uuid4().hex}", key
                    out = store.open_output_stream(f"{path}/{name}")
                for _ in range(at, j):
                    out.write(bytes(min(PART, 1 << bits[k])))
                out.write(_unpack(blob, np.int8).tobytes())
                at = j + 1
        if out is not None:
            for _ in range(at, max(1, (1 << bits[k]) // PART)):
                out.write(bytes(min(PART, 1 << bits[k])))
            out.close()
            yield _parts([(k, 0, 0, f"{folder}/{name}".encode())])

    rows = train.select("text").mapInArrow(run, PARTS)
    sums = common.save(rows.repartition("k", "j", "salt").mapInArrow(_added, PARTS).repartition("k", "j").mapInArrow(finished, PARTS), "sums")
    # the weights' row and a row per predictor
    files = sums.repartitionById(len(bits) + 1, F.col("k") + 1).sortWithinPartitions("k", "j").mapInArrow(file, PARTS).collect()
    common.drop(sums)
    tables = [""] * len(bits)
    weights = np.full((mixing.GATES, len(mixing.ORDERS)), 0.3)
    for r in files:
        if r.k < 0:
            x = _unpack(r.blob, np.float64)
            weights = (x[:-1] / x[-1]).reshape(weights.shape)
        else:
            tables[r.k] = r.blob.decode()
    return tables, weights


def table_of(where: str, bits: int) -> np.ndarray:
    """A predictor's table, mapped where its store is mounted; without a file, a table that knows nothing."""
    if not where:
        return np.zeros(1 << bits, np.int8)
    store, path = pafs.FileSystem.from_uri(where)
    if isinstance(store, pafs.LocalFileSystem):
        return np.asarray(np.memmap(path, np.int8, "r", shape=(1 << bits,)))
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.int8)


@functools.lru_cache(1)
def _tables(files: tuple[str, ...], bits: tuple[int, ...]) -> list[np.ndarray]:
    return [table_of(f, b) for f, b in zip(files, bits, strict=True)]


RAW = "uid long, doc_id long, n_tokens long, n_known long, n_bytes long, base double, score double, token string, tf int"


def _score(docs: DataFrame, base: Base, code: mixing.Code, files: list[str], bits: tuple[int, ...], weights: np.ndarray) -> DataFrame:
    """For each row of docs (uid, doc_id, text) a row, with the frequent tokens' part of its base score, and a row for each of its rarer tokens."""
    hashes, logs = base.hashes, np.log10(base.counts + 1.0)
    floor, end_log, end_known = math.log10(base.total), math.log10(base.ends + 1.0), int(base.ends > 0)
    fields = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_bytes", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("token", pa.string()), ("tf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, scorer = Lookup(hashes), mixing.Scorer(code, _tables(tuple(files), bits), weights)
        for b, lo, hi, stream, skip, begins, last in _steps(batches, 2):
            n = hi - lo
            starts, ends = stream.spans()
            new = starts >= skip
            text, starts, ends = np.repeat(np.arange(n), stream.words)[new], starts[new], ends[new]
            hit, place = look.find(common.word_hashes(stream.data, starts, ends)) if len(text) else (np.zeros(0, np.int64),) * 2
            words = np.bincount(text, minlength=n)
            known = np.bincount(text[hit], minlength=n)
            sums = np.bincount(text[hit], weights=logs[place], minlength=n) - words * floor
            uid = b.column(0).slice(lo, n)
            if begins and last:
                row = words, known, sums, np.diff(stream.off), scorer.score(stream)
            else:
                if begins:
                    long, refined = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)], mixing.Refinement()
                for x, y in zip(long, (words, known, sums, len(stream.data) - skip), strict=True):
                    x += y
                for chunk in scorer.mixed(stream, skip):
                    refined.add(*chunk)
                row = (*long, np.array([refined.total]))
            none = lambda t: pa.nulls(n, t)
            if last:
                words, known, sums, size, total = row
                yield pa.RecordBatch.from_arrays([uid, b.column(1).slice(lo, n), pa.array(words + 1), pa.array(known + end_known), pa.array(size), pa.array(sums + end_log - floor), pa.array(total / math.log(10)), none(pa.string()), none(pa.int32())], schema=fields)
            rare = np.ones(len(text), bool)
            rare[hit] = False
            rare = np.flatnonzero(rare)
            data = stream.data.tobytes()
            found = Counter(zip(text[rare].tolist(), (data[a:z] for a, z in zip(starts[rare].tolist(), ends[rare].tolist(), strict=True)), strict=True))
            if found:
                rows, tokens = zip(*found, strict=True)
                m = len(rows)
                yield pa.RecordBatch.from_arrays([uid.take(pa.array(rows)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array([t.decode() for t in tokens], pa.string()), pa.array(list(found.values()), pa.int32())], schema=fields)

    return docs.select("uid", "doc_id", "text").mapInArrow(run, RAW)


def score(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability), n_bytes, bits and bits_per_byte of each row.

    Bytes are those the model predicts: the words', a separator after each, the
    last one the end; bits are the score's.

    Learns from the rows for which `trainable` (over the column doc_id) is
    true. Null texts are empty ones and hold the end only. Null and repeated
    ids stay as they are. Other columns are ignored. Without training rows the
    base gives every token the same probability and the predictors know nothing.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    train = docs.where(F.coalesce(trainable, F.lit(False)))
    tokens = count_tokens(train)
    base, values = base_of(tokens)
    code = mixing.Code(values)
    bits = mixing.sizes(int(values.sum()))
    files, weights = learn(train, code, bits)
    raw = common.save(_score(docs.withColumn("uid", F.monotonically_increasing_id()), base, code, files, bits, weights), "scores")
    for f in filter(None, files):
        common.drop_path(docs.sparkSession, f)
    rare = raw.where("token is not null").join(tokens, "token").groupBy("uid").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("logs"))
    texts = raw.where("token is null").join(rare, "uid", "left")
    bits = F.col("score") * -math.log2(10)
    return texts.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(base.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), "score", "n_bytes", bits.alias("bits"), (bits / F.col("n_bytes")).alias("bits_per_byte"))
