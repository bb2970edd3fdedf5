"""SimHash near-duplicates by a segment-popcount embedding, on a grid whose cells need no neighbours (no range is left).

A fingerprint's 64 bits are 32 segments of two; the counts of set bits in the
segments are a point whose Manhattan distance to another's is never more than
the bits that differ. The grid's cells have width one in 16 of the 32
coordinates: of six groups of coordinates, a distance of 3 leaves three groups
without any difference, so over all choices of three groups the range of
neighbouring cells to be looked at shrinks to the cell itself, and the range
join becomes twenty joins on equal cells that lose nothing. (Wider segments in
fewer groups need the neighbours as well, and their cells, of four to eight
coordinates, tell too few fingerprints apart on large corpora.) Within a cell
the Manhattan distance is tested first and the differing bits are counted last.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common
from weftspark.llm.components import components

#: Fingerprints link at so many differing bits or fewer.
DISTANCE = 3
WORDS = 3
SEED = 42
#: Fingerprints of a cell that one task compares with each other; larger cells are split into blocks, compared pair by pair.
BLOCK = 2048
#: Bits of the six coordinate groups (whole segments of two bits).
GROUPS = (10, 10, 10, 10, 12, 12)


def _bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many hashes of each text have each bit; hashes of text i are those from first[i] to first[i + 1]."""
    out = np.zeros((len(first) - 1, 64), np.int64)
    ones = np.uint64(0x0101010101010101)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    for shift in range(8):  # eight bits, one of each byte, at a time
        lanes = ((hashes >> np.uint64(shift)) & ones).view(np.uint8).reshape(-1, 8)
        out[full, shift::8] = np.add.reduceat(lanes, first[:-1][full], axis=0, dtype=np.int64)
    return out


def _shingle_bits(raw: np.ndarray, off: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text, how many of its shingles' hashes have each bit, and its shingles; before: words ahead of a text's part."""
    low = common.lower_ascii(raw)
    starts, ends, first = common.word_spans(low, off)
    has = np.diff(first)
    lengths = ends - starts
    # the words of each text with one space between, so that a shingle is a slice
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    joined = np.full(int(at[-1]), 32, np.uint8)
    # a word's bytes: consecutive source and target places
    src = np.repeat(starts - at[:-1], lengths) + (np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths))
    joined[src - np.repeat(starts - at[:-1], lengths)] = low[src] if len(src) else low[:0]
    data = joined.tobytes()
    counts = np.maximum(has - WORDS + 1, 0 if before else np.minimum(has, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=begin[1:])
    word = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(int(begin[-1]))
    last = np.minimum(word + WORDS, np.repeat(first[1:], counts))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(data[a:b], SEED) for a, b in zip(at[word].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, len(word))
    return _bit_counts(hashes, begin), counts


def fingerprints_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints of texts given as bytes and offsets; long texts are worked off in parts."""
    ones, shingles = np.zeros((len(off) - 1, 64), np.int64), np.zeros(len(off) - 1, np.int64)
    for lo, hi, part, at, before in common.text_steps(raw, off, WORDS - 1):
        bits, n = _shingle_bits(part, at, before)
        ones[lo:hi] += bits
        shingles[lo:hi] += n
    return ((2 * ones > shingles[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of each row; a null text is an empty one, with fingerprint zero."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(*common.texts_of(b.column(1))).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments in unary (00, 01, 11): differing bits are then the Manhattan distance."""
    odd = np.uint64(0x5555555555555555)
    low, high = fp & odd, (fp >> np.uint64(1)) & odd
    return (low | high) | ((low & high) << np.uint64(1))


def cells_of(fp: np.ndarray) -> np.ndarray:
    """(fingerprints, 20) keys of the cells that a fingerprint's point lies in."""
    u, masks, at = unary(fp), [], 0
    for bits in GROUPS:
        masks.append(((1 << bits) - 1) << at)
        at += bits
    keys = [common.mix((u & np.uint64(a | b | c)) ^ common.mix(np.array([i + 1], np.uint64))) for i, (a, b, c) in enumerate(combinations(masks, 3))]
    return np.stack(keys, axis=1)


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        cells = cells_of(fp)
        yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, cells.shape[1]).view(np.int64))], names=["cell", "fp"])


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest index linked to each of n items through the links u-v."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a and b that differ in `distance` bits at most, the Manhattan bound first."""
    ua, ub = unary(a), unary(b)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo in range(0, len(a), 512):
        i, j = np.nonzero(np.bitwise_count(ua[lo : lo + 512, None] ^ ub[None, :]) <= distance)
        near = np.bitwise_count(a[i + lo] ^ b[j]) <= distance
        out.append((i[near] + lo, j[near]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _cell_links(rows: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, bi, bj, side, fp) sorted by cell, bi, bj: links of each block pair, as few as connect the same fingerprints."""
    key, held = None, []

    def found():
        side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        left, right = fp[side == 0].view(np.uint64), fp[side == 1].view(np.uint64)
        every = np.concatenate([left, right]) if len(right) else left
        if len(right):
            i, j = _close(left, right, distance)
            j = j + len(left)
        else:
            i, j = _close(left, left, distance)
            i, j = i[i < j], j[i < j]
        label = forest(i, j, len(every))
        child = np.flatnonzero(label != np.arange(len(every)))
        return every[child].view(np.int64), every[label[child]].view(np.int64)

    out: list = []

    def flush():
        u, v = (np.concatenate(x) for x in zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in rows:
        cell, bi, bj, side, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(cell):
            continue
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
            now = (cell[lo], bi[lo], bj[lo])
            if now != key:
                if held:
                    out.append(found())
                key, held = now, []
            held.append((side[lo:hi], fp[lo:hi]))
        if len(out) > 1000:
            yield flush()
    if held:
        out.append(found())
    if out:
        yield flush()


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) among the distinct values of the column fp that connect what differs in `distance` (3 at most) bits.

    A cell with more than BLOCK fingerprints is split by hash into blocks; each
    pair of its blocks is compared in a task of its own.
    """
    if not 0 <= distance <= 3:
        raise ValueError("six groups of coordinates suffice for a distance of 3 at most")
    grid = fps.select("fp").distinct().mapInArrow(_grid, "cell long, fp long")
    sizes = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = grid.join(sizes, "cell").withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    tasks = F.expr("transform(sequence(0, nb - 1), o -> named_struct('bi', least(b, o), 'bj', greatest(b, o), 'side', int(o < b)))")
    spread = rows.select("cell", F.explode(tasks).alias("t"), "fp").select("cell", "t.bi", "t.bj", "t.side", "fp")
    placed = spread.repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj")
    return placed.mapInArrow(lambda it: _cell_links(it, distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id: the smallest id reachable by links, the row's own included.

    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id are returned with their fingerprint and a null component;
    they link nothing. A repeated id is in the component of either row's text.
    Other columns are ignored. An empty table gives an empty result.
    """
    marks = common.save(fingerprints(docs, id_col, text_col), "fingerprints")
    known = marks.where("doc_id is not null")
    least = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = components(links(known, distance)).withColumnRenamed("node", "fp")
    # the component's smallest document: classes are few beside the documents, and each fingerprint comes once
    labelled = least.join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(smallest, "component").select("fp", "component_id")
    return marks.join(by_fp, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but for those whose component has a smaller id. Rows with a null id stay; rows with one id stay or go together."""
    near = near_duplicates(docs, distance, id_col, text_col)
    # an id whose texts lie in several components goes only if all of them have smaller ids
    gone = near.where("doc_id is not null").groupBy(F.col("doc_id").alias("weft_id")).agg(F.max("component_id").alias("c")).where("c < weft_id").select("weft_id")
    gone = common.small(common.save(gone, "copies"), 16)
    return docs.join(gone, F.col(id_col).cast("long") == F.col("weft_id"), "left_anti")
