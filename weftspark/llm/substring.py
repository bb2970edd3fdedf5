"""Exact substring dedup over windows of 50 words.

Every window of 50 words of every text gets a Rabin-Karp hash (by doubling, so
a few steps give all windows). Consecutive windows that share the
smallest of their short word-sequence hashes (their anchor) form a run; where a
run starts and ends depends on the words alone, so a passage that two texts
share falls into the same runs but at its two edges. Spark counts runs by the
hash of all their windows, and counts single windows only where different runs
have the same anchor (others can't share a window). Windows found in a document with a smaller id become
intervals, merged into maximal ones, and the words they cover go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm import common

WINDOW = 50
#: Words of the sequences whose smallest hash in a window is its anchor.
ANCHOR = 12


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


class Windows:
    """Words, window hashes and anchors of some texts, given as bytes and offsets."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, window: int):
        self.window = window
        starts, ends, self.first = common.word_spans(raw, off)
        has = np.diff(self.first)
        self.words = common.word_hashes(raw, starts, ends)
        # windows lie inside one text
        self.count = np.maximum(has - window + 1, 0)
        self.begin = np.zeros(len(has) + 1, np.int64)
        np.cumsum(self.count, out=self.begin[1:])
        self.text = np.repeat(np.arange(len(has)), self.count)
        self.at = np.arange(int(self.begin[-1])) - np.repeat(self.begin[:-1] - self.first[:-1], self.count)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window at each word that has as many words after it."""
        return common.window_hashes(self.words, self.window, common.WORD_BASE), common.window_hashes(common.mix(self.words), self.window, common.SECOND_BASE)

    def runs(self) -> tuple[np.ndarray, ...]:
        """Text, first window, number of windows, anchor and hash of each run."""
        if not len(self.at):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        size = min(ANCHOR, self.window)
        anchor = _smallest(common.window_hashes(self.words, size, common.WORD_BASE), self.window - size + 1)[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.text[1:] != self.text[:-1])
        lo = np.flatnonzero(new)
        n = np.diff(np.append(lo, len(self.at)))
        # a run's windows in order: each hash is scrambled with its place
        one, two = self.hashes()
        place = common.mix((np.arange(len(self.at)) - np.repeat(lo, n)).astype(np.uint64) + np.uint64(1))
        every = np.add.reduceat(common.mix((one ^ common.mix(two))[self.at] ^ place), lo)
        return self.text[lo], self.at[lo] - self.first[self.text[lo]], n, anchor[lo], every


def _each(batches: Iterator[pa.RecordBatch], window: int, column: int) -> Iterator[tuple[pa.RecordBatch, int, int, int, Windows]]:
    for b in batches:
        for lo, hi, raw, off, before in common.text_steps(*common.texts_of(b.column(column)), window - 1):
            yield b, lo, hi, before, Windows(raw, off, window)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def runs_of(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, n, anchor, run): every run of windows of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, _, before, w in _each(batches, window, 1):
            text, start, n, anchor, sig = w.runs()
            ids = b.column(0).take(pa.array(text + lo))
            yield pa.RecordBatch.from_arrays([ids, pa.array((start + before).astype(np.int32)), pa.array(n.astype(np.int32)), _long(anchor), _long(sig)], names=["doc_id", "start", "n", "anchor", "run"])

    return docs.mapInArrow(run, "doc_id long, start int, n int, anchor long, run long")


def windows_of(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, h1, h2): the windows that docs (doc_id, text, wanted array<struct<start, n>>) ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, before, w in _each(batches, window, 1):
            asked = b.column(2).slice(lo, hi - lo)
            parts = asked.flatten()
            n = parts.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.repeat(np.arange(hi - lo), np.diff(asked.offsets.to_numpy())), n)
            start = np.arange(int(n.sum())) + np.repeat(parts.field("start").to_numpy(zero_copy_only=False) - (np.cumsum(n) - n), n) - before
            here = (start >= 0) & (start < w.count[text])  # of a long text, other parts have the others
            text, start = text[here], start[here]
            at, (one, two) = start + w.first[text], w.hashes()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text + lo)), pa.array((start + before).astype(np.int32)), _long(one[at]), _long(two[at])], names=["doc_id", "start", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, start int, h1 long, h2 long")


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, spans): maximal intervals [s, e) of words from overlapping ones (doc_id, s, e); a document's intervals are no more than its words."""
    before = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    # an interval beyond all before it starts a new one
    marked = spans.withColumn("new", F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1))
    islands = marked.withColumn("k", F.sum("new").over(upto)).groupBy("doc_id", "k").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return islands.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, spans): maximal word intervals of docs (doc_id, text) that windows also starting in a document with a smaller id cover.

    Documents without such windows have no row. Saved in the shared folder.
    """
    runs = common.save(runs_of(docs, window), "runs")
    first = runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    first = common.save(first, "run-counts")
    # runs that are whole in a smaller document
    known = first.where("least < most").select("anchor", "run", "least")
    whole = runs.join(known, ["anchor", "run"]).where(F.col("doc_id") > F.col("least")).select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + window).alias("e"))
    # different runs with one anchor may share windows: those are counted one by one, each run in its smallest document
    torn = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    asked = runs.join(first.join(torn, "anchor").select("anchor", "run", F.col("least").alias("doc_id")), ["anchor", "run", "doc_id"])
    asked = common.save(asked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("wanted")), "wanted")
    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("wanted")), F.lit(0)).alias("parts")).first()
    side = F.broadcast(asked) if 48 * size.rows + 16 * size["parts"] <= common.BROADCAST_BYTES else asked
    single = common.save(windows_of(docs.join(side, "doc_id").select("doc_id", "text", "wanted"), window), "windows")
    least = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least")
    # a table of its own, so that the join shuffles both sides and Spark can split a window that very many runs hold
    least = common.save(least, "least")
    part = single.join(least, ["h1", "h2"]).where(F.col("doc_id") > F.col("least")).select("doc_id", F.col("start").alias("s"), (F.col("start") + window).alias("e"))
    out = common.save(merged(whole.unionByName(part)), "intervals")
    common.drop(runs, first, asked, single, least)
    return out


def _sized(spans: DataFrame) -> DataFrame:
    """Saved intervals, to be broadcast only if they were counted and are few."""
    size = spans.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("parts")).first()
    return F.broadcast(spans) if 48 * size.rows + 16 * size["parts"] <= common.BROADCAST_BYTES else spans


def _kept(text: str | None, spans) -> tuple[list[bytes], int]:
    """The words kept and the number of words of a text."""
    words = (text or "").encode().split()
    if not spans:
        return words, len(words)
    out, at = [], 0
    for x in spans:
        out += words[at : x["s"]]
        at = x["e"]
    return out + words[at:], len(words)


def digest(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row.

    Null and empty texts have no words. Rows with a null id lose nothing and
    take nothing from others. Rows with the same id are one document to the
    others: each keeps its words, unless a smaller id has them. Other columns
    are ignored; an empty table gives an empty result.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs.where("doc_id is not null"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for text, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                kept, words = _kept(text, cut)
                n.append(words)
                gone.append(words - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.join(_sized(spans), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each text's repeated words removed: what is left is joined by single spaces; other texts stay as they are.

    length_col, if docs has it, becomes the new text's number of characters. A
    text of which nothing is left is empty, and its row stays.
    """
    common.bounded_batches(docs.sparkSession)
    spans = repeated_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null"), window)
    names = docs.columns
    joined = docs.join(_sized(spans).select(F.col("doc_id").alias("weft_id"), F.col("spans").alias("weft_spans")), F.col(id_col).cast("long") == F.col("weft_id"), "left").drop("weft_id")
    at, cut = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, length = [], []
            for text, spans in zip(b.column(at).to_pylist(), b.column(cut).to_pylist(), strict=True):
                new.append(b" ".join(_kept(text, spans)[0]).decode() if spans else text)
                length.append(len(new[-1]) if spans else None)
            cols = b.columns[:cut]
            cols[at] = pa.array(new, pa.string())
            if length_col in names:
                k = names.index(length_col)
                cols[k] = pa.compute.coalesce(pa.array(length, pa.int64()).cast(cols[k].type), cols[k])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select(*names, "weft_spans").mapInArrow(run, docs.schema)
