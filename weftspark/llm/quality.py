"""Compression classifier for document quality.

Two zstandard dictionaries are built, from good and from bad labelled texts. A
text is compressed with either; the difference of the two sizes, normalised by
the square root of the text's size (as the spread of a sum of that many terms),
becomes a probability through a logistic calibration on other labelled rows.
Nothing else about a text enters its score.

Only fitting uses a bounded sample (DICTIONARY_ROWS of SAMPLE_BYTES together
and CALIBRATION_ROWS per label, the rows whose hash is smallest); every text is
scored whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common

#: Labelled rows per class whose texts go into a dictionary, and rows per class that calibrate the score.
DICTIONARY_ROWS, CALIBRATION_ROWS = 2000, 3000
#: Bytes of text per class that a dictionary is built from; rows that no longer fit are passed over.
SAMPLE_BYTES = 32 << 20
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: A document counts as good from this score on.
THRESHOLD = 0.7
SCHEMA = "doc_id long, score double"


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; known: whether there were labels of both kinds to learn from."""

    good: bytes = b""
    bad: bytes = b""
    trained: bool = False
    slope: float = 0.0
    offset: float = 0.0
    known: bool = False


@functools.lru_cache(4)
def _compressors(good: bytes, bad: bytes, trained: bool):
    import zstandard

    out = []
    for data in (good, bad):
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        book = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
        if book:
            book.precompute_compress(LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return out


def _differences(texts: list[str | None], compressors) -> np.ndarray:
    """Normalised difference of the sizes with the bad and with the good dictionary."""
    good, bad = compressors
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        out[i] = (len(bad(raw)) - len(good(raw))) / (len(raw) + 1) ** 0.5
    return out


def _logistic(x: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))


def _dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or the texts themselves where there is too little for training."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), True
    except zstandard.ZstdError:
        return b"\n".join(samples), False


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression, by Newton steps."""
    mean, scale = x.mean(), max(x.std(), 1e-9)
    a, w = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(40):
        p = _logistic(a @ w, 1.0, 0.0)
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        w -= np.linalg.solve(h, a.T @ (weight * (p - y)) + 0.1 * w)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on labelled documents for which `trainable` (over the column doc_id) holds.

    Rows with a null id, text or label are not learnt from; an id with both
    labels counts as bad, and one with several texts has the first of them in
    order. Without labels of both kinds, some of each to calibrate with, every
    score is 0.5.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & trainable).groupBy("doc_id").agg(F.min("y").alias("y"))
    # more than are needed are drawn, as labelled ids may have no document
    want = 2 * (DICTIONARY_ROWS + CALIBRATION_ROWS)
    draw = F.xxhash64("doc_id", F.lit("sample"))
    picked = [marks.where(F.col("y") == y).orderBy(draw, "doc_id").limit(want) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * want rows of two numbers
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = common.save(found, "sample")  # all that is fitted on; the corpus is read once
    samples, used = [], []
    for y in (0, 1):
        own = rows.where(F.col("y") == y)
        sizes = own.select("doc_id", F.octet_length("text").alias("n")).orderBy(draw, "doc_id").limit(DICTIONARY_ROWS).collect()
        # a class with few rows leaves a quarter of them for calibration
        sizes, room, chosen = sizes[: len(sizes) * 3 // 4] if len(sizes) < DICTIONARY_ROWS else sizes, SAMPLE_BYTES, []
        for r in sizes:
            if r.n <= room:
                room -= r.n
                chosen.append(r.doc_id)
        used.append({r.doc_id for r in sizes})
        texts = own.where(F.col("doc_id").isin(chosen)).select("doc_id", "text").orderBy(draw, "doc_id").collect() if chosen else []  # SAMPLE_BYTES at most
        samples.append([r.text.encode() for r in texts if r.text])
    if not samples[0] or not samples[1]:
        common.drop(rows)
        return Model()
    (bad, whole), (good, also) = map(_dictionary, samples)
    if whole != also:  # both dictionaries are of one kind
        (bad, good), whole = (b"\n".join(x) for x in samples), False

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _compressors(good, bad, whole)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_differences(b.column(2).to_pylist(), use))], names=["doc_id", "y", "x"])

    shown = rows.select("doc_id", "y", "text").mapInArrow(measure, "doc_id long, y int, x double")
    points = [r for r in shown.orderBy(draw, "doc_id").limit(2 * want).collect() if r.doc_id not in used[r.y]]  # three numbers a row
    common.drop(rows)
    points = [r for y in (0, 1) for r in [p for p in points if p.y == y][:CALIBRATION_ROWS]]
    x, y = np.array([r.x for r in points]), np.array([r.y for r in points], float)
    if len(set(y.tolist())) < 2:
        return Model()
    # the classes are drawn apart: weigh them by their shares among all labelled rows
    share = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    weight = np.array([share[int(v)] / (y == v).sum() for v in y])
    return Model(good, bad, whole, *_calibrated(x, y, weight * len(y) / weight.sum()), True)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row; null texts score as empty ones, null and repeated ids stay as they are."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _compressors(model.good, model.bad, model.trained)
        for b in batches:
            s = _logistic(_differences(b.column(1).to_pylist(), use), model.slope, model.offset)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores THRESHOLD or more; all rows where there was nothing to learn from. One pass, nothing is shuffled."""
    if not model.known:
        return docs
    common.bounded_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _compressors(model.good, model.bad, model.trained)
        for b in batches:
            s = _logistic(_differences(b.column(at).to_pylist(), use), model.slope, model.offset)
            yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
