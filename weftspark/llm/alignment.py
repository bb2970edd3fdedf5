"""Alignment of two tokenizers: a byte-level merge vocabulary (A) and a piece vocabulary (B).

Both cut the same bytes, a space and the text; where an A token and a B token
end together, the two are linked and a group ends. Neither has a token across a
single space between two other characters, so texts fall into units there, and
the distinct units of a step are encoded and aligned once.

How often each pair of ids is linked is counted in three steps. A pair is one
64-bit key (B's id above A's). Tasks add up their keys (np.unique) and hand on
partial counts; these are sorted globally over ranges of keys, and each range's
task sums runs of equal keys and writes a shard: sorted keys and their counts,
as plain arrays in the shared folder. The shards are memory-mapped where that
folder is mounted and keys are looked up by binary search, so no task holds a
table that grows with the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common

#: Bytes of text whose distinct units are encoded together; a longer text is taken in parts.
STEP = 1 << 20
#: Characters of units that a library call gets as one text.
JOINED = 1 << 14
#: Partial counts in a shard, about.
SHARD_ROWS = 1 << 20
#: Different keys that a counting task holds before it hands them on.
HELD = 1 << 20
#: One whole text in so many, by its hash, is compared with the libraries' own ids.
WHOLE = 64
#: Shards that a task holds where they can't be mapped.
SHARDS_HELD = 4
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: How byte-level vocabularies write bytes: these as themselves, the others in order from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACE = "▁"


def _byte_of() -> dict[str, int]:
    out = {chr(b): b for b in _PLAIN}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def cut(text: str, most: int) -> Iterator[str]:
    """A text in parts of about `most` characters whose units are those of the whole; a part lost its leading space."""
    at = 0
    while len(text) - at > most and (m := _CUT.search(text, at + most)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class Aligner:
    """Both tokenizers, from the contents of their files, and the bytes of their ids."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(byte_json)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("A must be a byte-level vocabulary without text normalisation")
        model = sentencepiece_model_pb2.ModelProto.FromString(piece_model)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
            raise ValueError("B must add a leading space, fall back to bytes and leave texts as they are")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if any(p.type == kinds.NORMAL and re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces):
            raise ValueError("a piece of B spans two words")
        self.a = Tokenizer.from_str(byte_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        byte_of, vocabulary = _byte_of(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in s)
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        a, b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        # a token as it is written inside a group, at the end of its side, of a unit
        self.names = [x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b] + [x + "\n" for x in b]

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by A, a space before it, and by B."""
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def units(self, units: list[str]) -> Units:
        return Units(self, units)


class Units:
    """The alignment of some units. good: whether either side's bytes are a space and the unit; others have no tokens.

    Units without white space at their ends are put side by side again, in
    texts of JOINED characters: a call for each unit would cost more than its
    tokens. Their tokens are told apart by the bytes they end at.
    """

    def __init__(self, by: Aligner, units: list[str]):
        raw = [(" " + u).encode() for u in units]
        self.good = np.ones(len(units), bool)
        texts, held, size = [], [], 0
        for k, u in enumerate(units):
            alone = u[:1].isspace() or u[-1:].isspace() or SPACE in u
            if held and (alone or size > JOINED):
                texts.append(held)
                held, size = [], 0
            held.append(k)
            size += len(u)
            if alone:
                texts.append(held)
                held, size = [], 0
        if held:
            texts.append(held)
        a, b = by.ids([" ".join(units[t[0] : t[-1] + 1]) for t in texts])
        if b"".join([by.bytes_a[i] for x in a for i in x]) != (whole := b"".join(raw)) or b"".join([by.bytes_b[i] for x in b for i in x]) != whole:
            for k, t in enumerate(texts):
                want = b"".join(raw[t[0] : t[-1] + 1])
                if not b"".join([by.bytes_a[i] for i in a[k]]) == want == b"".join([by.bytes_b[i] for i in b[k]]):
                    if len(t) > 1:
                        raise AssertionError("units side by side have other tokens than alone")
                    self.good[t[0]], a[k], b[k], raw[t[0]] = False, [], [], b""
        ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *(np.array(y, np.int64) for y in x)]) for x in (a, b))
        end_a, end_b = np.cumsum(by.size_a[ids_a]), np.cumsum(by.size_b[ids_b])
        unit_end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        if not (np.isin(unit_end, end_a) | ~self.good | (unit_end == 0)).all():
            raise AssertionError("a token spans two units")
        self.n_a, self.n_b = (np.bincount(np.searchsorted(unit_end, x), minlength=len(units)) for x in (end_a, end_b))
        # ends in common
        at = np.searchsorted(end_a, end_b)
        met = end_a[np.minimum(at, len(end_a) - 1)] == end_b if len(end_a) else np.zeros(0, bool)
        common_end = end_b[met]
        self.keys = ids_b[met] << 32 | ids_a[at[met]]
        unit = np.searchsorted(unit_end, common_end)
        self.n_links = np.bincount(unit, minlength=len(units))
        self.begin = np.cumsum(self.n_links) - self.n_links
        # the groups, written out
        group_a, group_b = np.searchsorted(common_end, end_a), np.searchsorted(common_end, end_b)
        many_a, many_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(common_end)))]) for g in (group_a, group_b))
        code, last = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a), bool)
        last[at[met]] = True
        code[np.arange(len(ids_a)) + many_b[group_a]] = ids_a + len(by.bytes_a) * last
        final = np.zeros(len(ids_b), np.int64)
        final[met] = 1 + np.isin(common_end, unit_end)
        code[np.arange(len(ids_b)) + many_a[group_b + 1]] = 2 * len(by.bytes_a) + len(by.bytes_b) * final + ids_b
        written = iter("".join(map(by.names.__getitem__, code.tolist())).split("\n"))
        self.groups = [next(written) if n else "" for n in self.n_links.tolist()]


@functools.lru_cache(1)
def _aligner(byte_json: bytes, piece_model: bytes) -> Aligner:
    """Two libraries' tables, some 100 MB; nothing of the texts is kept."""
    return Aligner(byte_json, piece_model)


def _summed(place: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Sums of times by place, in whole numbers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, times)
    return out


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of times of each."""
    keys, place = np.unique(keys, return_inverse=True)
    return keys, _summed(place, times, len(keys))


class _Text:
    """What has been seen of one text."""

    def __init__(self):
        self.n, self.sha, self.good, self.parts = np.zeros(3, np.int64), None, True, []

    def add(self, n: np.ndarray, groups: str, good: bool, keys: np.ndarray, times: np.ndarray) -> None:
        self.n += n
        self.good &= good
        if self.sha is None:
            self.sha = hashlib.sha256()
        else:
            self.sha.update(b";")
        self.sha.update(groups.encode())
        self.parts.append((keys, times))

    def row(self) -> tuple:
        if self.sha is None or not self.good:
            return (0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, times = self.parts[0] if len(self.parts) == 1 else _added(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        return tuple(self.n.tolist()), self.sha.hexdigest(), keys, times


def _step(by: Aligner, texts: list[str]) -> Iterator[tuple]:
    """n_a, n_b and n_links, groups, whether all is good, and keys and times, of texts that aren't empty."""
    split = [_CUT.split(t) for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array([u for s in split for u in s], pa.large_string()).dictionary_encode()
    units, place = by.units(coded.dictionary.to_pylist()), coded.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), n)
    ends = np.cumsum(n)
    begin = ends - n
    sums = [np.add.reduceat(x[place], begin).tolist() for x in (units.n_a, units.n_b, units.n_links)]
    good = np.logical_and.reduceat(units.good[place], begin).tolist()
    names, local = np.unique(units.keys, return_inverse=True)
    many = units.n_links[place]
    links = local[np.repeat(units.begin[place] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    pairs, times = np.unique(np.repeat(row, many) * max(1, len(names)) + links, return_counts=True)
    mine = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(names)))
    keys = names[pairs % max(1, len(names))] if len(names) else np.zeros(0, np.int64)
    where = place.tolist()
    for k, (a, b) in enumerate(zip(begin.tolist(), ends.tolist(), strict=True)):
        yield np.array([s[k] for s in sums]), ";".join([units.groups[i] for i in where[a:b]]), good[k], keys[mine[k] : mine[k + 1]], times[mine[k] : mine[k + 1]]


def _check(by: Aligner, text: str, got: _Text) -> None:
    """The counts and all links of a whole text, encoded in one piece, against those from its units."""
    (a,), (b,) = by.ids([text])
    end_a, end_b = np.cumsum(by.size_a[a]), np.cumsum(by.size_b[b])
    _, i, j = np.intersect1d(end_a, end_b, return_indices=True)
    keys, times = np.unique(np.array(b, np.int64)[j] << 32 | np.array(a, np.int64)[i], return_counts=True)
    n, _, own, many = got.row()
    if n != (len(a), len(b), len(i)) or not np.array_equal(keys, own) or not np.array_equal(times, many):
        raise AssertionError("ids differ from the libraries'")


LINKED = "doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, keys array<long>, times array<int>"


def linked(docs: DataFrame, byte_json: bytes, piece_model: bytes) -> DataFrame:
    """A row per row of docs (doc_id, text): numbers of tokens and links, the groups' digest, and how often each pair of ids is linked in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _aligner(byte_json, piece_model)
        for batch in batches:
            _, off = common.texts_of(batch.column(1))
            for lo, hi in common.steps(off, STEP):
                texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), "").to_pylist()
                seen = [_Text() for _ in texts]
                full = [k for k, t in enumerate(texts) if t]
                if hi - lo == 1 and full:
                    for part in cut(texts[0], STEP):
                        seen[0].add(*next(_step(by, [part])))
                elif full:
                    for k, found in zip(full, _step(by, [texts[k] for k in full]), strict=True):
                        seen[k].add(*found)
                for k in full:
                    if seen[k].good and off[lo + k + 1] - off[lo + k] <= STEP and zlib.crc32(texts[k].encode()) % WHOLE == 0:
                        _check(by, texts[k], seen[k])
                rows = [x.row() for x in seen]
                n = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)]
                places = pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(places, pa.array(np.concatenate([r[i] for r in rows]).astype(kind))) for i, kind in ((2, np.int64), (3, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *n, pa.array([r[1] for r in rows], pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_links", "groups_sha256", "keys", "times"])

    return docs.mapInArrow(run, LINKED)


def partial_counts(links: DataFrame) -> DataFrame:
    """(key, n): the counts of each partition's keys, in parts of HELD different keys or somewhat more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(times[0])], names=["key", "n"])

        for b in batches:
            keys.append(b.column(0).flatten().to_numpy())
            times.append(b.column(1).flatten().to_numpy().astype(np.int64))
            if sum(map(len, keys[1:])) >= HELD // 2:
                keys, times = ([x] for x in _added(np.concatenate(keys), np.concatenate(times)))
                if len(keys[0]) >= HELD:
                    yield out()
                    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        keys, times = ([x] for x in _added(np.concatenate(keys), np.concatenate(times)))
        if len(keys[0]):
            yield out()

    return links.select("keys", "times").mapInArrow(run, "key long, n long")


SHARD = "path string, rows long, least long, b array<int>, most array<long>"


def write_shards(partial: DataFrame, path: str, shards: int) -> DataFrame:
    """Sums partial counts (key, n) over ranges of keys; a row per shard written: its path, rows and smallest key, and the greatest count of each B id in it.

    A shard is one file: all keys in order, then their counts. A task that is
    repeated writes another file; only the one whose row arrives is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for b in batches:
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            k, n = k[at], np.add.reduceat(n, at)
            if keys and keys[-1][-1] == k[0]:  # a key goes on
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n.copy())
        if not keys:
            return
        k, n = np.concatenate(keys), np.concatenate(counts)
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{folder}/{name}") as f:
            f.write(k.tobytes())
            f.write(n.tobytes())
        b = k >> 32
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        own, most = pa.array([b[at].tolist()], pa.list_(pa.int32())), pa.array([np.maximum.reduceat(n, at).tolist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([len(k)]), pa.array([int(k[0])]), own, most], names=["path", "rows", "least", "b", "most"])

    return partial.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, SHARD)


class Shards:
    """Counts of keys in shards given as (path, rows, least)."""

    def __init__(self, shards: list[tuple[str, int, int]]):
        self.shards = sorted(shards, key=lambda s: s[2])
        self.least = np.array([s[2] for s in self.shards], np.int64)
        self.mapped, self.held = {}, {}

    def _open(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        path, rows, _ = self.shards[k]
        if k in self.mapped:
            return self.mapped[k]
        if k in self.held:
            return self.held[k]
        store, name = pafs.FileSystem.from_uri(path)
        if isinstance(store, pafs.LocalFileSystem):
            every = np.memmap(name, np.int64, "r", shape=(2 * rows,))
            self.mapped[k] = every[:rows], every[rows:]
            return self.mapped[k]
        with store.open_input_stream(name) as f:
            every = np.frombuffer(f.read(), np.int64)
        if len(self.held) >= SHARDS_HELD:
            del self.held[next(iter(self.held))]
        self.held[k] = every[:rows], every[rows:]
        return self.held[k]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of some sorted keys, 0 if it has none."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.least, keys, side="right") - 1
        for k in np.unique(shard[shard >= 0]).tolist():
            lo, hi = np.searchsorted(shard, [k, k + 1])
            own, counts = self._open(k)
            at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
            out[lo:hi] = np.where(own[at] == keys[lo:hi], counts[at], 0)
        return out


def align(docs: DataFrame, byte_json_path: str, piece_model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row, saved in the shared folder.

    One row per input row; null and repeated ids come back as they are, and
    every row counts. Null and empty texts, and those that hold U+2581 (which B
    reads as a space), have no tokens: zeros and an empty digest. Other columns
    are ignored; an empty table gives an empty result. Both vocabularies are
    read on the driver and travel with the tasks (some 3 MB), as does the
    greatest count of each B id (a number per id of B's vocabulary).
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    with open(byte_json_path, "rb") as f, open(piece_model_path, "rb") as g:
        byte_json, piece_model = f.read(), g.read()
    links = common.save(linked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), byte_json, piece_model), "linked")
    partial = common.save(partial_counts(links), "partial")
    folder = common.scratch_path(spark, "shards")
    manifest = common.save(write_shards(partial, folder, max(1, math.ceil(partial.count() / SHARD_ROWS))), "manifest")
    written = manifest.collect()  # a row per shard; its lists hold an entry per id of B's vocabulary, over all shards
    shards = [(r.path, r.rows, r.least) for r in written]
    best = np.zeros(1 + max((i for r in written for i in r.b), default=0), np.int64)
    for r in written:
        np.maximum.at(best, np.array(r.b), np.array(r.most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Shards(shards)
        for b in batches:
            keys, times = b.column(5), b.column(6).flatten().to_numpy().astype(np.int64)
            n = np.diff(keys.offsets.to_numpy())
            names, place = np.unique(keys.flatten().to_numpy(), return_inverse=True)
            counts = found.find(names)
            top = counts == best[names >> 32]
            row = np.repeat(np.arange(len(n)), n)
            sums = []
            for x in (top[place] * times, counts[place] * times):
                sums.append(_summed(row, x, len(n)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(3), pa.array(sums[0]), pa.array(sums[1]), b.column(4)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    out = common.save(links.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "aligned")
    common.drop(links, partial, manifest)
    common.drop_path(spark, folder)
    return out
