"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by vocabulary score:
the best pair (the leftmost among equals) is merged, its new neighbours join
the agenda, and symbols that are no vocabulary piece fall back to bytes. No
piece of such a vocabulary holds a word start after another character (this is
checked when a model is read), so a text splits exactly before its words, and
the distinct words of an Arrow batch are encoded together: one agenda per row
of a matrix, the best pair of every row merged at once. Words longer than that
have a heap as agenda. Nothing is kept from batch to batch.

Every distinct word of a batch and a hashed sample of its whole texts, as well
as all texts with spaces side by side, are compared with the ids of the
sentencepiece library; a difference fails the task.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common

SPACE = "▁"
#: Words of so many characters at most, their space included, have an agenda in a matrix; the widths of those matrices.
WIDTHS = (4, 8, 12, 16, 24, 32)
#: Words in a matrix.
ROWS = 1 << 14
#: One whole text in so many, by its hash, is compared with the library.
WHOLE = 64
NEVER = np.int32(2**31 - 1)


class PairTable:
    """Open-addressed hash table from pairs of symbols to what they merge into."""

    BITS = 20

    def __init__(self, pairs: dict[tuple[int, int], int]):
        while len(pairs) > 1 << (self.BITS - 1):
            self.BITS += 1
        left, right = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        keys, values = left << 32 | right, np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys, self.values = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges into, -1: nothing."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        have = np.take(self.keys, slot)
        out = np.where(have == keys, np.take(self.values, slot), np.int32(-1))
        more = np.flatnonzero((have != keys) & (have >= 0))
        slot = slot[more]
        while len(more):
            slot = slot + 1 & len(self.keys) - 1
            have = np.take(self.keys, slot)
            good = have == keys[more]
            out[more[good]] = np.take(self.values, slot[good])
            on = ~good & (have >= 0)
            more, slot = more[on], slot[on]
        return out


class PieceCodec:
    """Encoder over a sentencepiece model file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models without text normalisation and with a leading space are supported")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes, self.fallback, self.unknown = [0] * 256, spec.trainer_spec.byte_fallback, self.library.unk_id()
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.NORMAL:
                self.rank[p.piece], self.ids[p.piece] = -p.score, i
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type not in (kinds.UNKNOWN, kinds.CONTROL):
                raise ValueError("user-defined and unused pieces are not supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("a piece spans two words")
        # symbols: piece ids, then characters that are only parts of pieces, then all other characters
        self.size = len(spec.pieces)
        symbols = dict(self.ids)
        for c in sorted({c for p in self.rank for c in p}):
            symbols.setdefault(c, self.size + len(symbols) - len(self.ids))
        self.others = self.size + len(symbols) - len(self.ids)
        self.texts = {i: s for s, i in symbols.items()}
        self.first = np.arange(0x110000, dtype=np.int32) + np.int32(self.others)
        for s, i in symbols.items():
            if len(s) == 1:
                self.first[ord(s)] = i
        self.pairs = PairTable({(a, b): i for p, i in self.ids.items() for k in range(1, len(p)) if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None})
        self.cost = np.full(self.size + 1, NEVER, np.int32)  # the last is that of no merge
        places = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        for p, i in self.ids.items():
            self.cost[i] = places[self.rank[p]]

    def _matrix(self, sym: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Merges in place: sym (words, width) holds symbols, the first `length` of a row; returns the new lengths."""
        length, live = length.copy(), np.arange(len(sym))
        width = sym.shape[1]
        into = self.pairs.find(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(sym), width - 1)
        into[np.arange(1, width) >= length[:, None]] = -1
        s, n = sym, length
        column = np.arange(width)
        while len(live):
            cost = np.take(self.cost, into)
            at = cost.argmin(axis=1)
            row = np.arange(len(live))
            some = cost[row, at] != NEVER
            if not some.all():
                sym[live[~some]], length[live[~some]] = s[~some], n[~some]
                live, s, n, into, at = live[some], s[some], n[some], into[some], at[some]
                row = np.arange(len(live))
                if not len(live):
                    break
            new = into[row, at]
            # what stands behind the merged pair moves up
            source = np.minimum(column + (column > at[:, None]), width - 1)
            s = np.take_along_axis(s, source, axis=1)
            s[row, at] = new
            n = n - 1
            into = np.take_along_axis(into, np.minimum(column[: width - 1] + (column[: width - 1] >= at[:, None]), width - 2), axis=1)
            into[row, n - 1] = -1
            left = np.flatnonzero(at > 0)
            into[left, at[left] - 1] = self.pairs.find(s[left, at[left] - 1], new[left])
            right = np.flatnonzero(at < n - 1)
            into[right, at[right]] = self.pairs.find(new[right], s[right, at[right] + 1])
            into[row[at >= n - 1], at[at >= n - 1]] = -1
        return length

    def _heap(self, word: str) -> list[int]:
        """Symbols of one word, the agenda being a heap."""
        rank, sym = self.rank.get, list(word)
        after, before = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        agenda = [(c, i, len(a) + len(b)) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (c := rank(a + b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if not sym[i] or j < 0 or len(sym[i]) + len(sym[j]) != size:
                continue  # one of its symbols has been merged since
            sym[i] += sym[j]
            sym[j] = ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (c := rank(sym[a] + sym[b])) is not None:
                    heapq.heappush(agenda, (c, a, len(sym[a]) + len(sym[b])))
        return [self.ids[s] if s in self.ids else int(self.first[ord(s)]) for s in sym if s]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it, one after another, and where each one's begin (words + 1 values)."""
        count, parts = np.zeros(len(words), np.int64), []
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        lo = 0
        for width in WIDTHS:
            hi = int(np.searchsorted(lengths[order], width, side="right"))
            for a in range(lo, hi, ROWS):
                own = order[a : min(hi, a + ROWS)]
                points = np.frombuffer("".join([SPACE + words[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
                n = lengths[own]
                sym = np.zeros((len(own), width), np.int32)
                sym[np.arange(width) < n[:, None]] = np.take(self.first, points)
                n = self._matrix(sym, n)
                parts.append((own, n, sym[np.arange(width) < n[:, None]]))
            lo = hi
        for i in order[lo:].tolist():
            s = np.array(self._heap(SPACE + words[i]), np.int32)
            parts.append((np.array([i]), np.array([len(s)]), s))
        for own, n, _ in parts:
            count[own] = n
        begin = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(int(begin[-1]), np.int32)
        for own, n, s in parts:
            ids[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(len(s))] = s
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):  # characters that are no piece
            spread, many = ids.tolist(), np.ones(len(ids), np.int64)
            out = []
            for k in odd.tolist():
                s = self.texts.get(spread[k]) or chr(spread[k] - self.others)
                new = [self.bytes[x] for x in s.encode()] if self.fallback else [self.unknown]
                many[k] = len(new)
                out.append((k, new))
            at = np.cumsum(many) - many
            ids = np.repeat(ids, many)
            for k, new in out:
                ids[at[k] : at[k] + len(new)] = new
            begin = np.append(at, len(ids))[begin]
        return ids, begin

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and where each one's begin, checked against the library."""
        odd = [t[:1] == " " or "  " in t or SPACE in t for t in texts]
        # before a run of spaces, all but its first belong to the word
        split = [([u[1:] for u in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + t.replace(" ", SPACE))] if o else t.split(" ")) if t else [] for t, o in zip(texts, odd, strict=True)]
        coded = pa.array(split, pa.list_(pa.large_string()))
        number = coded.flatten().dictionary_encode()
        words, place = number.dictionary.to_pylist(), number.indices.to_numpy(zero_copy_only=False)
        del split
        ids, begin = self.words(words)
        self._check([w for w in words if w], *self._some(ids, begin, np.array([bool(w) for w in words], bool)))
        n = np.diff(begin)[place]
        source = np.repeat(begin[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        every = ids[source]
        at = np.concatenate([[0], np.cumsum(n)])[coded.offsets.to_numpy()]
        whole = [k for k, (t, o) in enumerate(zip(texts, odd, strict=True)) if o or t and zlib.crc32(t.encode()) % WHOLE == 0]
        if whole:
            chosen = np.zeros(len(texts), bool)
            chosen[whole] = True
            self._check([texts[k] for k in whole], *self._some(every, at, chosen))
        return every, at

    @staticmethod
    def _some(ids: np.ndarray, begin: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(begin)
        return ids[np.repeat(chosen, n)], n[chosen]

    def _check(self, texts: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        other = self.library.encode(texts, num_threads=1)
        flat = array.array("i")
        for x in other:
            flat.extend(x)
        if not np.array_equal(np.frombuffer(flat, np.int32), ids) or [len(x) for x in other] != n.tolist():
            raise AssertionError("ids differ from the library's")


@functools.lru_cache(1)
def _codec(model: bytes) -> PieceCodec:
    """A model's tables, some 30 MB; nothing of the texts is kept in it."""
    return PieceCodec(model)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: ids with an end id, their digest, and the digest of the library's decode(ids).

    Null and empty texts hold the end id only. A null or repeated id is
    returned as it came, one row per input row. Other columns are ignored. The
    model is read on the driver (half a megabyte) and travels with the task.
    with_ids adds the column ids (array of int).
    """
    common.bounded_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        end, decode, names = codec.library.eos_id(), codec.library.decode, [str(i) for i in range(codec.size)]
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            ids, begin = codec.encode(texts)
            del texts
            begin = begin.tolist()
            ids_sha, text_sha = [], []
            for a, b in zip(begin, begin[1:], strict=False):
                own = [*ids[a:b].tolist(), end]
                ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, own)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode(own).encode()).hexdigest())
            ends = np.array(begin) + np.arange(len(begin))
            cols = [batch.column(0), pa.array(np.diff(ends)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                every = np.full(int(ends[-1]), end, np.int32)
                mine = np.ones(len(every), bool)
                mine[ends[1:] - 1] = False
                every[mine] = ids
                cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(every)))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
