"""Runs: maximal periodic stretches of words, from the suffix tree of each text.

The tree of a text is held as its suffix array and the common prefix lengths of
neighbours; an inner node is a boundary between two neighbours, with the leaves
that it parts to its left and right (a node of many children is a chain of
such). As Stoye and Gusfield do, the leaf list of the smaller side is walked:
for a leaf i under a node of depth d, the leaf i + d or i - d on the other side
means that d words stand twice in a row and the third would differ (a branching
tandem repeat). Rotating each to the left as long as the words agree gives the
stretch; repeats with one end whose period is a multiple of a shorter one's
are the same stretch. A text of n words takes O(n log n) steps, whatever it
repeats, and many short texts are worked on side by side.

Texts don't touch each other: nothing is shuffled, and a text is the unit that
one task holds (some 150 bytes a word).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Leaves that are walked at once, and comparisons of one step of rotation.
LEAVES, COMPARED = 1 << 19, 1 << 19


class SuffixTree:
    """Suffix array, places in it, common prefix lengths and nodes of sequences `values`, sequence t from begin[t] to begin[t + 1]."""

    def __init__(self, values: np.ndarray, begin: np.ndarray):
        self.values, n = values, len(values)
        owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        self.first, self.stop = begin[:-1][owner], begin[1:][owner]
        key = owner * (int(values.max(initial=0)) + 1) + values
        sa = np.argsort(key, kind="stable")
        head = np.ones(n, bool)
        head[1:] = np.diff(key[sa]) != 0
        rank = np.empty(n, np.int32)
        rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        # ranks[s]: equal where the next 2**s words are; split[k]: the step that told slot k from the one before
        ranks, split, width = [rank], np.zeros(n, np.int8), 1
        while len(slots := np.flatnonzero(~(head & np.append(head[1:], True)))):
            at = sa[slots]
            ahead = at + width
            key = rank[at].astype(np.int64) * (n + 1) + np.where(ahead < self.stop[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            sa[slots] = at
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            fresh = slots[new & ~head[slots]]
            head[fresh], split[fresh] = True, len(ranks)
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            ranks.append(rank)
            width *= 2
        self.leaves, self.place = sa, rank
        self._depths(ranks, split)
        self._nodes()

    def _depths(self, ranks: list[np.ndarray], split: np.ndarray) -> None:
        """Boundaries between suffixes with a common prefix, and its length."""
        n = len(split)
        self.border = np.flatnonzero(split)
        a, b, level = self.leaves[self.border - 1], self.leaves[self.border], split[self.border].astype(np.int64)
        depth = np.int64(1) << np.maximum(level - 1, 0)
        for s in range(len(ranks) - 3, -1, -1):
            on = np.flatnonzero(level > s + 1)
            x, y = a[on] + depth[on], b[on] + depth[on]
            inside = (x < self.stop[a[on]]) & (y < self.stop[b[on]])
            same = inside & (ranks[s][np.minimum(x, n - 1)] == ranks[s][np.minimum(y, n - 1)])
            depth[on[same]] += 1 << s
        self.depth = depth

    def _nodes(self) -> None:
        """left and right: the leaves [left, border) and [border, right) of each boundary have no deeper node in common."""
        m = len(self.border)
        left, right = array("q", bytes(8 * m)), array("q", bytes(8 * m))
        open_, depths, starts = [], [], []  # boundaries that still extend to the right, in growing depth
        base, last, j = 0, -2, 0
        for lo in range(0, m, 1 << 16):
            for k, d in zip(self.border[lo : lo + (1 << 16)].tolist(), self.depth[lo : lo + (1 << 16)].tolist(), strict=True):
                if k != last + 1:
                    for i in open_:
                        right[i] = last + 1
                    open_, depths, starts, base = [], [], [], k - 1
                while depths and depths[-1] > d:
                    right[open_.pop()] = k
                    depths.pop()
                    starts.pop()
                left[j] = starts[-1] if starts else base
                open_.append(j)
                depths.append(d)
                starts.append(k)
                last = k
                j += 1
        for i in open_:
            right[i] = last + 1
        self.left, self.right = np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and period of every branching tandem repeat."""
        n, k = len(self.leaves), self.border
        to_left = k - self.left <= self.right - k
        size = np.minimum(k - self.left, self.right - k)
        lo = np.where(to_left, self.left, k)
        other, upto = np.where(to_left, k, self.left), np.where(to_left, self.right, k)
        ends, found, at = np.cumsum(size), [(np.zeros(0, np.int64),) * 2], 0
        while at < len(k):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAVES, side="right")))
            node = np.repeat(np.arange(at, to), size[at:to])
            leaf = self.leaves[lo[node] + np.arange(len(node)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to])]
            d = self.depth[node]
            for p, there in ((leaf, leaf + d), (leaf - d, leaf - d)):
                slot = self.place[np.clip(there, 0, n - 1)]
                hit = (there >= 0) & (there < n) & (slot >= other[node]) & (slot < upto[node])
                found.append((p[hit], d[hit]))
            at = to
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def rotations(self, p: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many times each repeat can be rotated to the left."""
        far, live, width = np.zeros(len(p), np.int64), np.arange(len(p)), 4
        while len(live):
            width = max(1, min(2 * width, COMPARED // len(live)))
            at = (p[live] - 1 - far[live])[:, None] - np.arange(width)
            same = (at >= self.first[p[live]][:, None]) & (self.values[np.maximum(at, 0)] == self.values[np.maximum(at, 0) + d[live][:, None]])
            whole = same.all(axis=1)
            far[live] += np.where(whole, width, same.argmin(axis=1))
            live = live[whole]
        return far

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and smallest period of every stretch of two periods or more that no neighbour extends, by start, then period."""
        p, d = self.repeats()
        end = p + 2 * d
        order = np.lexsort((d, end))
        p, d, end = p[order], d[order], end[order]
        out = [(np.zeros(0, np.int64),) * 3]
        while len(p):
            # of the repeats with one end, the shortest; its multiples inside the stretch are rotations of it
            first = np.ones(len(p), bool)
            first[1:] = end[1:] != end[:-1]
            start = p[first] - self.rotations(p[first], d[first])
            out.append((start, end[first] - start, d[first]))
            group = np.cumsum(first) - 1
            rest = ~first & ((d % d[first][group] != 0) | (p < start[group]))
            p, d, end = p[rest], d[rest], end[rest]
        start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((period, start))
        return start[order], length[order], period[order]


def runs_of_texts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, start (word number), length, period of each run of texts given as bytes and offsets, and the words of each text."""
    starts, ends, begin = common.word_spans(raw, off)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.diff(begin),)
    values = np.unique(common.word_hashes(raw, starts, ends), return_inverse=True)[1]
    start, length, period = SuffixTree(values, begin).runs()
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, length, period = start[long], length[long], period[long]
    text = np.searchsorted(begin, start, side="right") - 1
    return text, start - begin[text], length, period, np.diff(begin)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The words of a text joined by one space, without those that a run contains after its first period."""
    out, at = [], 0
    words = text.encode().split()
    for lo, hi in sorted((start + period, start + length) for start, length, period in runs):
        out += words[at : max(at, lo)]
        at = max(at, hi)
    return b" ".join(out + words[at:]).decode()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed (string) of each row.

    One row per input row; null and repeated ids come back as they are. A null,
    empty or blank text has no words, no runs and an empty collapsed text. An
    empty table gives an empty result; other columns are ignored. Words are
    told apart by 64-bit hashes.
    """
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = common.texts_of(b.column(1))
            for lo, hi in common.steps(off):
                text, start, length, period, n = runs_of_texts(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                begin = np.searchsorted(text, np.arange(hi - lo + 1))
                spans = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                left = [_collapsed(t or "", spans[i:j]) for t, i, j in zip(texts, begin.tolist(), begin[1:].tolist(), strict=False)]
                runs = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), runs.cast(RUNS), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def most_periods(runs: Column) -> Column:
    """Of an array of runs the one with the greatest length / period (ties: the first); null if there is none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
