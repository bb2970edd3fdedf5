"""Bit predictions of a context-mixing language model, whole arrays at a time.

A text is its lower-cased words joined by spaces, then an end byte; a byte is a
path of bits in a Huffman tree of the training corpus, one tree for each byte
before. Each predictor hashes a
context (the last bytes, or the word so far) with the tree node into a table of
counts of zeros and ones, whose slots grow with the training corpus. The predictions are mixed in the
logistic domain with gated weights, which are learnt
online while the counts are gathered (predict, then count); the gate is how
sure the word predictor is. Scoring refines the
mix for each text adaptively: scale and shift of the log odds start at 1 and 0
and are fitted, after each of a text's blocks, to all its blocks so far; a
block is predicted from earlier ones only. Blocks grow with the distance from
the start, so a long text has few of them.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa

from weftspark.llm import common

#: Bytes hashed by each predictor (0: the letters of the word so far).
ORDERS = (2, 3, 5, 0)
#: Slots of each predictor's table, as a power of two, for a corpus of 2**SCALE bytes; a corpus of four times as many bytes has tables of twice as many slots.
BITS, SCALE = (18, 20, 22, 22), 30
#: A table has so many slots at least, as a power of two.
LEAST_BITS = 12
#: Gate of a bit: the size of the word predictor's log odds.
SURE = (0.03, 0.78, 2.03, 3.78)
GATES = len(SURE) + 1
#: Log odds are kept in steps of 1 / STEP, and are MOST at most.
STEP, MOST = 16, 127 / 16
LEARN = 0.002
#: Bits of one gate that update its weights together.
BATCH = 1024
END = 10
#: Prior of the refinement, in bits seen.
HOLD = np.array([400.0, 100.0])
#: Bytes of stream whose bits are worked out together, small enough for a cache, and bytes refined together. A slot is counted once a byte at most, so CHUNK steps never overflow a count that is below 2**15.
CHUNK, REFINED = 1 << 14, 1 << 18
#: Bytes whose bits are scored together; what is scored doesn't depend on it.
SCORED = 1 << 14
#: Bytes of a text's first block; each later one is as long as all before it.
FIRST = 96


def sizes(train_bytes: int) -> tuple[int, ...]:
    """Slots of the predictors' tables, as powers of two, for a corpus of so many bytes: they grow with its square root, as the distinct contexts of texts do about."""
    more = math.ceil((math.log2(max(1, train_bytes)) - SCALE) / 2)
    return tuple(max(LEAST_BITS, b + more) for b in BITS)


class Code:
    """Huffman codes of byte values, one for each value before: nodes and bits of each path, by pair (256 * before + value). A code's nodes are numbered by how often they are passed."""

    def __init__(self, counts: np.ndarray):
        nodes, bits, first = [], [], [0]
        for own in counts.reshape(256, 256).tolist():
            heap = [(c + 1, v) for v, c in enumerate(own)]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            for node in range(256, 511):
                (a, x), (b, y) = heapq.heappop(heap), heap[0]
                parent[x], parent[y] = (node, 0), (node, 1)
                heapq.heapreplace(heap, (a + b, node))
            paths: dict[int, list[tuple[int, int]]] = {510: []}
            for node in range(509, -1, -1):  # later nodes are heavier, and no child is later than its parent
                up, bit = parent[node]
                paths[node] = [*paths[up], (510 - up, bit)]
            for v in range(256):
                nodes += [n for n, _ in paths[v]]
                bits += [b for _, b in paths[v]]
                first.append(len(nodes))
        self.nodes, self.bits = np.array(nodes, np.int64), np.array(bits, np.uint8)
        self.first, self.length = np.array(first[:-1]), np.diff(first)
        #: Node and bit in one small number, twice the node and the bit.
        self.steps = (2 * self.nodes + self.bits).astype(np.uint16)


def _powers32(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**32."""
    out = []
    for base in (0x2F0B4C47, pow(0x2F0B4C47, -1, 1 << 32)):
        p = np.full(n, base, np.uint32)
        p[:1] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out[0], out[1]


#: Bytes of stream whose powers are kept from step to step.
POWERS = 1 << 19


@functools.lru_cache(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers32(POWERS)


class Stream:
    """Normalised bytes of some texts: words in lower case, a separator after each, an end byte as a text's last separator.

    ends: places of the separators; first: each text's first separator by
    number (texts + 1 values), so first[i + 1] - first[i] is its words, or 1.
    whole: the texts end here; a text that goes on has no end byte yet.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, whole: bool = True):
        n = len(off) - 1
        data = raw.tobytes()
        joined = b"\n".join([data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)] + [b""])
        low = common.lower_ascii(np.frombuffer(joined, np.uint8))
        inside = ~common.is_space(low)
        stop = off[1:] + np.arange(n)  # the line end put after each text
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        low = np.where(inside, low, np.uint8(32))
        wordless = np.add.reduceat(inside, off[:-1] + np.arange(n), dtype=np.int64) == 0 if n else np.zeros(0, bool)
        keep[stop[wordless]] = True
        self.data = low[keep]
        self.off = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, off[:-1] + np.arange(n), dtype=np.int64))]) if n else np.zeros(1, np.int64)
        if whole:
            self.data[self.off[1:] - 1] = END
        self.ends = np.flatnonzero(self.data <= 32)
        # bytes below 33 that are no spaces are parts of words
        self.ends = self.ends[(self.data[self.ends] == 32) | (self.data[self.ends] == END)]
        self.first = np.searchsorted(self.ends, self.off)
        self.words = np.diff(self.first) - wordless
        self.starts = np.empty_like(self.ends)
        self.starts[:1], self.starts[1:] = 0, self.ends[:-1] + 1

    def pairs(self) -> np.ndarray:
        """256 * the byte before + the byte, a space standing before a text."""
        out = self.data.astype(np.int64)
        out[1:] += self.data[:-1].astype(np.int64) << 8
        at = self.off[:-1]
        out[at] = self.data[at] + np.int64(32 << 8)
        return out

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word."""
        some = self.ends > self.starts
        return self.starts[some], self.ends[some]

    def word_array(self, skip: int = 0) -> pa.Array:
        """The words from byte `skip` on."""
        starts, ends = self.spans()
        size = (ends - starts)[starts >= skip]
        keep = np.ones(len(self.data), bool)
        keep[self.ends], keep[:skip] = False, False
        off = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=off[1:])
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(self.data[keep]))

    def contexts(self, bits: tuple[int, ...]) -> list[np.ndarray]:
        """A slot per byte in each predictor's table of 2**bits, a text's start having end bytes before it; and last the pairs."""
        out, n = {}, len(self.data)
        h, last = np.zeros(n, np.uint32), self.data.astype(np.uint32) + np.uint32(1)
        for k in range(1, max(ORDERS) + 1):
            h *= np.uint32(0x2F0B4C47)
            h[k:] += last[:-k] if k < n else last[:0]
            # what reaches over a text's start is taken back and an end byte put there
            for i in range(k):
                at = self.off[:-1] + i
                at = at[at < self.off[1:]]
                back = at[at >= k]
                h[back] -= last[back - k]
                h[at] += np.uint32(END + 1)
            if k in ORDERS:
                out[k] = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * k)
        p, q = _kept_powers() if n < POWERS else _powers32(n + 1)
        sums = np.zeros(n + 1, np.uint32)
        np.cumsum(last * p[:n], out=sums[1:], dtype=np.uint32)
        size = self.ends - self.starts + 1
        h = (sums[:n] - np.repeat(sums[self.starts], size)) * np.repeat(q[self.starts], size)
        out[0] = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        return [*((out[k] >> np.uint32(32 - b)).astype(np.int64) for k, b in zip(ORDERS, bits, strict=True)), self.pairs()]

    def after(self, words: int) -> int:
        """Bytes up to and with the separator of so many words."""
        return int(self.ends[words - 1]) + 1 if words else 0

    def chunks(self, skip: int = 0, size: int = CHUNK) -> range:
        return range(skip, len(self.data), size)


#: Words that two parts of a long text share: with their separators more bytes than any predictor looks back.
SHARED = max(ORDERS)


def part_of(raw: np.ndarray, off: np.ndarray, before: int, whole: bool) -> tuple[Stream, int]:
    """The stream of a part of a text, the first SHARED words of which were in the part before (if before > 0), and the bytes to skip.

    Slots and bits of the bytes after these are those of the whole text.
    """
    stream = Stream(raw, off, whole)
    return stream, stream.after(SHARED) if before else 0


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """values[places], of places that are known to be inside: clipping is cheaper than the test for one that isn't."""
    return values.take(places, mode="clip")


def bits_of(stream: Stream, contexts: list[np.ndarray], code: Code, lo: int, size: int = CHUNK):
    """Bits of the chunk of `size` bytes from byte lo: slots of each predictor, the bits, and how many each byte has.

    A slot is the context's, its lower bits changed by the node's number: all
    nodes of a context lie together, the often passed ones closest.
    """
    pair = contexts[-1][lo : lo + size]
    length, first = _at(code.length, pair), _at(code.first, pair)
    ends = np.cumsum(length)
    # each bit's byte, as repeat() gives it, but without a branch for each byte
    byte = np.zeros(ends[-1], np.int64)
    byte[ends[:-1]] = 1
    np.cumsum(byte, out=byte)
    # places in the paths: one on from bit to bit, from a byte's last to the next one's first by what lies between
    path = np.ones(ends[-1], np.int64)
    path[0] = first[0]
    path[ends[:-1]] = first[1:] - first[:-1] - length[:-1] + 1
    np.cumsum(path, out=path)
    step = _at(code.steps, path)
    node = (step >> np.uint16(1)).astype(np.int64)
    slots = []
    for c in contexts[:-1]:
        s = _at(c[lo : lo + size], byte)
        s ^= node
        slots.append(s)
    return slots, (step & np.uint16(1)).astype(np.uint8), length


def odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of a one in steps, from counts of zeros and ones (slots, 2)."""
    c = counts.astype(np.float32) + np.float32(0.4)
    return np.clip(np.rint(np.log(c[:, 1] / c[:, 0]) * STEP), -127, 127).astype(np.int8)


#: Level of sureness of log odds in steps, by the byte that holds them.
_LEVEL = np.searchsorted(SURE, np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(np.float64)) / STEP).astype(np.uint8)


_GATE = _LEVEL.astype(np.uint16) * np.uint16(256)


def squash(z: np.ndarray) -> np.ndarray:
    """The probability that log odds stand for; what leaves the range of exp() is 0."""
    with np.errstate(over="ignore"):
        return _share(z)


def _share(z: np.ndarray) -> np.ndarray:
    p = np.negative(z)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


@functools.lru_cache(1)
def _logs() -> np.ndarray:
    """Logarithms of positive 32-bit floats, at most MOST in size, by sign, exponent and the next ten bits of the rounded number."""
    with np.errstate(all="ignore"):
        x = np.log((np.arange(1 << 18, dtype=np.uint32) << np.uint32(13)).view(np.float32))
    return np.clip(np.nan_to_num(x, nan=MOST, neginf=-MOST), -MOST, MOST)


def _read(table: np.ndarray, slots: np.ndarray, out: np.ndarray) -> bool:
    """Writes the log odds of a learner's slots to out; whether one of them is full."""
    halves = _at(table, slots).view(np.uint16)
    full = halves.max() >= 1 << 15
    halves = halves.astype(np.float32)
    halves += np.float32(0.4)
    np.divide(halves[1::2], halves[::2], out=out)
    place = (out.view(np.int32) + np.int32(1 << 12)).astype(np.intp)
    place >>= 13
    np.take(_logs(), place, out=out, mode="clip")
    return full


class Learner:
    """Counts and weights gathered from training texts, one step of texts after another.

    A slot is a 32-bit number, its upper half the ones counted, its lower half
    the zeros; where either has reached 2**15, both are halved, which keeps the
    odds.
    """

    def __init__(self, code: Code, bits: tuple[int, ...]):
        self.code, self.bits, self.seen = code, bits, 0
        self.tables = [np.zeros(1 << b, np.uint32) for b in bits]
        self.weights = np.full((GATES, len(ORDERS)), 0.3)
        self.room = np.empty((len(ORDERS), 0), np.float32)

    def counts(self, k: int) -> np.ndarray:
        """(slots, 2) zeros and ones of predictor k."""
        return self.tables[k].view(np.uint16).reshape(-1, 2)

    def learn(self, stream: Stream, skip: int = 0) -> None:
        contexts = stream.contexts(self.bits)
        for lo in stream.chunks(skip):
            slots, bit, _ = bits_of(stream, contexts, self.code, lo)
            one, n = bit.astype(np.uint32) * np.uint32(0xFFFF) + np.uint32(1), len(bit)
            if self.room.shape[1] <= n:  # kept from chunk to chunk
                self.room = np.empty((len(ORDERS), n + n // 4 + 1), np.float32)
                self.dealt = np.empty((len(ORDERS), self.room.shape[1] // BATCH + GATES, BATCH), np.float32), np.empty((GATES, BATCH), np.float32)
            # a table is counted in as soon as it was read, while its slots are in the cache
            for t, s, z in zip(self.tables, slots, self.room[:, :n], strict=False):
                if _read(t, s, z):
                    full = np.unique(s[(_at(t, s) & np.uint32(0x80008000)) > 0])
                    t[full] = (t[full] >> np.uint32(1)) & np.uint32(0x7FFF7FFF)
                np.add.at(t, s, one)
            self._adapt(n, bit)
            self.seen += n

    def _adapt(self, n: int, bit: np.ndarray) -> None:
        """Weights learn from every bit, as predicted by the log odds in the room's first rows."""
        x, (dealt, scratch) = self.room[:, : n + 1], self.dealt
        size, gate = np.abs(x[-1, :n]), np.zeros(n, np.uint8)
        for v in SURE:
            gate += size > v
        # the log odds of the bit that didn't come: its probability is the error
        sign = bit.astype(np.float32)
        sign *= -2
        sign += 1
        x[:, :n] *= sign
        x[:, n] = 0
        # a gate's weights depend on its own bits alone, in order: the first BATCH bits of each gate go together, then the next ones
        own = gate == np.arange(GATES, dtype=np.uint8)[:, None]
        count = [np.count_nonzero(r) for r in own]
        rank = sorted(range(GATES), key=lambda g: -count[g])
        gates = [sum(count[g] > lo for g in rank) for lo in range(0, max(count), BATCH)]
        order, to = np.flatnonzero(own), np.cumsum(count).tolist()
        place, at = np.full((sum(gates), BATCH), n), 0  # where a batch is short, log odds of 0, which change nothing
        for i, many in enumerate(gates):
            for g in rank[:many]:
                lo = to[g] - count[g] + i * BATCH
                part = order[lo : min(to[g], lo + BATCH)]
                np.subtract(part, g * n, out=place[at, : len(part)])
                at += 1
        for z, out in zip(x, dealt, strict=True):
            np.take(z, place, out=out[:at], mode="clip")
        less, rate, at = (-self.weights[rank]).astype(np.float32), np.float32(LEARN), 0
        with np.errstate(over="ignore"):
            for many in gates:
                own, p, w = dealt[:, at : at + many].transpose(1, 0, 2), scratch[:many], less[:many]
                np.matmul(w[:, None], own, out=p[:, None])
                np.exp(p, out=p)
                p += 1
                np.divide(rate, p, out=p)
                w += np.matmul(own, p[:, :, None])[:, :, 0]
                at += many
        self.weights[rank] = -less


class Scorer:
    """Log probabilities of texts under gathered tables (one per predictor) and weights."""

    def __init__(self, code: Code, tables: list[np.ndarray], weights: np.ndarray):
        self.code, self.tables, self.bits, self.weights = code, tables, tuple(len(t).bit_length() - 1 for t in tables), np.ascontiguousarray((weights / STEP).T, np.float32)
        # the word predictor's share of the mix, by the byte of its log odds
        steps = np.arange(256, dtype=np.uint8).view(np.int8)
        self.word = self.weights[-1][_LEVEL] * steps.astype(np.float32)
        # the others' shares, by gate and byte
        self.shares = [(w[:, None] * steps.astype(np.float32)).ravel() for w in self.weights[:-1]]

    def mixed(self, stream: Stream, skip: int = 0):
        """Log odds of the mix, bits and bits of each byte, chunk by chunk."""
        contexts = stream.contexts(self.bits)
        for lo in stream.chunks(skip, SCORED):
            slots, bit, length = bits_of(stream, contexts, self.code, lo, SCORED)
            x = _at(self.tables[-1], slots[-1]).view(np.uint8)
            gate, z = _at(_GATE, x), _at(self.word, x)
            for w, t, s in zip(self.shares, self.tables[:-1], slots[:-1], strict=True):
                z += _at(w, gate + _at(t, s).view(np.uint8))
            yield z, bit, length

    def score(self, stream: Stream) -> np.ndarray:
        """Natural log probability of each text."""
        chunks = list(self.mixed(stream))
        if not chunks:
            return np.zeros(0)
        z, bit, length = (np.concatenate(x) for x in zip(*chunks, strict=True))
        before, out = np.concatenate([[0], np.cumsum(length)]), []
        for a, b in common.steps(stream.off, REFINED):
            lo = before[stream.off[a]]
            out.append(self._refined(z[lo : before[stream.off[b]]], bit[lo : before[stream.off[b]]], before[stream.off[a] : stream.off[b] + 1] - lo, np.diff(stream.off[a : b + 1]), stream.off[a:b] - stream.off[a]))
        return np.concatenate(out)

    @staticmethod
    def _refined(z, bit, before, length, start) -> np.ndarray:
        """Natural log probability of each text, from its bits' log odds."""
        n = len(length)
        total, scale, shift = np.zeros(n), np.ones(n), np.zeros(n)
        h = np.zeros((3, n))
        h[0], h[2] = HOLD
        live, done, size = np.argsort(-length, kind="stable"), 0, FIRST
        while len(live):
            # bits of the next block of every text that still has one
            lo, hi = before[start[live] + done], before[start[live] + np.minimum(length[live], done + size)]
            count = hi - lo
            first = np.cumsum(count) - count
            parts = list(zip(lo.tolist(), hi.tolist(), strict=True))
            x, y = np.concatenate([z[a:b] for a, b in parts]), np.concatenate([bit[a:b] for a, b in parts])
            t = x * np.repeat(scale[live].astype(np.float32), count)
            t += np.repeat(shift[live].astype(np.float32), count)
            np.clip(t, -15, 15, out=t)
            p = squash(t)
            err = y - p
            # log of the probability of the bit that came
            total[live] += np.add.reduceat(np.log(1 - np.abs(err)).astype(np.float64), first)
            done += size
            size = done
            # only texts that have another block, the longest ones, are fitted again
            live = live[length[live] > done]
            if len(live):
                if len(live) < len(first):
                    x, p, err, first = x[: first[len(live)]], p[: first[len(live)]], err[: first[len(live)]], first[: len(live)]
                var = p * (1 - p)
                vx = var * x
                for i, v in enumerate((vx * x, vx, var)):
                    h[i, live] += np.add.reduceat(v, first)
                gx, g1 = np.add.reduceat(err * x, first), np.add.reduceat(err, first)
                a, c, d = h[:, live]
                det = a * d - c * c
                scale[live] = np.clip(scale[live] + (d * gx - c * g1) / det, 0.2, 5)
                shift[live] = np.clip(shift[live] + (a * g1 - c * gx) / det, -3, 3)
        return total


class Refinement:
    """The score of one long text that comes in parts: the same blocks, of which sums are kept instead of bits."""

    def __init__(self):
        self.total, self.scale, self.shift = 0.0, 1.0, 0.0
        self.h = np.array([HOLD[0], 0.0, HOLD[1]])
        self.sums, self.seen, self.stop = np.zeros(5), 0, FIRST

    def add(self, z: np.ndarray, bit: np.ndarray, length: np.ndarray) -> None:
        """Bits of the next bytes; length: bits of each byte."""
        before, at = np.concatenate([[0], np.cumsum(length)]), 0
        while at < len(length):
            if self.seen == self.stop:
                self._next()
            to = min(len(length), at + self.stop - self.seen)
            x, y = z[before[at] : before[to]], bit[before[at] : before[to]]
            t = np.clip(x * np.float32(self.scale) + np.float32(self.shift), -15, 15)
            p = squash(t)
            err, var = y - p, p * (1 - p)
            self.total += float(np.log(1 - np.abs(err)).astype(np.float64).sum())
            self.sums += [float((var * x * x).sum(dtype=np.float64)), float((var * x).sum(dtype=np.float64)), float(var.sum(dtype=np.float64)), float((err * x).sum(dtype=np.float64)), float(err.sum(dtype=np.float64))]
            self.seen, at = self.seen + to - at, to

    def _next(self) -> None:
        """A block is over and another begins: the mix is fitted to all so far."""
        self.h += self.sums[:3]
        (a, c, d), (gx, g1) = self.h, self.sums[3:]
        det = a * d - c * c
        self.scale = float(np.clip(self.scale + (d * gx - c * g1) / det, 0.2, 5))
        self.shift = float(np.clip(self.shift + (a * g1 - c * gx) / det, -3, 3))
        self.sums, self.stop = np.zeros(5), 2 * self.stop
