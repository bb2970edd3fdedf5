"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters of the lower-cased
text; in scripts written without spaces each character is one. Items of fewer
than LEAST_WORDS words are looked for as they are, by the hash of all their
words. Of others, a seed is a pair of neighbouring words of an item that a document has as
neighbours or with one word between. An alignment that reaches SIMILARITY has
least_pairs() of an item's pairs at least: each other step from match to match
gains half a point per word of the item at most. One pass counts the pairs in
the corpus; of each item the most frequent ones are left out, fewer than that
number, and a document with as many of the rest as must then be there is
aligned with the item, word by word. So no alignment that reaches SIMILARITY is
missed. A document leaks an item if the best local alignment reaches it.

Test items of BLOCK_BYTES together travel to the tasks. Those of a larger
benchmark stay in tables: the corpus is passed over as often, its pairs
that may be an item's are filtered by a bit map and joined with the seeds, and
what has enough of them is joined with its texts and aligned. The rows are the
same either way.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common

#: Places between the two words of a seed, in a document.
GAPS = (1, 2)
#: Parts of items of fewer words can't be told from chance: they are looked for whole and unedited only.
LEAST_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
SIMILARITY = 0.5
#: Bytes of test items that travel to the tasks at most.
BLOCK_BYTES = 8 << 20
#: The bit map of pairs has 2 ** MAP_BITS bits, 4 MB; a benchmark of more pairs lets more others through.
MAP_BITS = 25
#: Seeds found, by item, that are looked at together; those of one text always are.
ENTRIES = 1 << 20

_WORD = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (97, 123), (65, 91), (128, 256)):
    _WORD[_lo:_hi] = np.arange(_lo, _hi)


#: Characters of scripts without spaces, by their first two bytes in UTF-8: Thai to Tibetan, Burmese, Khmer, CJK with its signs and kana, full widths, further ideographs.
_SOLO = np.zeros(1 << 16, bool)
for _lead, _lo, _hi in ((0xE0, 0xB8, 0xBF), (0xE1, 0x80, 0x82), (0xE1, 0x9E, 0x9F), (0xE3, 0x80, 0x83), (0xE3, 0x90, 0xBF), *((x, 0x80, 0xBF) for x in range(0xE4, 0xEA)), (0xEF, 0xA4, 0xAB), (0xEF, 0xBC, 0xBE), (0xF0, 0xA0, 0xBF)):
    _SOLO[_lead << 8 | _lo : (_lead << 8 | _hi) + 1] = True


def _spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """common.word_spans(), cut before and after each character of a script without spaces."""
    starts, ends, first = common.word_spans(raw, off)
    lead = np.flatnonzero(raw >= 0xE0)
    lead = lead[lead < len(raw) - 1]
    lead = lead[_SOLO[raw[lead].astype(np.int64) << 8 | raw[lead + 1]]]
    if not len(lead):
        return starts, ends, first
    after = lead + 3 + (raw[lead] >= 0xF0)
    # a word ends where its run does, or where the next one starts
    starts, run_ends = np.union1d(starts, np.concatenate([lead, after[~np.isin(after, ends)]])), ends
    ends = np.minimum(run_ends[np.searchsorted(run_ends, starts, side="right")], np.append(starts[1:], len(raw)))
    return starts, ends, np.searchsorted(starts, off)


def _hashed(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and each text's first word (texts + 1 values)."""
    raw = _WORD[raw]
    starts, ends, first = _spans(raw, off)
    return (common.word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def _pairs(words: np.ndarray, first: np.ndarray, gap: int) -> np.ndarray:
    """Hash of each word and the one `gap` places on; 0 where a text ends before."""
    out = np.zeros(len(words), np.uint64)
    if len(words) > gap:
        out[:-gap] = common.mix(words[:-gap] * np.uint64(common.WORD_BASE) + words[gap:])
        for k in range(1, gap + 1):
            cut = first[1:] - k
            out[cut[cut >= 0]] = 0
    return out


def _whole(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words at each place that has as many."""
    return common.window_hashes(words, size, common.WORD_BASE)


def least_pairs(size: int, similarity: float) -> int:
    """Pairs of an item of so many words that every alignment reaching `similarity` has as seeds; 0 or less: none need be there.

    A score is MATCH for the first match and, for each step to the next one, 2
    at most for a seed, which is one word of the item on, and else half the
    words of the item it goes on.
    """
    return -int(-((2 * MATCH * similarity - 1) * size - 3 - 1e-9) // 3)


class Lookup:
    """Places of 64-bit values in a sorted table, by the range that their upper bits have in it."""

    BITS = 20

    def __init__(self, table: np.ndarray):
        self.table = table
        self.start = np.searchsorted(table, np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)).astype(np.int32)
        self.count = np.diff(np.append(self.start, np.int32(len(table)))).astype(np.int32)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are in the table, in order, and where there."""
        upper = (values >> np.uint64(64 - self.BITS)).astype(np.int64)
        left = np.take(self.count, upper)
        at = np.flatnonzero(left)
        place, left, wanted = np.take(self.start, upper[at]).astype(np.int64), left[at], values[at]
        found = []
        while len(at):
            good = np.take(self.table, place) == wanted
            found.append((at[good], place[good]))
            more = ~good & (left > 1)
            at, place, left, wanted = at[more], place[more] + 1, left[more] - 1, wanted[more]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], place[order]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Batch, first row, words and first words, step by step."""
    for b in batches:
        raw, off = common.texts_of(pc.utf8_lower(b.column(column)))
        for lo, parts in itertools.groupby(common.text_steps(raw, off), key=lambda x: x[0]):
            hashed = [_hashed(part, at) for _, _, part, at, _ in parts]
            words = np.concatenate([w for w, _ in hashed])
            # of a long text, cut between words, only the words' hashes are put together
            yield b, lo, words, hashed[0][1] if len(hashed) == 1 else np.array([0, len(words)])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the passage's words [start, end) it covers."""

    def best(a, b):
        row, top, end, last = np.zeros(len(b) + 1, np.int64), 0, 0, 0
        step = np.arange(len(b) + 1) * -GAP
        for i, w in enumerate(a):
            new = np.maximum(row + GAP, 0)
            np.maximum(new[1:], row[:-1] + np.where(b == w, MATCH, MISMATCH), out=new[1:])
            row = np.maximum.accumulate(new + step) - step
            j = int(row.argmax())
            if row[j] > top:
                top, end, last = int(row[j]), j, i + 1
        return top, end, last

    score, end, last = best(item, passage)
    if not score:
        return 0, 0, 0
    back = best(item[:last][::-1], passage[:end][::-1])
    return score, end - back[1], end


class Items:
    """Test items as word hashes, and their pairs of neighbouring words."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float):
        ids = [i for i, _ in rows]
        raw, off = common.texts_of(pc.utf8_lower(pa.array([t for _, t in rows], pa.string())))
        words, first = _hashed(raw, off)
        grams = _pairs(words, first, 1)
        self.ids, self.words, self.grams, self.similarity = [], [], [], similarity
        short: dict[int, list[tuple[int, int]]] = {}
        for k, i in enumerate(ids):
            a, b = int(first[k]), int(first[k + 1])
            if i is not None and b - a >= LEAST_WORDS:
                self.ids.append(i)
                self.words.append(words[a:b])
                self.grams.append(grams[a : b - 1])
            elif i is not None and b > a:
                short.setdefault(b - a, []).append((int(_whole(words[a:b], b - a)[0]), i))
        #: Items under LEAST_WORDS words by their size: hashes in order, ids.
        self.short = {size: tuple(np.array(x, t) for x, t in zip(zip(*sorted(set(own)), strict=True), (np.uint64, np.int64), strict=True)) for size, own in short.items()}
        self.table = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.uint64)

    def seeds(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Seeds in order, with their items and places, and how many places each item needs; counts: of self.table in the corpus."""
        out, need = [], []
        for k, g in enumerate(self.grams):
            n = counts[np.searchsorted(self.table, g)]
            least = max(1, least_pairs(len(g) + 1, self.similarity))
            # half of what must be there may be left out, and the other half is asked for
            need.append(least - least // 2)
            kept = np.argsort(n, kind="stable")[: len(g) - least // 2]
            out += [(int(g[p]), k, int(p)) for p in kept[n[kept] > 0]]
        out.sort()
        gram, item, place = zip(*out, strict=True) if out else ((), (), ())
        return np.array(gram, np.uint64), np.array(item, np.int64), np.array(place, np.int64), np.array(need, np.int64)


def _count(docs: DataFrame, items: Items) -> np.ndarray:
    """Occurrences of each of the items' pairs in the corpus."""
    table = items.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, n = Lookup(table), np.zeros(len(table), np.int64)
        for _, _, words, first in _texts(batches, 1):
            for gap in GAPS:
                n += np.bincount(look.find(_pairs(words, first, gap))[1], minlength=len(table))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], names=["gram", "n"])

    out = np.zeros(len(table), np.int64)
    found = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # a row per pair of the items at most
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


def _parts(row: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows' hits, of about ENTRIES entries each."""
    cuts = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
    before = np.concatenate([[0], np.cumsum(many)])[cuts]
    lo = 0
    while lo < len(cuts) - 1:
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + ENTRIES, side="right")) - 1)
        yield int(cuts[lo]), int(cuts[hi])
        lo = hi


def _verbatim(words: np.ndarray, first: np.ndarray, size: int, look: Lookup, begin: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Text, item id and first word of the first whole copy of each item of `size` words."""
    if len(words) < size:
        return
    at, place = look.find(_whole(words, size))
    row = np.searchsorted(first, at, side="right") - 1
    inside = at + size <= first[row + 1]
    at, place, row = at[inside], place[inside], row[inside]
    _, one = np.unique(np.stack([row, place]), axis=1, return_index=True)
    for x in one.tolist():
        for item in ids[begin[place[x]] : begin[place[x] + 1]].tolist():
            yield int(row[x]), item, int(at[x] - first[row[x]])


LEAKS = "doc_id long, item_id long, score double, start_word int, end_word int"


def _best(words: np.ndarray, own: np.ndarray, starts: np.ndarray, places: np.ndarray, need: int, similarity: float) -> tuple[float, int, int]:
    """Best passage of a document for an item's words `own`, given its seeds by where copies would start."""
    best = (0.0, 0, 0)
    size, full = len(own), MATCH * len(own)
    # each word put in costs a point, so no more of them leave a score that reaches the similarity
    slack = int(full * (1 - similarity)) + 1
    every, starts = starts, np.unique(starts)
    for s in starts:
        if s >= 0 and np.array_equal(words[s : s + size], own):
            return 1.0, int(s), int(s) + size
    known, last = np.sort(own), starts[0] - 1
    for s in starts:
        if s <= last:
            continue
        # neighbouring starts are one passage
        last = starts[np.searchsorted(starts, s + slack, side="right") - 1]
        lo, hi = max(0, int(s) - slack), min(len(words), int(last) + size + slack)
        # seeds of one alignment start within slack of each other, and those of near ones all do within 2 * slack of s
        if len(np.unique(places[np.searchsorted(every, s - slack) : np.searchsorted(every, last + slack, side="right")])) < need:
            continue
        passage = words[lo:hi]
        shared = known[np.minimum(np.searchsorted(known, passage), size - 1)] == passage
        if MATCH * int(shared.sum()) < similarity * full:
            continue
        score, a, b = align(own, passage)
        if score / full > best[0]:
            best = score / full, lo + a, lo + b
    return best


def _leaks(docs: DataFrame, items: Items, similarity: float) -> DataFrame:
    gram, item, place, need = items.seeds(_count(docs, items))
    ids, texts, short = items.ids, items.words, items.short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begin = np.unique(gram, return_index=True)
        end = np.append(begin[1:], len(gram))
        look, brief = Lookup(table), {}
        for size, (own, own_ids) in short.items():
            hashes, where = np.unique(own, return_index=True)
            brief[size] = Lookup(hashes), np.append(where, len(own)), own_ids
        for b, row0, words, first in _texts(batches, 1):
            hits = [look.find(_pairs(words, first, gap)) for gap in GAPS]
            all_at, all_seed = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(all_at, kind="stable")
            all_at, all_seed = all_at[order], all_seed[order]
            all_row = np.searchsorted(first, all_at, side="right") - 1
            out = [(r + row0, i, 1.0, a, a + size) for size, x in brief.items() for r, i, a in _verbatim(words, first, size, *x)]
            for lo, hi in _parts(all_row, end[all_seed] - begin[all_seed]):
                at, seed = all_at[lo:hi], all_seed[lo:hi]
                # a row for each item of a seed
                many = end[seed] - begin[seed]
                entry = np.repeat(begin[seed] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                at, row = np.repeat(at, many), np.repeat(all_row[lo:hi], many)
                k, p = item[entry], place[entry]
                # items of which a document has too few places go
                order = np.lexsort((p, k, row))
                at, row, k, p = at[order], row[order], k[order], p[order]
                new = np.append(True, (row[1:] != row[:-1]) | (k[1:] != k[:-1]))
                group = np.cumsum(new) - 1
                distinct = np.bincount(group, weights=new | np.append(True, p[1:] != p[:-1])) >= need[k[new]]
                some = distinct[group]
                at, row, k, p = at[some], row[some], k[some], p[some]
                if not len(at):
                    continue
                start = at - p - first[row]
                order = np.lexsort((start, k, row))
                row, k, start, p = row[order], k[order], start[order], p[order]
                cuts = np.flatnonzero((row[1:] != row[:-1]) | (k[1:] != k[:-1])) + 1
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
                    r = int(row[x])
                    score, a, z = _best(words[first[r] : first[r + 1]], texts[int(k[x])], start[x:y], p[x:y], int(need[k[x]]), similarity)
                    if score >= similarity:
                        out.append((r + row0, ids[int(k[x])], score, a, z))
            if out:
                rows, item_id, score, a, z = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(item_id, pa.int64()), pa.array(score, pa.float64()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return docs.mapInArrow(run, LEAKS)


def _item_rows(bench: DataFrame, similarity: float) -> DataFrame:
    """(key, item_id, size, least, whole, words, grams) of the items that have words: whole hashes those under LEAST_WORDS, grams their pairs and a last 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, words, first in _texts(batches, 1):
            size = np.diff(first)
            own = [words[x:y] for x, y in itertools.pairwise(first)]
            whole = [int(_whole(w, len(w)).view(np.int64)[0]) if 0 < len(w) < LEAST_WORDS else 0 for w in own]
            least = [max(1, least_pairs(int(n), similarity)) for n in size]
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.view(np.int64))) for x in (words, _pairs(words, first, 1))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(size)), pa.array(size, pa.int32()), pa.array(least, pa.int32()), pa.array(whole, pa.int64()), *lists], names=["item_id", "size", "least", "whole", "words", "grams"])

    made = bench.mapInArrow(run, "item_id long, size int, least int, whole long, words array<long>, grams array<long>").where("size > 0")
    return common.save(made.withColumn("key", F.monotonically_increasing_id()), "items")


def _bit_map(grams: DataFrame) -> np.ndarray:
    """Bits of the upper MAP_BITS bits of each gram, 32 in a word; 2 ** (MAP_BITS - 5) rows come to the driver at most."""
    upper = F.shiftrightunsigned("gram", 64 - MAP_BITS)
    words = grams.select(F.shiftright(upper, 5).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - MAP_BITS}) % 32 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << max(0, MAP_BITS - 5), np.uint32)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _passing(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Where the values are whose bit is set."""
    upper = values >> np.uint64(64 - MAP_BITS)
    return np.flatnonzero((values != 0) & (bits[upper >> np.uint64(5)] >> (upper & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool))


def _leaks_joined(docs: DataFrame, bench: DataFrame, similarity: float) -> DataFrame:
    """_leaks() for items that are too many to travel. Documents are told apart by 128 bits of hash of their text, so equal ones are looked at once."""
    docs = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    items = _item_rows(bench, similarity)
    long, brief = items.where(F.col("size") >= LEAST_WORDS), items.where(F.col("size") < LEAST_WORDS)
    places = long.select("key", F.posexplode("grams").alias("place", "gram"), "size").where("place < size - 1").drop("size")
    sizes = [r[0] for r in brief.select("size").distinct().collect()]  # LEAST_WORDS - 1 at most
    bits = _bit_map(places)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words, first in _texts(batches, 0):
            pairs = np.concatenate([_pairs(words, first, gap) for gap in GAPS])
            gram, n = np.unique(pairs[_passing(pairs, bits)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    counts = docs.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # of each item the most frequent pairs are left out, as in Items.seeds()
    ranked = places.join(counts, "gram", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "gram"))).alias("g"))
    kept = F.filter(F.slice("g", F.lit(1), F.size("g") - F.floor(F.col("least") / 2).cast("int")), lambda x: x["n"] > 0)
    seeds = common.save(ranked.join(long.select("key", "least"), "key").select("key", (F.col("least") - F.floor(F.col("least") / 2)).cast("int").alias("need"), kept.alias("g")), "seeds")
    flat = seeds.select("key", "need", F.explode("g").alias("x")).select("key", "need", F.col("x.gram").alias("gram"), F.col("x.place").alias("place"), F.lit(0).alias("size"))
    wholes = brief.select("key", F.lit(1).alias("need"), F.col("whole").alias("gram"), F.lit(0).alias("place"), "size")
    wanted = flat.unionByName(wholes)
    seeded = _bit_map(wanted)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, words, first in _texts(batches, 2):
            found = [(0, x, _passing(x, seeded)) for x in (_pairs(words, first, gap) for gap in GAPS)]
            found += [(n, x, _passing(x, seeded)) for n, x in ((n, _whole(words, n)) for n in sizes)]
            for n, x, at in found:
                row = np.searchsorted(first, at, side="right") - 1
                inside = at + n <= first[row + 1]
                at, row = at[inside], row[inside]
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(x[at].view(np.int64)), pa.array(at - first[row], pa.int32()), pa.array(np.full(len(at), n), pa.int32())], names=["k1", "k2", "gram", "at", "size"])

    met = common.save(docs.select("k1", "k2", "text").mapInArrow(hits, "k1 long, k2 long, gram long, at int, size int").join(wanted, ["gram", "size"]).groupBy("k1", "k2", "key", "need", "place", "size").agg(F.min("at").alias("at")), "met")
    short = met.where("size > 0").join(brief.select("key", "item_id"), "key").select("k1", "k2", "item_id", F.lit(1.0).alias("score"), F.col("at").alias("start_word"), (F.col("at") + F.col("size")).alias("end_word"))
    candidates = met.where("size = 0").groupBy("k1", "k2", "key", "need").count().where("count >= need").select("k1", "k2", "key")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                _, _, words, first = next(_texts(iter([b.slice(i, 1)]), 0))
                own, gram, place = (np.array(b.column(c)[i].values) for c in (1, 2, 3))
                order = np.argsort(gram.view(np.uint64), kind="stable")
                gram, place = gram.view(np.uint64)[order], place[order]
                starts, seen = [], []
                for gap in GAPS:
                    pairs = _pairs(words, first, gap)
                    a, z = (np.searchsorted(gram, pairs, side=s) for s in ("left", "right"))
                    many = z - a
                    entry = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    seen.append(place[entry])
                    starts.append(np.repeat(np.arange(len(pairs)), many) - place[entry])
                starts, seen = np.concatenate(starts), np.concatenate(seen)
                order = np.argsort(starts, kind="stable")
                score, lo, hi = _best(words, own.view(np.uint64), starts[order], seen[order], b.column(4)[i].as_py(), similarity)
                if score >= similarity:
                    out.append((i, score, lo, hi))
            if out:
                rows, score, lo, hi = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in (5, 6, 7)), pa.array(score, pa.float64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["k1", "k2", "item_id", "score", "start_word", "end_word"])

    # a copy of each text, sent once for each item it is to be aligned with
    texts = docs.join(candidates.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    full = candidates.join(seeds, "key").join(long.select("key", "item_id", "words"), "key").join(texts, ["k1", "k2"])
    full = full.select("text", "words", F.col("g.gram").alias("gram"), F.col("g.place").alias("place"), "need", "k1", "k2", "item_id")
    found = full.mapInArrow(aligned, "k1 long, k2 long, item_id long, score double, start_word int, end_word int").unionByName(short)
    return docs.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "item_id", "score", "start_word", "end_word")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item it leaks: score (1: a full copy) and the best passage's words [start_word, end_word).

    Null texts hold nothing; items that are null, have a null id or no
    word are not looked for, those of under LEAST_WORDS words only whole and
    unedited. With a similarity below 0.5 a copy may lack every seed. Rows with
    null or repeated ids are looked at like others, an item's repeated row
    counts once. Other columns are ignored.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BLOCK_BYTES:
        return _leaks_joined(docs, bench, similarity)
    rows = bench.orderBy("item_id", "text").collect()  # BLOCK_BYTES at most
    return _leaks(docs, Items([(r.item_id, r.text) for r in rows], similarity), similarity)


#: Words of a passage for which clean() drops a document; a shorter one must be half of the document.
CLEAN_WORDS = 8


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", least: int = CLEAN_WORDS) -> DataFrame:
    """The rows of docs, all columns, that leak no item; rows with a null id stay.

    A passage of fewer than `least` words (a whole item as short as that: a name,
    a "yes") only counts where it makes up half of the row's words or more: such
    words stand in clean texts too. leaks() reports them all.
    """
    found = leaks(docs, benchmark, similarity, id_col, text_col).select(F.col("doc_id").alias("weft_id"), (F.col("end_word") - F.col("start_word")).alias("weft_n"))
    found = found.groupBy("weft_id").agg(F.max("weft_n").alias("weft_n"))
    found = common.small(common.save(found, "leaks"), 24)
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    leaked = (F.col(id_col).cast("long") == F.col("weft_id")) & ((F.col("weft_n") >= least) | (2 * F.col("weft_n") >= n_words))
    return docs.join(found, leaked, "left_anti")
