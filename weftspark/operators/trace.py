"""Analytics of memory-access traces: buffers, coalescing, row buffers, roll-ups.

A trace is a table (tensor, port, level, buffer, seq, addr, requestor, kind),
seq being the program order and kind R or U. What depends on order alone is a
window function; what carries state (replacement, coalescing) streams through
Python in order: replacement partition by partition, with no more memory than
the modelled buffer has lines, coalescing in stretches of a buffer's accesses,
between which states pass.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark import storage
from weftspark.operators.loops import buffer_index

BUFFER = ["tensor", "port", "level", "buffer"]


def line(addr: Column, granularity: int) -> Column:
    """First address of the line that holds addr."""
    return addr - addr % granularity


def counts(trace: DataFrame, *keys: str) -> DataFrame:
    """(keys, reads, updates)."""
    return trace.groupBy(*keys).agg(F.sum((F.col("kind") == "R").cast("bigint")).alias("reads"), F.sum((F.col("kind") == "U").cast("bigint")).alias("updates"))


def with_buffers(trace: DataFrame, partitions: int, buffers: int) -> DataFrame:
    """trace with the buffer of each requestor's spatial partition."""
    return trace.withColumn("buffer", buffer_index(F.col("requestor"), partitions, buffers))


def _streamed(trace: DataFrame, keys: list[str], schema: str, start: Callable[[], object], each: Callable) -> DataFrame:
    """Streams each buffer's accesses in order through `each(state, row)`, a generator; state is new for each buffer and closed with row None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    if state is not None:
                        out += [(*key, *x) for x in each(state, None)]
                    key, state = now, start()
                out += [(*key, *x) for x in each(state, row)]
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None and (out := [(*key, *x) for x in each(state, None)]):
            yield pd.DataFrame(out, columns=names)

    return trace.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInPandas(run, schema)


#: Places of seq that a task takes through a state machine at a time; places before them from which its state is guessed.
STRETCH, BEFORE = 1 << 17, 1 << 10

_RECENT = "at array<bigint>, served array<array<int>>, updated array<array<int>>"


def _rides(recent: deque, at: int, requestor: int, update: bool) -> bool:
    """Takes one access of a line to the entries [line, served, updated] of the recent ones: whether it rides on one."""
    later, hit = False, None
    for entry in reversed(recent):
        if entry[0] == at:
            hit = entry
            break
        later = later or requestor in entry[1]
    rides = False
    if hit is not None:
        if not update:
            rides = not later and requestor not in hit[1]
            if rides:
                hit[1].add(requestor)
        else:
            hit[1].add(requestor)
            rides = requestor not in hit[2]
            hit[2].add(requestor)
    if not rides:
        recent.append((at, {requestor}, {requestor} if update else set()))
    return rides


def coalesce(trace: DataFrame, granularity: int = 1, window: int = 32, stretch: int = STRETCH, before: int = BEFORE) -> DataFrame:
    """trace's rows (BUFFER, seq, addr, requestor, kind) with coalesced: whether an access rides on a recent one.

    An access finds the latest of the last `window` accesses of its own that
    went to the same line. A read rides on it unless its requestor has been
    served by it or by a later one; an update unless its requestor has already
    updated it.

    A buffer's accesses are dealt out in stretches of so many places of seq. A
    stretch begins with the state that the last places before it lead to from
    nothing, which mostly is the right one; where it isn't the state that the
    stretch before ends with, the stretch is done again from that, until all
    states meet. Only states pass between stretches.
    """
    keys = [*BUFFER, "_b"]
    cut = trace.select(*BUFFER, "seq", "addr", "requestor", "kind").withColumn("_b", F.floor(F.col("seq") / stretch).cast("bigint"))
    rows = storage.save_bucketed(cut, keys, "stretches")

    def accesses(pdf: pd.DataFrame) -> Iterator[tuple]:
        pdf = pdf.sort_values("seq", kind="stable")
        return zip((pdf.addr - pdf.addr % granularity).tolist(), pdf.requestor.tolist(), (pdf.kind == "U").tolist(), strict=True)

    def entries(starts: pd.DataFrame) -> deque:
        held = deque(maxlen=window)
        for x in starts.itertuples(index=False):
            held.extend((int(at), set(map(int, s)), set(map(int, u))) for at, s, u in zip(x.at, x.served, x.updated, strict=True))
        return held

    def state(key: tuple, held: deque) -> pd.DataFrame:
        at, served, updated = ([x[0] for x in held], [sorted(x[1]) for x in held], [sorted(x[2]) for x in held])
        return pd.DataFrame([(*key, at, served, updated)], columns=[*keys, "at", "served", "updated"])

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = deque(maxlen=window)
        for x in accesses(pdf):
            _rides(held, *x)
        return state(key, held)

    def through(key: tuple, pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        held = entries(starts)
        if not len(pdf):
            return state(key, held).iloc[:0]
        for x in accesses(pdf):
            _rides(held, *x)
        return state(key, held)

    def marked(key: tuple, pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        held, pdf = entries(starts), pdf.sort_values("seq", kind="stable")
        return pdf[[*BUFFER, "seq", "addr", "requestor", "kind"]].assign(coalesced=[_rides(held, *x) for x in accesses(pdf)])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in BUFFER)
    kept = f"{own}, _b bigint, {_RECENT}"
    after = Window.partitionBy(*BUFFER).orderBy("_b")  # a row per stretch
    ends, starts = None, None
    # a stretch of few places may not fill the window, so its guess may be wrong; that is found as any other is
    guess = rows.where(F.col("seq") - F.col("_b") * stretch >= stretch - before).groupBy(*keys).applyInPandas(last, kept)
    number = rows.select(*keys).distinct()
    guess = guess.unionByName(number, allowMissingColumns=True).groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("at", "served", "updated")])

    def of(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
        """The rows of some stretches, or the others; a buffer's names may be null."""
        some = some.select(*[F.col(k).alias(f"_of_{k}") for k in keys])
        return df.join(some, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]), how)

    while True:
        now = (guess if ends is None else ends).select(*keys, *[F.lag(F.struct("at", "served", "updated")).over(after).alias("_s")])
        begun = storage.save(now.where("_s.at IS NOT NULL").select(*keys, "_s.*"), "starts")
        again = None
        if starts is not None:
            # states are compared as they are: lists in the order of the accesses, requestors sorted
            again = storage.save(begun.exceptAll(starts).select(*keys).unionByName(starts.select(*keys).exceptAll(begun.select(*keys))), "again")
            if not again.limit(1).count():
                storage.drop(again, ends, begun)
                break
        redo = rows if again is None else of(rows, storage.small(again), "left_semi")
        done = redo.groupBy(*keys).cogroup(begun.groupBy(*keys)).applyInPandas(through, kept)
        if again is not None:
            done = done.unionByName(of(ends, storage.small(again), "left_anti"))
        old, ends = [x for x in (ends, starts, again) if x is not None], storage.save(done, "ends")
        storage.drop(*old)
        starts = begun
    result = f"{own}, seq bigint, addr bigint, requestor int, kind string, coalesced boolean"
    return rows.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(marked, result)


def lru(trace: DataFrame, size: int, granularity: int = 1) -> DataFrame:
    """Fills and evictions of a fully associative LRU buffer with write allocation and write-back.

    (BUFFER, seq, event, addr): event is hit, fill (a read that missed),
    allocate (an update that missed) or evict (clean or dirty, with the victim's
    line; those at the end come in LRU order, their seq null).
    """
    lines = max(1, size // granularity)

    def each(held: OrderedDict, row):
        if row is None:
            for at, dirty in held.items():
                yield None, "evict dirty" if dirty else "evict", at
            return
        at = row.addr - row.addr % granularity
        update = row.kind == "U"
        if at in held:
            held.move_to_end(at)
            yield row.seq, "hit", at
        else:
            if len(held) == lines:
                victim, dirty = held.popitem(last=False)
                yield row.seq, "evict dirty" if dirty else "evict", victim
            held[at] = False
            yield row.seq, "allocate" if update else "fill", at
        held[at] = held[at] or update

    return _streamed(trace.select(*BUFFER, "seq", "addr", "kind"), BUFFER, "tensor string, port int, level int, buffer int, seq double, event string, addr bigint", OrderedDict, each).withColumn("seq", F.col("seq").cast("bigint"))


def lru_statistics(events: DataFrame) -> DataFrame:
    """(BUFFER, fills, allocations, hits, evicts, backing_reads, backing_updates): a victim is one backing read, and an update if dirty."""
    n = lambda *kinds: F.sum(F.col("event").isin(*kinds).cast("bigint"))
    return events.groupBy(*BUFFER).agg(n("fill").alias("fills"), n("allocate").alias("allocations"), n("hit").alias("hits"), n("evict", "evict dirty").alias("evicts"), n("evict", "evict dirty").alias("backing_reads"), n("evict dirty").alias("backing_updates"))


def backing_trace(events: DataFrame, keep_dirty: bool = True) -> DataFrame:
    """The evictions as accesses of the next level: (BUFFER, seq, addr, kind). keep_dirty=False drops write-backs, as a flush does that clears presence first."""
    out = events.where(F.col("event").startswith("evict")).select(*BUFFER, "seq", "addr", F.when(F.col("event") == "evict dirty", F.array(F.lit("R"), F.lit("U"))).otherwise(F.array(F.lit("R"))).alias("_k"))
    return out.select(*BUFFER, "seq", "addr", F.explode("_k").alias("kind")).where((F.col("kind") == "R") | F.lit(keep_dirty))


def through_levels(trace: DataFrame, levels: list[tuple[int, int]]) -> list[DataFrame]:
    """The events of a chain of LRU buffers (size, granularity), the outermost level last.

    What a level evicts, those held at the end after all others, are the
    accesses of the next one; each level's events are written, since both its
    statistics and the next level read them.
    """
    out = []
    for k, (size, granularity) in enumerate(levels):
        events = storage.save(lru(trace, size, granularity), "level")
        out.append(events)
        # evictions in program order; those of the end have no place of their own, and go by line
        order = Window.partitionBy(*BUFFER).orderBy(F.col("seq").asc_nulls_last(), "addr", "kind")
        trace = backing_trace(events).withColumn("seq", F.row_number().over(order).cast("bigint")).withColumn("level", F.lit(k + 1)).withColumn("requestor", F.lit(0))
    return out


def row_buffer(trace: DataFrame, keys: list[str], width: int = 16, stride: int = 1 << 18) -> DataFrame:
    """(keys, row_hits, row_misses): an access hits if it is in the row of the one before.

    A buffer's accesses are compared in stretches of `stride` places of seq,
    each a task's; then the first of a stretch with the last before it.
    """
    cut = trace.withColumn("_row", F.floor(F.col("addr") / width)).withColumn("_b", F.floor(F.col("seq") / stride))
    hit = F.coalesce(F.col("_row") == F.lag("_row").over(Window.partitionBy(*keys, "_b").orderBy("seq")), F.lit(False))
    parts = cut.withColumn("_hit", hit.cast("bigint")).groupBy(*keys, "_b").agg(F.sum("_hit").alias("_hits"), F.count(F.lit(1)).alias("_n"), F.min_by("_row", "seq").alias("_first"), F.max_by("_row", "seq").alias("_last"))
    joint = F.coalesce(F.col("_first") == F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")), F.lit(False))
    whole = parts.withColumn("_hits", F.col("_hits") + joint.cast("bigint")).groupBy(*keys).agg(F.sum("_hits").alias("row_hits"), F.sum("_n").alias("_n"))
    return whole.select(*keys, "row_hits", (F.col("_n") - F.col("row_hits")).alias("row_misses"))


def statistics_tree(counters: DataFrame, path: list[str], value: str = "n") -> DataFrame:
    """(path, stat, n): counters with sub-totals of every prefix of the path (nulls stand for all), per stat."""
    return counters.rollup("stat", *path).agg(F.sum(value).cast("bigint").alias("n")).where(F.col("stat").isNotNull())


def compute_ops(trace: DataFrame) -> DataFrame:
    """(engine, op, inputs, outputs) from a log (engine, seq, tensor_id, kind): a write ends an op with an output; a second read of a tensor ends one without."""

    class State:
        def __init__(self):
            self.op, self.reads = 0, set()

    def each(s: State, row):
        if row is None:
            return
        if row.kind == "U":
            yield s.op, sum(1 << t for t in s.reads), 1 << row.tensor_id
            s.op, s.reads = s.op + 1, set()
            return
        if row.tensor_id in s.reads:
            yield s.op, sum(1 << t for t in s.reads), 0
            s.op, s.reads = s.op + 1, set()
        s.reads.add(row.tensor_id)

    return _streamed(trace.select("engine", "seq", "tensor_id", "kind"), ["engine"], "engine int, op bigint, inputs bigint, outputs bigint", State, each)


#: Units of the default physical levels, outermost first.
DEFAULT_UNITS = (1, 1, 2, 8, 8)


def bind_compute(ops: DataFrame, bindings: DataFrame) -> DataFrame:
    """Operations (level, engine, ...) with the unit of a table (level, engine, unit), of which a null unit is disabled: its operations go. Engines without a row get compute.level.engine."""
    given = bindings.select("level", "engine", "unit", F.lit(True).alias("_bound"))
    joined = ops.join(given, ["level", "engine"], "left").where("_bound IS NULL OR unit IS NOT NULL")
    return joined.withColumn("unit", F.coalesce("unit", F.concat_ws(".", F.lit("compute"), "level", "engine"))).drop("_bound")


def bind(trace: DataFrame, bindings: DataFrame) -> DataFrame:
    """trace with the physical names of a table (tensor, level, buffer, unit); unbound buffers get the default unit of their level."""
    units = F.array(*map(F.lit, DEFAULT_UNITS))
    default = F.concat_ws(".", F.lit("unit"), "level", F.col("buffer") % F.try_element_at(units, F.least(F.col("level") + 1, F.lit(len(DEFAULT_UNITS)))))
    return trace.join(bindings, ["tensor", "level", "buffer"], "left").withColumn("unit", F.coalesce("unit", default))
