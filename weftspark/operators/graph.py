"""Fixpoint queries over graphs, one Spark job per synchronous round.

Only results that don't depend on the order of a sweep are given: reachability,
levels, parents by an explicit tie-break, least labels, shortest distances and
the synchronous rank recurrences. Edges lie in bucketed tables (Adjacency) and
so does the state, by vertex: a round shuffles messages only, and counts what it
needs to know while it writes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark import storage
from weftspark.model import Graph
from weftspark.operators.adjacency import Adjacency

UNREACHED = 1073741823


#: A level is pulled if its frontier's vertices and edges together are more than one in so many edges.
PULL = 20
#: Levels after which those found so far are put into one table.
LEVELS = 8
#: Bytes of a vertex in a broadcast front, about.
ROW = 32


def _sized(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query over a graph, whose tables have the partitions that the graph's size asks for."""

    @functools.wraps(query)
    def run(g: Graph, *args, **options) -> DataFrame:
        with storage.partitions_for(g.edges):
            return query(g, *args, **options)

    return run


@_sized
def bfs(g: Graph, source: int = 0, order: str = "s", most: int = 1 << 20, pull: int = PULL) -> DataFrame:
    """(v, level, parent) of all vertices: unreached -1, the source its own parent.

    A parent is the in-neighbour of the level before that is smallest by
    `order` (a column of the edges: s, or pos for the place in the row). A
    frontier pushes along its edges; a large one that may still be broadcast is
    pulled by the vertices not yet reached, over a table of the edges by their
    end, so that its messages to vertices already reached never leave a task.
    """
    spark = g.edges.sparkSession
    edges = g.edges.select("s", "d", F.col(order).alias("_o"))
    out, into = Adjacency(edges), None
    best = F.min_by("s", F.struct("_o", "s")).cast("int").alias("parent")
    counts = {"n": F.count(F.lit(1)), "e": F.sum("deg")}
    first = spark.createDataFrame([(source, 0, source)], "v int, level int, parent int").join(out.degrees, "v", "left")
    frontier = storage.save_bucketed(first, ["v"], "frontier", **counts)
    seen, kept = frontier, [frontier]
    for level in range(1, most):
        size = frontier._weft_seen
        if not size.get("n"):
            break
        n, e = size["n"], size["e"] or 0
        small = n * ROW <= storage.BROADCAST_BYTES
        front = frontier.select("v")
        if small and n + e > out.total / pull:
            into = into or Adjacency(edges, "d", "s")
            left = into.send(into.degrees.select("v").join(seen.select("v"), "v", "left_anti"))
            reached = left.join(F.broadcast(front.withColumnRenamed("v", "s")), "s").groupBy(F.col("d").alias("v")).agg(best)
        else:
            reached = out.send(front, small).groupBy(F.col("d").alias("v")).agg(best).join(seen.select("v"), "v", "left_anti")
        step = reached.select("v", F.lit(level).alias("level"), "parent").join(out.degrees, "v", "left")
        frontier = storage.save_bucketed(step, ["v"], "frontier", dealt=True, **counts)
        seen = seen.unionByName(frontier)
        kept.append(frontier)
        if level % LEVELS == 0:
            seen = storage.save_bucketed(seen, ["v"], "seen", dealt=True)
            storage.drop(*kept[:-1])
            kept = [frontier, seen]
    out.drop()
    if into:
        into.drop()
    return g.vertices.join(seen, "v", "left").select("v", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("parent", F.lit(-1)).alias("parent"))


def reachable(g: Graph, source: int = 0) -> DataFrame:
    """(v, connected): 1 if a path leads from the source."""
    return bfs(g, source).select("v", (F.col("level") >= 0).cast("int").alias("connected"))


def depth(levels: DataFrame) -> DataFrame:
    """One row: largest level and vertices reached."""
    return levels.agg(F.max("level").alias("depth"), F.sum((F.col("level") >= 0).cast("bigint")).alias("reached"))


def _settle(state: DataFrame, edges: Adjacency, send, moved: str, most: int, name: str, step) -> DataFrame:
    """Rounds of a state (v, ..., moved): what moved is sent along the edges, the messages of a vertex are added up, and step(state joined with them) is the next state."""
    count = {"n": F.count(F.when(F.col("moved"), 1))}
    state = storage.save_bucketed(state, ["v"], name, **count)
    for _ in range(most):
        if not (n := state._weft_seen.get("n")):
            break
        sent = edges.send(state.where("moved").select("v", moved), n * ROW <= storage.BROADCAST_BYTES).groupBy(F.col("d").alias("v")).agg(send)
        old, state = state, storage.save_bucketed(step(state.join(sent, "v", "left")), ["v"], name, dealt=True, **count)
        storage.drop(old)
    return state


@_sized
def least_labels(g: Graph, most: int = 1 << 20) -> DataFrame:
    """(v, label): the smallest vertex from which a path along the edges leads here; components if the graph is symmetric.

    Only vertices whose label fell in the last round send it on.
    """
    edges = Adjacency(g.edges.select("s", "d"))
    state = g.vertices.select("v", F.col("v").alias("label"), F.lit(True).alias("moved"))
    step = lambda df: df.select("v", F.least("label", "new").alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("moved"))
    state = _settle(state, edges, F.min("label").alias("new"), "label", most, "labels", step)
    edges.drop()
    return state.select("v", "label")


def components(g: Graph, most: int = 64) -> DataFrame:
    """(v, label): the smallest vertex of each vertex's component, edges counting both ways.

    Alternating large-star and small-star steps over (v, m) with m < v: each
    vertex ties its larger, then its smaller neighbours to the smallest one.
    The rounds grow with the logarithm of the graph, not with its diameter. A
    hub's smallest neighbour comes from partial minima and is written before it
    is joined back, so that Spark can split the hub's rows in that join.
    """
    pairs = storage.save(g.edges.where("s <> d").select(F.greatest("s", "d").alias("v"), F.least("s", "d").alias("m")).distinct(), "stars")
    for _ in range(most):
        ends = pairs.select("v", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("m").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = storage.save(both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("low", "v").alias("low")), "low")
        large = storage.save(both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct(), "stars")
        least = storage.save(large.groupBy("v").agg(F.min("m").alias("low")), "low")
        tied = large.join(least, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        old, pairs = pairs, storage.save(tied.unionByName(least.select("v", F.col("low").alias("m"))).distinct(), "stars")
        storage.drop(old, low, large, least)
    else:
        raise RuntimeError("components did not settle")
    return g.vertices.join(pairs, "v", "left").select("v", F.coalesce("m", "v").alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


@_sized
def pagerank_delta(g: Graph, alpha: int = 85, threshold: int = 1, one: int = 1_000_000, most: int = 1 << 20) -> DataFrame:
    """(v, rank, delta, active) of the integer recurrence, all divisions truncating.

    A vertex sends delta div outdegree, truncated before the sum; the first
    round takes the restart off, later ones only damp. Vertices stay active
    while their delta is over `threshold` percent of a positive rank.
    """
    n = g.n
    edges = Adjacency(g.edges.select("s", "d"))
    # a vertex divides its delta before it sends it, so edges carry nothing
    shared = F.expr("CASE WHEN active THEN delta div deg END").alias("share")
    start = g.vertices.join(edges.degrees, "v", "left").select("v", "deg", F.lit(0).cast("bigint").alias("rank"), F.lit(one // n).cast("bigint").alias("delta"), F.lit(True).alias("active"))
    count = {"n": F.count(F.when(F.col("active"), 1))}
    state = storage.save_bucketed(start, ["v"], "rank", **count)
    bar = f"{threshold} * rank div 100"
    for k in range(most):
        if not (moved := state._weft_seen.get("n")):
            break
        sent = edges.send(state.where("active AND deg > 0").select("v", shared), moved * ROW <= storage.BROADCAST_BYTES).groupBy(F.col("d").alias("v")).agg(F.sum("share").alias("got"))
        new = f"(coalesce(got, 0L) * {alpha} * {n}L - {alpha * one}L) div {100 * n}L" if k == 0 else f"{alpha} * coalesce(got, 0L) div 100"
        step = state.join(sent, "v", "left").select("v", "deg", "rank", F.expr(new).alias("delta")).withColumn("rank", F.col("rank") + F.col("delta"))
        old, state = state, storage.save_bucketed(step.withColumn("active", F.expr(f"rank > 0 AND (delta > {bar} OR delta < -({bar}))")), ["v"], "rank", dealt=True, **count)
        storage.drop(old)
    edges.drop()
    return state.select("v", "rank", "delta", "active")


@_sized
def nibble(g: Graph, seeds: DataFrame, most: int, first: int = 0xAA, second: int = 0xBB, epsilon: int = 12) -> DataFrame:
    """(seed, v, rank, residual) of the integer local ranking, all seeds (column seed) in one job.

    Mass grows by the factor `second` each round on graphs of low degree, so
    the number of rounds is given. Vertices without mass have no row.
    """
    return _nibble(g, seeds, most, F.expr(f"{first}L * residual"), f"{second}L * residual div deg", f"deg > 0 AND residual >= deg * {epsilon}L", "bigint").select("seed", "v", "rank", "residual")


@_sized
def nibble_accesses(g: Graph, seeds: DataFrame, most: int, first: int = 0xAA, second: int = 0xBB, epsilon: int = 12) -> DataFrame:
    """(seed, tensor, addr, reads, updates) of the round after `most` rounds of nibble().

    Each vertex of the frontier has its residual read and its rank updated, and
    each of its edges updates the residual of the edge's end.
    """
    state = _nibble(g, seeds, most, F.expr(f"{first}L * residual"), f"{second}L * residual div deg", f"deg > 0 AND residual >= deg * {epsilon}L", "bigint")
    front = state.where("front").select("seed", "v")
    own = front.select("seed", F.explode(F.array(F.lit("residual"), F.lit("rank"))).alias("tensor"), F.col("v").alias("addr"))
    own = own.withColumn("reads", (F.col("tensor") == "residual").cast("bigint")).withColumn("updates", (F.col("tensor") == "rank").cast("bigint"))
    sent = g.edges.select("s", "d").join(front.withColumnRenamed("v", "s"), "s").groupBy("seed", F.col("d").alias("addr")).agg(F.count(F.lit(1)).alias("updates"))
    sent = sent.select("seed", F.lit("residual").alias("tensor"), "addr", F.lit(0).cast("bigint").alias("reads"), "updates")
    return own.unionByName(sent).groupBy("seed", "tensor", "addr").agg(F.sum("reads").alias("reads"), F.sum("updates").alias("updates"))


@_sized
def nibble_double(g: Graph, seeds: DataFrame, alpha: float = 0.15, epsilon: float = 1e-6, most: int = 1024) -> DataFrame:
    """The same in floating point: rank gains 2a/(1+a) of a residual, neighbours share (1-a)/(1+a) of it."""
    first, second = 2 * alpha / (1 + alpha), (1 - alpha) / (1 + alpha)
    return _nibble(g, seeds, most, F.lit(first) * F.col("residual"), f"{second!r}D * residual / deg", f"deg > 0 AND residual >= deg * {epsilon!r}D", "double").select("seed", "v", "rank", "residual")


def _nibble(g, seeds, most, gain, update, test, kind):
    deg = storage.save_bucketed(g.out_degree().select("v", "deg"), ["v"], "degrees", dealt=True)
    ends = deg.select(F.col("v").alias("d"), F.col("deg").alias("deg_d"))
    edges = Adjacency(g.edges.select("s", "d").join(ends, "d", "left"))
    zero = F.lit(0).cast(kind)
    first = seeds.select(F.col("seed").cast("int").alias("seed")).distinct().select("seed", F.col("seed").alias("v")).join(deg, "v", "left")
    first = first.select("seed", "v", F.coalesce("deg", F.lit(0)).cast("bigint").alias("deg"), zero.alias("rank"), F.lit(1).cast(kind).alias("residual"), F.lit(True).alias("front"))
    count = {"n": F.count(F.when(F.col("front"), 1))}
    state = storage.save_bucketed(first, ["seed", "v"], "nibble", **count)
    for _ in range(most):
        if not (n := state._weft_seen.get("n")):
            break
        front = state.where("front AND deg > 0").select("v", "seed", F.expr(update).alias("share"))
        sent = edges.send(front, n * ROW <= storage.BROADCAST_BYTES).groupBy("seed", F.col("d").alias("v")).agg(F.sum("share").alias("got"), F.max("deg_d").alias("deg_d"))
        ranked = state.select("seed", "v", "deg", F.when(F.col("front"), F.col("rank") + gain).otherwise(F.col("rank")).alias("rank"), F.when(F.col("front"), zero).otherwise(F.col("residual")).alias("residual"))
        both = ranked.join(sent, ["seed", "v"], "full_outer").select("seed", "v", F.coalesce("deg", "deg_d", F.lit(0)).alias("deg"), F.coalesce("rank", zero).alias("rank"), (F.coalesce("residual", zero) + F.coalesce("got", zero)).alias("residual"))
        old, state = state, storage.save_bucketed(both.withColumn("front", F.expr(test)), ["seed", "v"], "nibble", dealt=True, **count)
        storage.drop(old)
    edges.drop()
    storage.drop(deg)
    return state


@_sized
def shortest_paths(g: Graph, source: int = 0, most: int | None = None) -> DataFrame:
    """(v, dist): least sums of w along the edges; UNREACHED where there is no path. Rounds: the number of vertices at most (negative cycles are not looked for)."""
    edges = Adjacency(g.edges.select("s", "d", "w"))
    state = g.vertices.select("v", F.when(F.col("v") == source, 0).otherwise(UNREACHED).cast("bigint").alias("dist"), (F.col("v") == source).alias("moved"))
    step = lambda df: df.select("v", F.least("dist", "new").alias("dist"), F.coalesce(F.col("new") < F.col("dist"), F.lit(False)).alias("moved"))
    state = _settle(state, edges, F.min(F.col("dist") + F.col("w")).alias("new"), "dist", g.n if most is None else most, "dist", step)
    edges.drop()
    return state.select("v", "dist")


def spmv_rounds(g: Graph, rounds: int = 10, x: DataFrame | None = None) -> DataFrame:
    """(v, y): rounds of y[d] += w * x[s] for all vertices; x (v, x): a value per vertex, without it ones and no weights.

    x doesn't change, so one product, times the rounds, is all of them.
    """
    if x is None:
        return g.vertices.join(g.in_degree(), "v", "left").select("v", (F.coalesce("deg", F.lit(0)) * rounds).cast("bigint").alias("y"))
    sent = g.edges.join(x.select(F.col("v").alias("s"), "x"), "s").groupBy(F.col("d").alias("v")).agg(F.sum(F.col("w") * F.col("x")).alias("_y"))
    return g.vertices.join(sent, "v", "left").select("v", (F.coalesce("_y", F.lit(0)) * rounds).cast("bigint").alias("y"))


def frontier_spmv(g: Graph, frontier: DataFrame) -> DataFrame:
    """(v, y): sums of w over edges that leave the frontier (v)."""
    return g.edges.join(frontier.select(F.col("v").alias("s")), "s", "left_semi").groupBy(F.col("d").alias("v")).agg(F.sum("w").alias("y"))


#: Rows of the three sides that one cell of the cube holds, about; pairs of a step inside a cell.
CELL_ROWS, PAIRS = 1 << 22, 1 << 20


def _cell(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The sorted sets of pairs (s, d) of each kind, packed batch by batch: eight bytes a row, and as many while they are sorted."""
    held = [[], [], []]
    for b in batches:
        s, d, kind = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("s", "d", "kind"))
        pairs = s.astype(np.int64) << 32 | d
        for k, parts in enumerate(held):
            parts.append(pairs[kind == k])
    out = []
    for k in range(3):
        x = np.concatenate(held[k]) if held[k] else np.zeros(0, np.int64)
        held[k] = None
        x.sort()
        out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
    return out


def _meet(uv: np.ndarray, vw: np.ndarray, uw: np.ndarray) -> int:
    """Triples (u, v, w) with uv, vw and uw in three sorted sets of packed pairs: for each uv the shorter of two sorted neighbour lists is looked up in the other."""
    if not (len(uv) and len(vw) and len(uw)):
        return 0
    u, v = uv >> 32, uv & 0xFFFFFFFF
    spans = [(np.searchsorted(side, x << 32), np.searchsorted(side, x + 1 << 32)) for side, x in ((vw, v), (uw, u))]
    size = [b - a for a, b in spans]
    found = 0
    for mine, own, other, fixed in ((size[0] <= size[1], 0, uw, u), (size[0] > size[1], 1, vw, v)):
        side, at = (vw, uw)[own], np.flatnonzero(mine & (size[own] > 0))
        n, lo = size[own][at], spans[own][0][at]
        ends, k = np.cumsum(n), 0
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, side="right")))
            m = n[k:to]
            w = side[np.repeat(lo[k:to] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] & 0xFFFFFFFF
            want = np.repeat(fixed[at[k:to]], m) << 32 | w
            place = np.searchsorted(other, want)
            found += int((other[np.minimum(place, len(other) - 1)] == want).sum())
            k = to
    return found


def _closed_triples(edges: DataFrame, closing: tuple[str, str]) -> DataFrame:
    """One row n: triples u -> v -> w of edges (s, d; parallel ones count once) whose ends the closing edge joins, (u, w) or (w, u).

    Tasks form a cube, a side each for u, v and w. An edge goes to the cells
    that its two ends leave open, once as each of the three edges, so all three
    sides meet in one exchange and no pair of edges is ever written. A hub's
    edges spread over a whole face of the cube.
    """
    spark = edges.sparkSession
    rows = edges.count()
    side = max(1, round(storage.buckets(spark) ** (1 / 3)), math.ceil((3 * rows / CELL_ROWS) ** 0.5))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    s, d = place("s"), place("d")
    u, w = (s, d) if closing == ("u", "w") else (d, s)
    cell = lambda kind, x, y, z: F.struct(F.lit(kind).alias("kind"), (x * side * side + y * side + z).alias("cell"))
    copies = lambda k: [cell(0, s, d, F.lit(k)), cell(1, F.lit(k), s, d), cell(2, u, F.lit(k), w)]
    dealt = edges.select(F.col("s").cast("int").alias("s"), F.col("d").cast("int").alias("d"), F.explode(F.array(*[c for k in range(side) for c in copies(k)])).alias("c")).select("s", "d", "c.kind", "c.cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uv, vw, uw = _cell(batches)
        if closing == ("w", "u"):
            uw = np.sort((uw & 0xFFFFFFFF) << 32 | uw >> 32)
        yield pa.RecordBatch.from_arrays([pa.array([_meet(uv, vw, uw)], pa.int64())], names=["n"])

    return dealt.repartitionById(side**3, "cell").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@_sized
def cycles3(g: Graph) -> DataFrame:
    """One row n: ordered directed cycles u -> v -> w -> u without loops; parallel edges count once."""
    return _closed_triples(g.edges.where("s <> d").select("s", "d"), ("w", "u"))


@_sized
def triangles(g: Graph) -> DataFrame:
    """One row n: triangles of the undirected graph, six times each; loops and parallel edges don't count."""
    e = g.edges.where("s <> d").select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d"))
    return _closed_triples(e, ("u", "w")).select((F.col("n") * 6).alias("n"))
