"""Operators, sources and streams against plain Python on small inputs."""

import collections
import os
import random
import weakref
from collections import OrderedDict, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftspark import check, storage
from weftspark.functions import reductions, scalar
from weftspark.model import Graph, Tensor
from weftspark.operators import adjacency, blocks, conv, dataflow, fibers, footprint, graph, linalg, longconv, loops, scan, scans, sparse, trace
from weftspark.operators.einsum import Affine, einsum, parse
from weftspark.plans import catalog
from weftspark.sources import archive, clustered, generators, statistics
from weftspark.sources import driver as D
from weftspark.streaming import edges, groups

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")

def tensor(spark, array, index, keep_zeros=False):
    array = np.asarray(array)
    rows = [(*map(int, i), int(array[i])) for i in np.ndindex(array.shape) if keep_zeros or array[i]]
    return Tensor(spark.createDataFrame(rows, ", ".join([*(f"{c} int" for c in index), "v bigint"])), index, array.shape)


def array(t):
    out = np.zeros(t.shape, np.int64)
    for r in t.df.collect():
        out[tuple(r[c] for c in t.index)] = r[t.value]
    return out


# expressions

def test_scalar_semantics(spark):
    df = spark.createDataFrame([(-7, 2), (7, -2), (0, 3), (2147483647, 1)], "a int, b int")
    f = df.select(scalar.divide(F.col("a"), F.col("b")), scalar.modulo(F.col("a"), F.col("b")), scalar.add(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in f] == [(-3, -1, -5), (-3, 1, 5), (0, 0, 3), (2147483647, 0, 2147483648)]


def test_division_by_zero_raises(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|REMAINDER_BY_ZERO"):
        spark.range(1).select(scalar.divide(1, F.col("id"))).collect()


def test_first_taken_arm(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "x int")
    x = F.col("x")
    got = df.select(loops.choose((x == 0, F.lit("a")), (scalar.le(x, 1), F.lit("b")), otherwise=F.lit("c"))).collect()
    assert [r[0] for r in got] == ["a", "b", "c"]


def test_product_reduction(spark):
    df = spark.createDataFrame([(1, 2), (1, -3), (2, 0), (2, 9)], "k int, v int")
    assert dict(map(tuple, df.groupBy("k").agg(reductions.product(F.col("v"))).collect())) == {1: -6, 2: 0}


def test_loop_domain(spark):
    got = [tuple(r) for r in loops.domain(spark, i=(1, 3), j=(0, 2)).orderBy("i", "j").collect()]
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert loops.domain(spark, i=(3, 3), j=(0, 2)).count() == 0


def test_inner_loop_of_nothing(spark):
    df = spark.createDataFrame([(0, 0), (1, 3)], "lo int, hi int")
    assert [r.k for r in loops.inner(df, "k", F.col("lo"), F.col("hi")).orderBy("k").collect()] == [1, 2]


def test_repeat_until_still(spark):
    state = spark.createDataFrame([(5, True), (2, True)], "n int, moved boolean")
    out, rounds = loops.repeat(state, lambda s: s.select(F.greatest(F.col("n") - 1, F.lit(0)).alias("n"), (F.col("n") > 1).alias("moved")), F.col("moved"), 100)
    assert rounds == 5 and [r.n for r in out.collect()] == [0, 0]


# index notation

def test_affine():
    a = Affine.parse("2*p + r - 1")
    assert dict(a.terms) == {"p": 2, "r": 1} and a.constant == -1
    assert [(t.scale, [f.name for f in t.factors]) for t in parse("Z[m,n] += A[m,k] * B[k,n] * 17 - 2*C[m] + 4")[2]] == [(17, ["A", "B"]), (-2, ["C"]), (4, [])]


@pytest.mark.parametrize("statement", ["Z[i] += A[i", "Z[i] += A[i*j]", "Z[i] += A[i] ^ B[i]", "Z[i] + A[i]", "Z[i] += A[i]]", "Z[i] += ", "Z[i] += A[i] B[i]", "Z[i] += A[i/0]", "Z[i] += (A[i])", "Z[i] max= A[i] + A[i]", "Z[A[i]] += A[i]", "Z[i] += A[i%3]", "Z[i] += A[i:2]", "Z[i] += A[i/j]"])
def test_einsum_raises(spark, statement):
    with pytest.raises(ValueError):
        einsum(statement, {"A": tensor(spark, [1, 2, 3], ("i",)), "B": tensor(spark, [1, 2, 3], ("i",))})


@pytest.mark.parametrize("statement,given,expected", [
    ("Z[m,n] += A[m,k] * B[k,n]", {}, lambda a, b: a @ b),
    ("Z[n,m] += A[m,k] * B[k,n] * 3", {}, lambda a, b: 3 * (a @ b).T),
    ("Z[m] += A[m,m2]", {}, lambda a, b: a.sum(1)),
    ("Z[m] max= A[m,k]", {}, lambda a, b: a.max(1)),
    ("Z[k] += A[2*k,k]", {"k": 3}, lambda a, b: np.array([a[2 * k, k] for k in range(3)])),
    ("Z[i] += A[i,5-i]", {"i": 6}, lambda a, b: np.array([a[i, 5 - i] for i in range(6)])),
    ("Z[i,j] += A[i,j] + B[i,j] - 3", {"i": 6, "j": 5}, lambda a, b: a[:6, :5] + b - 3),
    ("Z[i] += A[i,k] - 2 * B[j,0] * A[i,0]", {"i": 4}, lambda a, b: np.array([6 * a[i].sum() - 2 * 6 * b[:, 0].sum() * a[i, 0] for i in range(4)])),
    ("Z[i] += -A[i,1]", {}, lambda a, b: -a[:, 1]),
    ("Z[i] += A[i/3,i%4]", {"i": 20}, lambda a, b: np.array([a[i // 3, i % 4] for i in range(20)])),
    ("Z[i] += A[0,i%6]", {"i": 9}, lambda a, b: np.array([a[0, i % 6] for i in range(9)])),
    ("Z[i/2] += A[i,j]", {}, lambda a, b: np.array([a[i : i + 2].sum() for i in range(0, 7, 2)])),
    ("Z[i] += A[2*i/3+1,0]", {"i": 8}, lambda a, b: np.array([a[2 * (i // 3) + 1, 0] if 2 * (i // 3) + 1 < 7 else 0 for i in range(8)])),
    ("Z[j] += A[I[j],j]", {}, lambda a, b: np.array([a[[3, 0, 6, 2, 2][j], j] for j in range(5)])),
    ("Z[k] += B[I[I[k]-1],0] * A[k,I[k]-1]", {"k": 1}, lambda a, b: np.array([0])),
    ("Z[j] += A[j/2,I[j]-2]", {}, lambda a, b: np.array([a[j // 2, x - 2] if 0 <= x - 2 < 6 else 0 for j, x in enumerate([3, 0, 6, 2, 2])])),
])
def test_einsum(spark, statement, given, expected):
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 9, (7, 6)), rng.integers(-4, 9, (6, 5))
    z = einsum(statement, {"A": tensor(spark, a, ("i", "j")), "B": tensor(spark, b, ("x", "y")), "I": tensor(spark, [3, 0, 6, 2, 2], ("p",))}, given)
    assert (array(z.dense()) == expected(a, b)).all()


@pytest.mark.parametrize("tile", [(4, 4, 4), (3, 2, 5), (100, 100, 100)])
def test_matmul_tiled(spark, tile):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-5, 6, (10, 7)), rng.integers(-5, 6, (7, 9))
    z = linalg.matmul_tiled(tensor(spark, a, ("m", "k")), tensor(spark, b, ("k", "n")), tile, 17)
    assert (array(z) == a @ b * 17).all()


def test_empty_and_single(spark):
    e = tensor(spark, np.zeros((3, 3), int), ("m", "k"))
    assert linalg.matmul(e, e.rename("k", "n")).df.count() == 0
    assert array(linalg.matmul(e, e.rename("k", "n")).dense()).sum() == 0
    one = tensor(spark, [[4]], ("m", "k"))
    assert linalg.dot(Tensor(one.df.select("k", "v"), ("k",), (1,)), Tensor(one.df.select("k", "v"), ("k",), (1,))).first().v == 16


@pytest.mark.parametrize("f", [conv.conv1d, conv.conv1d_scatter])
def test_conv1d(spark, f):
    rng = np.random.default_rng(2)
    x, w = rng.integers(-5, 6, 23), rng.integers(-5, 6, 4)
    assert (array(f(tensor(spark, x, ("i",)), tensor(spark, w, ("s",)))) == np.correlate(x, w, "valid")).all()


def test_conv_channels(spark):
    rng = np.random.default_rng(3)
    x, w = rng.integers(-5, 6, (2, 6, 7)), rng.integers(-5, 6, (3, 2, 3, 2))
    out = np.zeros((3, 4, 6), int)
    for k, q, p in np.ndindex(out.shape):
        out[k, q, p] = (x[:, q : q + 3, p : p + 2] * w[k]).sum()
    assert (array(conv.conv_channels(tensor(spark, x, ("c", "h", "w")), tensor(spark, w, ("k", "c", "s", "r")))) == out).all()


@pytest.mark.parametrize("tile", [(3, 4), (4, 6), (10, 1)])
def test_conv_tiled(spark, tile):
    rng = np.random.default_rng(4)
    x, w = rng.integers(-5, 6, (2, 6, 7)), rng.integers(-5, 6, (3, 2, 3, 2))
    a, b = tensor(spark, x, ("c", "h", "w")), tensor(spark, w, ("k", "c", "s", "r"))
    assert (array(conv.tiled(a, b, tile)) == array(conv.conv_channels(a, b))).all()
    a, b = tensor(spark, x[0], ("h", "w")), tensor(spark, w[0, 0], ("r", "s"))
    assert (array(conv.tiled(a, b, tile)) == array(conv.conv2d(a, b))).all()


def test_conv_tiled_of_few_inputs(spark):
    a = tensor(spark, [0, 0, 5, 0, 0, 0, 0, 0, 0, -1], ("i",))
    b = tensor(spark, [2, 1, 3], ("s",))
    rows = lambda t: sorted((r.q, r.v) for r in t.df.collect())
    assert rows(conv.tiled(a, b, (4,))) == rows(conv.conv1d(a, b))
    with pytest.raises(ValueError):
        conv.tiled(a, b, (2, 2))


@pytest.mark.parametrize("form", ["fused", "staged", "decoupled"])
@pytest.mark.parametrize("tile", [None, (2, 2, 2)])
def test_multiply_then_scale(spark, form, tile):
    a = np.arange(1, 13).reshape(3, 4)
    t = dataflow.multiply_then_scale(tensor(spark, a, ("m", "k")), tensor(spark, a.T, ("k", "n")), 17, form, tile)
    assert (array(t) == a @ a.T * 17).all()


# known results

def compressed_line(entries: list[tuple[int, ...]], shape: tuple[int, ...]) -> str:
    """The archive's line for sorted entries (coordinates, value)."""
    rank = len(shape)
    segments, coords = [[0] for _ in range(rank)], [[] for _ in range(rank)]
    before = None
    for e in entries:
        # from the first coordinate that changed on, each level has a new point, and below it a new fiber
        first = 0 if before is None else next((k for k in range(rank) if e[k] != before[k]), rank)
        for k in range(first, rank):
            if k > first or before is None:
                segments[k].append(segments[k][-1])
            coords[k].append(e[k])
            segments[k][-1] += 1
        before = e
    if before is None and rank:
        segments[0].append(0)
    vec = lambda x: f"{len(x)} 0" + "".join(f" {v}" for v in x)
    last = list(entries[-1][:rank][::-1]) if entries else [0] * rank
    parts = [*archive.HEAD, "0 0", str(rank), str(len(entries)), vec(shape[::-1]), "0 0 0 0", vec(last)]
    for x in [*segments, *coords, [e[-1] for e in entries]]:
        parts += [vec([len(x)]), vec(x)]
    return " ".join(parts)


#: Coordinates of two sparse vectors of ones with 16 places, and those they share.
LEFT = [0, 3, 5, 7, 9, 10, 12, 14, 15]
RIGHT = [0, 2, 3, 6, 9, 10, 11, 13, 15]
SHARED = [0, 3, 9, 10, 15]


def test_intersection_of_archived_vectors(spark, tmp_path):
    both = []
    for name, at in (("a", LEFT), ("b", RIGHT)):
        (tmp_path / name).write_text(compressed_line([(k, 1) for k in at], (16,)))
        both.append(archive.read_compressed(spark, str(tmp_path / name), ("k",)))
    a, b = both
    assert sorted(r.k for r in loops.intersect(a.df, b.df.select("k"), ["k"]).collect()) == SHARED
    assert linalg.dot(a, b).first().v == 5
    assert linalg.dot(a.dense(), b.dense()).first().v == 5 and linalg.dot_in_parts(a, b, 3).first().v == 5


def test_consolidated_statistics(spark, tmp_path):
    (tmp_path / "c.dat").write_text("g one\n10 4 20.0 8\n0 0 0 0\n10 4 20 2\n\nh\n6 0 3 0\n")
    t = statistics.read_consolidated(spark, str(tmp_path / "c.dat"))
    assert sorted(map(tuple, t.collect())) == [("g one", 0, 10, 4, 20, 8), ("g one", 2, 10, 4, 20, 2), ("h", 0, 6, 0, 3, 0)]
    got = {(r.graph, r.schedule): r.ratio for r in statistics.normalised(t, ["graph"], "schedule", "b_offchip", 0).collect()}
    assert got == {("g one", 0): 1.0, ("g one", 2): 0.25, ("h", 0): 0.0}


# files

def test_dense_archive_round_trip(spark, tmp_path):
    t = tensor(spark, np.arange(24).reshape(2, 3, 4), ("a", "b", "c"))
    archive.write_dense(t, str(tmp_path / "t"))
    back = archive.read_dense(spark, str(tmp_path / "t"), ("a", "b", "c"))
    assert (array(back) == np.arange(24).reshape(2, 3, 4)).all()


def test_compressed_archive_round_trip(spark, tmp_path):
    x = np.zeros((4, 5), int)
    x[0, 3], x[2, 1], x[2, 4] = 7, 8, 9
    archive.write_compressed(tensor(spark, x, ("m", "n")), str(tmp_path / "t"))
    back = archive.read_compressed(spark, str(tmp_path / "t"), ("m", "n"))
    assert back.shape == (4, 5) and (array(back) == x).all()


def test_statistics_text(spark, tmp_path):
    (tmp_path / "s.txt").write_text("root:\n  tensor_a:\n    reads: 5\n    updates: 0\n  tensor_b:\n    reads: 7\n")
    got = statistics.with_header(statistics.read_counters(spark, str(tmp_path / "s.txt")))
    assert sorted((r.header, r.name, r.n) for r in got.collect()) == [("tensor_a", "reads", 5), ("tensor_a", "updates", 0), ("tensor_b", "reads", 7)]


# sparse structures

def test_csf(spark):
    x = np.zeros((3, 4, 2), int)
    x[0, 1, 1], x[0, 3, 0], x[2, 1, 0], x[2, 1, 1] = 1, 2, 3, 4
    c = sparse.encode(tensor(spark, x, ("a", "b", "c")))
    assert sorted(map(tuple, c.segments.collect())) == [(0, 0, 0, 2), (1, 0, 0, 2), (1, 1, 2, 3), (2, 0, 0, 1), (2, 1, 1, 2), (2, 2, 2, 4)]
    assert [r.coord for r in c.coords.where("level = 1").orderBy("pos").collect()] == [1, 3, 1]
    assert (array(sparse.decode(c, ("a", "b", "c"))) == x).all()


def test_csf_refuses_duplicates(spark):
    df = spark.createDataFrame([(0, 1), (0, 2)], "m int, v bigint")
    with pytest.raises(ValueError, match="twice"):
        sparse.encode(Tensor(df, ("m",), (1,)))


def test_rows_and_offsets(spark):
    g = Graph(spark.createDataFrame([(0, 2), (2, 0), (2, 1), (2, 3)], "s int, d int"), 5)
    assert [r.off for r in sparse.row_offsets(g).orderBy("v").collect()] == [0, 1, 1, 4, 4, 4]
    assert [r.off for r in sparse.row_offsets(g, by_source=False).orderBy("v").collect()] == [0, 1, 2, 3, 4, 4]


def test_exclusive_sum_over_blocks(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 7).alias("x"))
    got = [r.o for r in sparse.exclusive_sum(df, "i", "x", "o", stride=8).orderBy("i").collect()]
    assert got == [sum(k % 7 for k in range(i)) for i in range(100)]


@pytest.mark.parametrize("form", sorted(sparse.TILED))
def test_tiles_keep_all_edges(spark, form):
    rng = random.Random(0)
    e = sorted({(rng.randrange(50), rng.randrange(50)) for _ in range(200)})
    t = sparse.tiled(Graph(spark.createDataFrame(e, "s int, d int"), 50), form, 8, 16, 2)
    out = []
    for r in t.df.collect():
        r = r.asDict()
        s = r.get("s", (r.get("s2", 0) * 2 + r.get("s1", 0)) * 8 + r.get("s0", 0) if "s2" in r else r.get("s1", 0) * 8 + r.get("s0", 0))
        out.append((s, r["d"] if "d" in r else r["d1"] * 16 + r["d0"]))
    assert sorted(out) == e


def test_tile_sizes():
    assert sparse.tile_sizes(5157, 8) == (1024, 6) and sparse.tile_sizes(10, 8) == (10, 1)


def test_strided_scan(spark):
    x = np.arange(1, 101).reshape(10, 10)
    got = scan.strided(tensor(spark, x, ("a", "b")), (1, 2), (3, 2), (2, 3), order=(1, 0)).collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for b in (2, 5) for a in (1, 3, 5)]


def test_flat_sizes():
    assert scan.flat_sizes((2, 3, 4)) == (12, 4, 1)


# graphs

def _edges():
    rng = random.Random(7)
    return sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)} | {(1, 1), (41, 42), (42, 41)})


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark.createDataFrame([(s, d, (s * 5 + d) % 9 + 1) for s, d in _edges()], "s int, d int, w bigint"), 45)


def test_bfs(g):
    level, parent, front = {0: 0}, {0: 0}, [0]
    while front:
        new = {}
        for s in front:
            for a, b in _edges():
                if a == s and b not in level:
                    new[b] = min(new.get(b, s), s)
        for b, s in new.items():
            level[b], parent[b] = level[s] + 1, s
        front = sorted(new)
    got = {r.v: (r.level, r.parent) for r in graph.bfs(g).collect()}
    assert got == {v: (level.get(v, -1), parent.get(v, -1)) for v in range(45)}
    assert {r.v for r in graph.reachable(g).where("connected = 1").collect()} == set(level)


def test_shortest_paths(g):
    dist = {v: graph.UNREACHED for v in range(45)} | {0: 0}
    for _ in range(45):
        for s, d in _edges():
            if dist[s] < graph.UNREACHED:
                dist[d] = min(dist[d], dist[s] + (s * 5 + d) % 9 + 1)
    assert {r.v: r.dist for r in graph.shortest_paths(g).collect()} == dist


def test_components_of_a_long_path(spark):
    n = 300
    order = random.Random(7).sample(range(n), n)
    rows = [(a, b) for a, b in zip(order, order[1:], strict=False) if a != 5]
    label = list(range(n))
    for _ in range(n):
        for a, b in rows:
            label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in rows):
            break
    got = {r.v: r.label for r in graph.components(Graph(spark.createDataFrame([*rows, (3, 3)], "s int, d int"), n)).collect()}
    assert got == dict(enumerate(label))
    none = graph.components(Graph(spark.createDataFrame([], "s int, d int"), 3))
    assert {(r.v, r.label) for r in none.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_labels_and_sizes(g):
    label = list(range(45))
    for _ in range(45):
        for a, b in _edges():
            m = min(label[a], label[b])
            label[a] = label[b] = m
    got = {r.v: r.label for r in graph.least_labels(g.symmetric()).collect()}
    assert got == dict(enumerate(label))
    assert {r.v: r.label for r in graph.components(g).collect()} == got


def test_triangles(g):
    e = {(a, b) for a, b in _edges() if a != b}
    u = e | {(b, a) for a, b in e}
    count = lambda x: sum((b, c) in x and (c, a) in x for a, b in x for c in range(45) if c not in (a, b))
    assert graph.cycles3(g).first().n == count(e)
    assert graph.triangles(g).first().n == count(u)


def test_nibble_keeps_its_mass(spark, g):
    out = graph.nibble_double(g, spark.createDataFrame([(41,)], "seed int"), most=50)
    total = out.agg(F.sum("rank") + F.sum("residual")).first()[0]
    assert total == pytest.approx(1, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_nibble_double_runs_to_its_fixpoint(spark):
    out = defaultdict(list)
    for s, d in D.order_graph(spark, DATA).edges.select("s", "d").collect():
        out[s].append(d)
    wanted = {}
    for seed in range(3):
        rank, residual, front = defaultdict(float), defaultdict(float, {seed: 1.0}), [seed]
        while front:
            old = {v: residual[v] for v in front}
            for v, r in old.items():
                rank[v] += 2 * 0.15 / 1.15 * r
                residual[v] = 0.0
            for v, r in old.items():
                for d in out[v]:
                    residual[d] += 0.85 / 1.15 * r / len(out[v])
            front = [v for v, r in residual.items() if out[v] and r >= len(out[v]) * 1e-6]
        wanted |= {(seed, v): (rank[v], residual[v]) for v in residual}
    got = {(r.seed, r.v): (r["rank"], r.residual) for r in catalog.nibble_double_fixpoint(spark, DATA).collect()}
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k], abs=2e-9) for k in wanted)


# traces

def _trace(spark, n=400, lines=23, buffers=2):
    rng = random.Random(11)
    rows = [("t", 0, 0, rng.randrange(buffers), i, rng.randrange(lines), rng.randrange(4), rng.choice("RRU")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "tensor string, port int, level int, buffer int, seq bigint, addr bigint, requestor int, kind string").repartition(3)


@pytest.mark.parametrize("size,granularity", [(8, 1), (16, 4), (1, 1), (1000, 1)])
def test_lru(spark, size, granularity):
    rows, df = _trace(spark)
    wanted = {}
    for b in (0, 1):
        held, n = OrderedDict(), {"fill": 0, "allocate": 0, "hit": 0, "evict": 0, "evict dirty": 0}
        for *_, buffer, _, addr, _, kind in rows:
            if buffer != b:
                continue
            at = addr // granularity * granularity
            if at in held:
                n["hit"] += 1
                dirty = held.pop(at)
            else:
                n["fill" if kind == "R" else "allocate"] += 1
                if len(held) == size // granularity:
                    n["evict dirty" if held.popitem(last=False)[1] else "evict"] += 1
                dirty = False
            held[at] = dirty or kind == "U"
        for dirty in held.values():
            n["evict dirty" if dirty else "evict"] += 1
        wanted[b] = (n["fill"], n["allocate"], n["hit"], n["evict"] + n["evict dirty"], n["evict dirty"])
    events = trace.lru(df, size, granularity)
    got = {r.buffer: (r.fills, r.allocations, r.hits, r.backing_reads, r.backing_updates) for r in trace.lru_statistics(events).collect()}
    assert got == wanted
    next_level = trace.backing_trace(events)
    assert next_level.where("kind = 'U'").count() == sum(w[4] for w in wanted.values())
    assert trace.backing_trace(events, keep_dirty=False).where("kind = 'U'").count() == 0


def test_coalescing_by_hand(spark):
    rows = [(0, "R", 5), (1, "R", 5), (1, "R", 5), (0, "R", 6), (1, "R", 5), (2, "U", 5), (2, "U", 5), (3, "R", 5)]
    df = spark.createDataFrame([("t", 0, 0, 0, i, a, r, k) for i, (r, k, a) in enumerate(rows)], "tensor string, port int, level int, buffer int, seq bigint, addr bigint, requestor int, kind string")
    got = [r.coalesced for r in trace.coalesce(df).orderBy("seq").collect()]
    # 1 rides on 0's read; its second read is its own; an update rides once on the line's latest access, then is its own
    assert got == [False, True, False, False, False, True, False, True]


def test_row_buffer_and_rollup(spark):
    _, df = _trace(spark)
    r = trace.row_buffer(df, ["buffer"], 4).agg(F.sum(F.col("row_hits") + F.col("row_misses"))).first()[0]
    assert r == 400
    rows = [sorted(map(tuple, trace.row_buffer(df, ["buffer"], 4, stride).collect())) for stride in (1, 7, 1000)]
    assert rows[0] == rows[1] == rows[2]
    c = df.groupBy(F.col("kind").alias("stat"), "buffer").agg(F.count("*").alias("n"))
    assert sum(x.n for x in trace.statistics_tree(c, ["buffer"]).where("buffer IS NULL").collect()) == 400


def test_compute_ops(spark):
    log = [(0, i, t, k) for i, (t, k) in enumerate([(0, "R"), (1, "R"), (2, "U"), (0, "R"), (0, "R"), (3, "U")])]
    got = trace.compute_ops(spark.createDataFrame(log, "engine int, seq bigint, tensor_id int, kind string")).orderBy("op").collect()
    assert [(r.inputs, r.outputs) for r in got] == [(3, 4), (1, 0), (1, 8)]


def test_binding(spark):
    _, df = _trace(spark, buffers=3)
    names = spark.createDataFrame([("t", 0, 1, "bank7")], "tensor string, level int, buffer int, unit string")
    assert {(r.buffer, r.unit) for r in trace.bind(df, names).select("buffer", "unit").collect()} == {(0, "unit.0.0"), (1, "bank7"), (2, "unit.0.0")}


def test_footprint_of_negative_steps():
    assert footprint.interval(Affine.parse("q-r+3"), {"q": (0, 4), "r": (0, 2)}) == (2, 7)
    assert footprint.index_variables([footprint.Use("A", ("m", "q+s"), 2)]) == [("A", 0, "m"), ("A", 1, "q"), ("A", 1, "s")]


# dataflow, generators, streams

def test_punctuated_groups(spark):
    seq = [(0, None, 1), (1, None, 2), (2, 0, 0), (3, None, 3), (4, 1, 0), (5, None, 4)]
    df = spark.createDataFrame([("s", *x) for x in seq], "k string, seq long, tag int, value int")
    got = [(r.value, r.g0, r.g1) for r in dataflow.groups(df, 2, "k").orderBy("seq").collect()]
    assert got == [(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 2, 1)]


def test_stages(spark):
    def double(it):
        for pdf in it:
            yield pdf.assign(x=pdf.x * 2)

    src = spark.range(10).select(F.col("id").alias("x"))
    a, b = dataflow.fan_out(src, dataflow.node(double, "x long"), lambda df: df.where("x > 6"))
    assert a.agg(F.sum("x")).first()[0] == 90 and b.count() == 3
    both = dataflow.pair(a.withColumn("k", F.col("x")), b.withColumn("k", F.col("x")).select("k"), ["k"])
    assert both.count() == 1
    assert dataflow.run(src, dataflow.node(double, "x long"), dataflow.node(double, "x long"), decoupled=True).agg(F.sum("x")).first()[0] == 180


def test_generators(spark):
    a, b = (generators.random_tensor(spark, ("i", "j"), (20, 10), 3, 9, seed=5) for _ in range(2))
    x = array(a)
    assert (x == array(b)).all() and x.min() >= 3 and x.max() < 9
    m = array(generators.random_tensor(spark, ("i",), (50,), 0, 5, seed=5, monotonic=True))
    assert (np.diff(m) >= 0).all()


def test_long_tail_is_a_run_of_rolls(spark):
    chances = [0.2]
    while len(chances) < 200:
        chances.append(chances[-1] + (1 - chances[-1]) * 0.3 if chances[-1] < 0.9 else chances[-1])
    at_least = np.cumprod(chances)
    draws = [0.999, 0.2, 0.1999, 0.088, 0.0879, 0.03, 0.02, 1e-3, 1e-4]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(draws)], "i int, x double")
    got = [r.n for r in df.select("i", generators.long_tail(F.col("x")).alias("n")).orderBy("i").collect()]
    assert got == [int((at_least > x).sum()) for x in draws]


@pytest.mark.parametrize("name", sorted(generators.DISTRIBUTIONS))
def test_sparse_generator(spark, name):
    made = generators.sparse_graph(spark, 200, 6, name, seed=3)
    deg = [r.out_deg for r in made.degrees().orderBy("v").collect()]
    assert 1 < sum(deg) / 200 < 40 and deg == sorted(deg, reverse=True)


def test_degree_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, 9), (9, k + 1)], "s int, d int").write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = edges.edge_stream(spark, str(tmp_path / "in"), "s int, d int, part int", 1)
    got = {r.v: (r.out_deg, r.in_deg) for r in edges.drain(edges.degrees(stream), "deg_test", str(tmp_path / "cp")).collect()}
    assert got[9] == (3, 3) and got[1] == (1, 1)


def test_checker(spark):
    a, b = tensor(spark, [[1, 0], [0, 2]], ("m", "n")), tensor(spark, [[1, 0], [3, 2]], ("m", "n"))
    assert check.warnings(a, a) == 0 and [tuple(r) for r in check.differences(a, b).collect()] == [(1, 0, 0, 3)]
    with pytest.raises(ValueError, match="shapes"):
        check.differences(a, tensor(spark, [1], ("m",)))


@pytest.mark.parametrize("pull", [1e-9, 1e9])
def test_bfs_pushed_or_pulled(spark, pull):
    rng = np.random.default_rng(7)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2))} | {(k, k + 1) for k in range(60, 75)} | {(39, 60), (0, 39)}
    g = Graph(spark.createDataFrame(sorted(edges), "s int, d int"), 80)
    got = {r.v: (r.level, r.parent) for r in graph.bfs(g, 0, pull=pull).collect()}
    level, now, k = {0: 0}, [0], 0
    while now:
        k += 1
        now = sorted({d for s, d in edges if s in now and d not in level})
        level.update(dict.fromkeys(now, k))
    parent = {v: min(s for s, d in edges if d == v and level.get(s) == level[v] - 1) if v else 0 for v in level}
    assert got == {v: (level.get(v, -1), parent.get(v, -1)) for v in range(80)} and max(level.values()) > 2 * graph.LEVELS - 2


def _accesses(seed, n, lines=12):
    rng = np.random.default_rng(seed)
    return [("t", 0, 0, int(b), k, int(a), int(r), "U" if u < 0.3 else "R") for k, (b, a, r, u) in enumerate(zip(rng.integers(0, 2, n), rng.integers(0, lines * 4, n), rng.integers(0, 3, n), rng.random(n), strict=True))]


ACCESS = "tensor string, port int, level int, buffer int, seq bigint, addr bigint, requestor int, kind string"


@pytest.mark.parametrize("seed,window", [(1, 32), (2, 3), (3, 1)])
def test_coalescing_of_random_traces(spark, seed, window):
    """Each access by a search through all kept accesses before it."""
    rows = _accesses(seed, 400)
    got = {r.seq: r.coalesced for r in trace.coalesce(spark.createDataFrame(rows, ACCESS).repartition(3), 4, window).collect()}
    kept = {0: [], 1: []}  # line, when each requestor was first served and first updated
    for _, _, _, b, seq, addr, who, kind in rows:
        own = kept[b][-window:]
        same = [k for k, x in enumerate(own) if x["line"] == addr // 4]
        rides = False
        if same:
            x, later = own[same[-1]], own[same[-1] + 1 :]
            rides = who not in x["updated"] if kind == "U" else who not in x["served"] and all(who not in y["served"] for y in later)
            if kind == "U":
                x["served"].add(who)
                x["updated"].add(who)
            elif rides:
                x["served"].add(who)
        if not rides:
            kept[b].append({"line": addr // 4, "served": {who}, "updated": {who} if kind == "U" else set()})
        assert got[seq] == rides


def test_chained_levels(spark):
    """Evictions of a level are the next one's accesses, by lists kept in order of use."""
    rows = _accesses(5, 300)
    events = trace.through_levels(spark.createDataFrame(rows, ACCESS).repartition(2), [(16, 4), (32, 8)])
    got = [{r.buffer: tuple(r)[4:] for r in trace.lru_statistics(e).collect()} for e in events]
    for b in (0, 1):
        now = [(r[5], r[7]) for r in rows if r[3] == b]
        for k, (size, g) in enumerate([(16, 4), (32, 8)]):
            held, out, n = [], [], dict.fromkeys(("fill", "allocate", "hit", "evict", "dirty"), 0)
            for addr, kind in now:
                at = addr - addr % g
                old = next((x for x in held if x[0] == at), None)
                if old is None:
                    if len(held) == size // g:
                        out.append(held.pop(0))
                    n["fill" if kind == "R" else "allocate"] += 1
                else:
                    held.remove(old)
                    n["hit"] += 1
                held.append((at, kind == "U" or old is not None and old[1]))
            out += sorted(held)
            n["evict"], n["dirty"] = len(out), sum(x[1] for x in out)
            assert got[k][b] == (n["fill"], n["allocate"], n["hit"], n["evict"], n["evict"], n["dirty"])
            now = [(x[0], kind) for x in out for kind in ("RU" if x[1] else "R")]


# state that stays in place

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_edges_are_not_shuffled_again(spark, monkeypatch):
    """A round's plan, as it is written, has no exchange over the table of edges."""
    plans = []
    whole = storage.save_bucketed

    def seen(df, by, name="table", dealt=False, **counts):
        if dealt and name in ("dist", "labels", "frontier", "rank", "nibble"):
            plans.append(_plan(df))
        return whole(df, by, name, dealt, **counts)

    monkeypatch.setattr(storage, "save_bucketed", seen)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9)) for _ in range(150)]
    graph_ = Graph(spark.createDataFrame(rows, "s int, d int, w bigint").groupBy("s", "d").agg(F.min("w").alias("w")), 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph.shortest_paths(graph_).collect(), graph.least_labels(graph_).collect(), graph.bfs(graph_).collect(), graph.pagerank_delta(graph_, most=3).collect()
        graph.nibble(graph_, spark.createDataFrame([(1,), (2,)], "seed int"), 2).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 8
    for plan in plans:
        lines = plan.split("\n")
        scans_ = [k for k, x in enumerate(lines) if "weft_edges" in x]
        assert scans_ and all("Bucketed: true" in lines[k] for k in scans_)
        for k in scans_:
            # the operators above the scan, up to the first exchange, join it where it lies
            depth = len(lines[k]) - len(lines[k].lstrip(" :+-"))
            above = []
            for x in reversed(lines[:k]):
                d = len(x) - len(x.lstrip(" :+-"))
                if d < depth:
                    depth = d
                    above.append(x)
                if "Join" in x and above and above[-1] is x:
                    break
            assert above and not any("Exchange" in x for x in above)


@pytest.mark.parametrize("hub", [None, 4])
def test_a_hub_with_half_of_all_edges(spark, monkeypatch, hub):
    if hub:
        monkeypatch.setattr(adjacency, "HUB", hub)
    rng = random.Random(6)
    n = 90
    rows = {(0, d): 1 + d % 5 for d in range(1, n)} | {(s, 0): 3 for s in range(1, n, 2)} | {(rng.randrange(n), rng.randrange(n)): rng.randrange(1, 6) for _ in range(60)}
    rows = {(s, d): w for (s, d), w in rows.items() if s != d}
    g = Graph(spark.createDataFrame([(s, d, w) for (s, d), w in rows.items()], "s int, d int, w bigint"), n)
    assert adjacency.Adjacency(g.edges).split == bool(hub)
    dist = {v: graph.UNREACHED for v in range(n)} | {3: 0}
    for _ in range(n):
        for (s, d), w in rows.items():
            if dist[s] < graph.UNREACHED:
                dist[d] = min(dist[d], dist[s] + w)
    assert {r.v: r.dist for r in graph.shortest_paths(g, 3).collect()} == dist
    e = set(rows)
    out = collections.defaultdict(set)
    for s, d in e:
        out[s].add(d)
    assert graph.cycles3(g).first().n == sum(a in out[c] for a, b in e for c in out[b])
    both = e | {(d, s) for s, d in e}
    near = collections.defaultdict(set)
    for s, d in both:
        near[s].add(d)
    assert graph.triangles(g).first().n == sum(len(near[a] & near[b]) for a, b in both)
    assert {r.v: r.label for r in graph.components(g).collect()} == {v: 0 for v in range(n)}
    for pull in (1e-9, 1e9):
        level, front = {3: 0}, {3}
        while front:
            front = {d for s in front for d in out[s] if d not in level}
            level |= {d: max(level.values()) + 1 for d in front}
        assert {r.v: r.level for r in graph.bfs(g, 3, pull=pull).collect()} == {v: level.get(v, -1) for v in range(n)}


@pytest.mark.parametrize("cell,pairs", [(1 << 22, 1 << 20), (40, 7)])
def test_closed_triples_in_cells(spark, monkeypatch, cell, pairs):
    """Cells of few rows, parallel edges and loops."""
    monkeypatch.setattr(graph, "CELL_ROWS", cell)
    monkeypatch.setattr(graph, "PAIRS", pairs)
    rng = random.Random(12)
    rows = [(rng.randrange(25), rng.randrange(25)) for _ in range(260)]
    g = Graph(spark.createDataFrame(rows, "s int, d int"), 25)
    e = {(a, b) for a, b in rows if a != b}
    u = e | {(b, a) for a, b in e}
    count = lambda x: sum((b, c) in x and (c, a) in x for a, b in x for c in range(25))
    assert graph.cycles3(g).first().n == count(e) and graph.triangles(g).first().n == count(u)
    none = Graph(spark.createDataFrame([], "s int, d int"), 3)
    assert graph.cycles3(none).first().n == 0 and graph.triangles(none).first().n == 0


@pytest.mark.parametrize("height,width,held", [(8, 8, 1 << 21), (7, 3, 1), (64, 64, 50)])
def test_block_products(spark, monkeypatch, height, width, held):
    monkeypatch.setattr(blocks, "HELD", held)
    rng = np.random.default_rng(3)
    a = np.where(rng.random((30, 30)) < 0.2, rng.integers(1, 9, (30, 30)), 0)
    a[4] = 5  # a full row and a full column
    a[:, 9] = 2
    g = Graph(spark.createDataFrame([(int(s), int(d), int(a[d, s])) for d, s in zip(*np.nonzero(a), strict=True)], "s int, d int, w bigint"), 30)
    x = rng.integers(0, 50, 30)
    df = spark.createDataFrame([(int(v), int(k)) for v, k in enumerate(x)], "v int, x bigint")
    m = blocks.BlockMatrix.from_graph(g, height, width)
    assert {r.v: r.y for r in m.multiply(df).collect()} == {v: int(y) for v, y in enumerate(a @ x) if a[v].any()}
    for _ in range(3):
        x = a @ x % 101
    assert {r.v: r.x for r in m.rounds(df, 30, 3, 101).collect()} == dict(enumerate(x.tolist()))
    with pytest.raises(Exception, match="64 bits"):
        m.multiply(df.select("v", F.lit(1 << 61).alias("x"))).collect()


def test_products_from_five_levels(spark, g):
    t = sparse.tiled(g, "csc5_dst_tile", 4, 6, 2)
    got = {r.v: r.y for r in blocks.BlockMatrix.from_tiles(t).multiply(g.vertices.select("v", (F.col("v") + 1).alias("x"))).collect()}
    wanted = collections.Counter()
    for s, d in _edges():
        wanted[d] += (s + 1) * ((s * 5 + d) % 9 + 1)
    assert got == wanted
    with pytest.raises(ValueError, match="five"):
        blocks.BlockMatrix.from_tiles(sparse.tiled(g, "csr3", 0, 6))


@pytest.mark.parametrize("stride,levels", [(4, 0), (4, 1), (3, 2), (2, 5), (1000, 2)])
def test_segmented_sums(spark, stride, levels):
    rng = random.Random(stride * 10 + levels)
    rows = [(k, i, rng.random() < 0.15, rng.randrange(-3, 9), rng.choice([None, True, False])) for k in "ab" for i in range(0, 60, rng.choice([1, 2]))]
    df = spark.createDataFrame(rows, "k string, i long, r boolean, v long, q boolean").repartition(3)
    parts = {"x": (F.col("r"), F.col("v")), "y": (F.col("q"), F.lit(1)), "z": (F.lit(False), F.col("v"))}
    for keys in (["k"], []):
        own = rows if keys else [r for r in rows if r[0] == "a"]
        got = {(r.k, r.i): (r.x, r.y, r.z) for r in scans.segmented_sums(df if keys else df.where("k = 'a'"), "i", parts, keys, stride, levels).collect()}
        x, wanted = {}, {}
        for k, i, r, v, q in sorted(own):
            a, b, c = x.get(k, (0, 0, 0))
            wanted[k, i] = a, b, c
            x[k] = v if r else a + v, 1 if q else b + 1, c + v
        assert got == wanted


def test_nested_groups_of_one_stream(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, None, None, 0, 1, 2]), i * 7) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, tag int, value long")
    wanted, g = {}, [0, 0, 0]
    for i, tag, value in rows:
        if tag is None:
            wanted[i] = (value, *g)
        else:
            g = [0 if k < tag else n + (k == tag) for k, n in enumerate(g)]
    out = dataflow.groups(df, 3, nested=True, stride=16)
    assert {r.seq: (r.value, r.g0, r.g1, r.g2) for r in out.collect()} == wanted


@pytest.mark.parametrize("stride", [1, 5, 1000])
def test_points_find_their_ranges(spark, stride):
    rng = random.Random(stride)
    at, ranges = 0, []
    for k in range(30):
        at += rng.choice([0, 0, 3])
        size = rng.choice([0, 1, 2, 40])
        ranges.append((f"r{k}", at, at + size))
        at += size
    points = [(rng.randrange(at + 5), k) for k in range(200)]
    got = sorted(tuple(r) for r in scans.with_owner(spark.createDataFrame(points, "p long, x int"), spark.createDataFrame(ranges, "o string, start long, stop long"), "p", "o", stride).collect())
    assert got == sorted((p, x, o) for p, x in points for o, a, b in ranges if a <= p < b)
    spread = scans.places(spark.createDataFrame(ranges, "o string, start long, stop long"), "o", "i", stride)
    assert sorted(map(tuple, spread.collect())) == sorted((o, i) for o, a, b in ranges for i in range(a, b))


def test_long_ranges_are_dealt_out(spark):
    df = spark.createDataFrame([("hub", 0, 5000), ("none", 7, 7), ("few", 3, 5)], "k string, lo long, hi long")
    out = loops.inner(df, "i", F.col("lo"), F.col("hi"), deal=100)
    assert sorted((r.k, r.i) for r in out.collect()) == sorted([("hub", i) for i in range(5000)] + [("few", 3), ("few", 4)])
    assert out.where("k = 'hub'").groupBy(F.spark_partition_id()).count().count() > 1
    assert sorted(loops.inner(df, "i", F.col("lo"), F.col("hi")).columns) == sorted(out.columns)


def test_tiled_products_keep_sums_of_zero(spark):
    a, b = np.array([[1, 1], [0, 0], [2, 0]]), np.array([[1, 0], [-1, 3]])
    x, y = (Tensor(spark.createDataFrame([(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(t) if v], f"{p} int, {q} int, v long"), (p, q), t.shape) for t, p, q in ((a, "m", "k"), (b, "k", "n")))
    plain = sorted(map(tuple, linalg.matmul(x, y).df.collect()))
    for tile in ((1, 1, 1), (2, 2, 2), (4, 1, 4)):
        assert sorted(map(tuple, linalg.matmul_tiled(x, y, tile).df.collect())) == plain
    assert (0, 0, 0) in plain
    big = Tensor(x.df.select("m", "k", (F.col("v") * (1 << 40)).alias("v")), ("m", "k"), x.shape)
    with pytest.raises(Exception, match="64 bits"):
        linalg.matmul_tiled(big, Tensor(big.df.select(F.col("m").alias("k"), F.col("k").alias("n"), "v"), ("k", "n"), (2, 3)), (2, 2, 2)).df.collect()


# archives in parts

@pytest.fixture
def few_bytes_a_task(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def _compressed(x):
    return compressed_line([(*map(int, at), int(v)) for at, v in np.ndenumerate(x) if v], x.shape)


@pytest.mark.parametrize("blank", [" ", "  ", " \n"])
def test_archives_are_read_in_several_tasks(spark, tmp_path, few_bytes_a_task, blank):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((6, 30, 9)) < 0.3, rng.integers(-99, 99, (6, 30, 9)), 0)
    (tmp_path / "a").write_text(_compressed(x).replace(" ", blank) + "\n")
    back = archive.read_compressed(spark, str(tmp_path / "a"), ("a", "b", "c"))
    assert back.shape == x.shape and (array(back) == x).all()
    dense = " ".join(map(str, [*archive.HEAD, 0, 0, 3, 0, *x.shape[::-1], x.size, 0, *x.ravel().tolist()]))
    (tmp_path / "d").write_text(dense.replace(" ", blank))
    line = archive.Tokens(spark, str(tmp_path / "d"))
    assert len(line.splits) > 3
    assert (array(archive.read_dense(spark, str(tmp_path / "d"), ("a", "b", "c"))) == x).all()


def test_archives_are_written_in_parts(spark, tmp_path, few_bytes_a_task):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 25)) < 0.4, rng.integers(1, 999, (40, 25)), 0)
    t = tensor(spark, x, ("m", "n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        archive.write_compressed(t.nonzero(), str(tmp_path / "c"))
        archive.write_dense(t, str(tmp_path / "d"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = sorted((tmp_path / "c").glob("part-*"))
    assert len(parts) > 1 and "".join(p.read_text() for p in parts).split() == _compressed(x).split()
    assert (array(archive.read_compressed(spark, str(tmp_path / "c"), ("m", "n"))) == x).all()
    assert len(list((tmp_path / "d").glob("part-*"))) > 1
    assert (array(archive.read_dense(spark, str(tmp_path / "d"), ("m", "n"))) == x).all()


def test_archive_tokens_carry_no_names(spark, tmp_path, few_bytes_a_task):
    """A token is numbers, whatever the files' sizes; files that share tasks in another order than that of their names are still read in order."""
    words = [*archive.HEAD, *map(str, np.random.default_rng(6).integers(-999, 999, 700).tolist())]
    cuts = [0, 3, 400, 405, 600, 703]
    (tmp_path / "a b").mkdir()
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / "a b" / f"part-{k}.txt").write_text(" ".join(words[lo:hi]) + " ")
    line = archive.Tokens(spark, str(tmp_path / "a b"))
    assert len(line.splits) > 5
    assert dict(line.rows.dtypes) == {"id": "bigint", "file": "bigint", "start": "bigint", "v": "bigint", "t": "string"}
    assert [r.t for r in line.rows.where("t IS NOT NULL").collect()] == archive.HEAD[1:2]
    got = dict(line.section(3, 700, "p", "x").collect())
    assert [str(got[k]) for k in range(700)] == words[3:] and [line.word(k) for k in range(703)] == words


def test_owners_with_values_beside(spark):
    """Points, the owners of their ranges and the values at their places meet in one shuffle."""
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(int(p), int(p) * 3) for p in rng.permutation(200)], "p long, x long")
    beside = spark.createDataFrame([(int(p), int(p) * 5) for p in rng.permutation(250) if p % 7], "p long, y long")
    ranges = spark.createDataFrame([(0, 0, 50), (1, 50, 50), (2, 60, 190)], "o long, start long, stop long")
    got = scans.with_owner(points, ranges, "p", "o", 16, beside)
    wanted = [(p, 3 * p, 5 * p, 0 if p < 50 else 2) for p in range(190) if p % 7 and not 50 <= p < 60]
    assert sorted(map(tuple, got.select("p", "x", "y", "o").collect())) == wanted
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_archive_of_no_entries(spark, tmp_path):
    t = Tensor(spark.createDataFrame([], "m int, n int, v long"), ("m", "n"), (4, 5))
    archive.write_compressed(t, str(tmp_path / "c"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))).split() == compressed_line([], (4, 5)).split()
    back = archive.read_compressed(spark, str(tmp_path / "c"), ("m", "n"))
    assert back.shape == (4, 5) and back.df.count() == 0
    for bad in ("", "22 serialization::archive 15 0 0 2 0 5", "1 2 3"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(ValueError, match="archive"):
            archive.read_dense(spark, str(tmp_path / "bad"), ("m", "n"))


@pytest.mark.parametrize("stretch,before", [(8, 3), (40, 40), (1000, 1)])
def test_coalescing_in_stretches(spark, stretch, before):
    """Stretches that begin with a wrong guess are done again until states meet; buffers without a name and gaps of seq are allowed."""
    rows = [(None if b else "t", p, n, b, seq * (1 if seq < 150 else 5), *rest) for t, p, n, b, seq, *rest in _accesses(4, 240, 3)]
    df = spark.createDataFrame(rows, ACCESS).repartition(3)
    whole = sorted(map(tuple, trace.coalesce(df, 4, 5, 1 << 20).withColumn("tensor", F.coalesce("tensor", F.lit(""))).collect()))
    got = sorted(map(tuple, trace.coalesce(df, 4, 5, stretch, before).withColumn("tensor", F.coalesce("tensor", F.lit(""))).collect()))
    assert got == whole and len(got) == 240 and {r[-1] for r in got} == {True, False}


def test_a_cell_of_the_cube_is_packed_batch_by_batch():
    """A task that counts triangles keeps eight bytes a row of what it has read, not the batches."""
    rng = np.random.default_rng(3)
    alive, most, all_rows = [], 0, []

    def batches():
        nonlocal most
        for _ in range(40):
            s, d, kind = (rng.integers(0, n, 500).astype(np.int32) for n in (90, 90, 3))
            all_rows.extend(zip(kind.tolist(), s.tolist(), d.tolist(), strict=True))
            b = pa.RecordBatch.from_arrays([pa.array(s), pa.array(d), pa.array(kind)], names=["s", "d", "kind"])
            alive.append(weakref.ref(b))
            yield b
            del b
            most = max(most, sum(r() is not None for r in alive))

    got = graph._cell(batches())
    assert most <= 2
    assert [[(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in side] for side in got] == [sorted({(s, d) for k, s, d in all_rows if k == kind}) for kind in range(3)]


def test_rows_that_a_fiber_scan_needs(spark):
    """Only rows that the table function doesn't skip go to it, and its result is the same: sums may fall, values may be null."""
    fibers.register(spark)
    rng = random.Random(2)
    rows = [(m, n, rng.choice([None, -9, 3, 10, 25])) for m in [None, *range(12)] for n in rng.sample(range(200), 80)] + [(50, 1, 90), (51, 1, None)]
    df = spark.createDataFrame(rows, "m int, n int, v long").repartition(3)
    some = fibers.needed(df, ["m"], ["n"], "v", 60)
    scanned = []
    for name, t in (("weft_whole", df), ("weft_needed", some)):
        t.createOrReplaceTempView(name)
        scanned.append(sorted(map(str, spark.sql(f"SELECT * FROM fiber_scan(TABLE({name}) PARTITION BY (m) ORDER BY (n), 'v', 60)").collect())))
    assert scanned[0] == scanned[1] and some.count() == len(scanned[0]) < len(rows) / 2


# streams with state

def test_open_groups_over_batches_and_restarts(spark, tmp_path):
    """Each batch is a query of its own that goes on from the checkpoint; rows come in any order within what may be late, and too late ones go."""
    rng = random.Random(9)
    rows = [(i % 2, i, 1000 + i, rng.choice([None, None, None, 0, 1]), i * 3) for i in range(120)]
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "key long, seq long, ts timestamp, tag int, value long"

    def feed(part):
        spark.createDataFrame(part, "key long, seq long, t long, tag int, value long").select("key", "seq", F.timestamp_seconds("t").alias("ts"), "tag", "value").coalesce(1).write.mode("append").parquet(source)
        return groups.run(groups.ended(spark.readStream.schema(schema).parquet(source), 2, "25 seconds"), out, cp)

    for k in range(6):
        own = rows[20 * k : 20 * k + 20]
        rng.shuffle(own)
        feed(own if k < 5 else [*own, (0, 9999, 1001, 0, 1)])  # the last row is far too late
    got = feed([(0, 500, 2000, None, None), (1, 500, 2000, None, None)])
    wanted = []
    for key in (0, 1):
        state = [[0, 0, 0], [0, 0, 0]]
        for _, _, _, tag, value in (r for r in rows if r[0] == key):
            for k, s in enumerate(state):
                if tag is None:
                    s[1], s[2] = s[1] + 1, s[2] + value
                elif k <= tag:
                    wanted.append((key, k, *s))
                    s[:] = [s[0] + 1, 0, 0]
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


class _State:
    """A key's state of all kinds, kept in a dictionary."""

    def __init__(self):
        self.kept, self.timers = {}, []

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: name in self.kept, get=lambda: self.kept[name], update=lambda x: self.kept.update({name: x}), clear=lambda: self.kept.pop(name, None))

    def getMapState(self, name, key, schema):
        return SimpleNamespace(getValue=self.kept.get, updateValue=lambda k, x: self.kept.update({k: x}), removeKey=self.kept.pop)

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_waiting_rows_are_merged_from_pages(monkeypatch):
    """Rows of a key that wait come back a page of each run at a time, and none stays behind."""
    monkeypatch.setattr(groups, "RUN", 200)
    monkeypatch.setattr(groups, "PAGE", 16)
    rng = random.Random(5)
    rows = [(1000 + i // 3, i, rng.choice([None, None, 0, 1, 2]), rng.choice([None, i])) for i in range(3000)]
    fed = rows[:]
    rng.shuffle(fed)
    state, p, pieces = _State(), groups.OpenGroups(2), []
    p.init(state)
    due = p._due
    monkeypatch.setattr(p, "_due", lambda *a: (pieces.append(x.shape[1]) or x for x in due(*a)))
    for k in range(0, 3000, 1000):
        frames = (pd.DataFrame(fed[i : i + 50], columns=["ms", "seq", "tag", "value"]) for i in range(k, k + 1000, 50))
        assert list(p.handleInputRows((7,), frames, None)) == [] and state.timers[-1] == min(r[0] for r in fed[k : k + 1000])
    got = []
    for upto in (900, 1000, 1001, 1400, 1400, 2000):
        for out in p.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda upto=upto: upto), None):
            got += out.itertuples(index=False, name=None)
        assert upto == 900 or upto == 2000 or state.timers[-1] == upto + 1
    wanted, open_ = [], [[0, 0, 0], [0, 0, 0]]
    for _, _, tag, value in rows:
        for k, s in enumerate(open_):
            if tag is None:
                s[1], s[2] = s[1] + 1, s[2] + (value or 0)
            elif k <= tag:
                wanted.append((7, k, *s))
                s[:] = [s[0] + 1, 0, 0]
    assert sorted(got) == sorted(wanted) and set(state.kept) == {"open"}
    assert sum(pieces) == 3000 and max(pieces) <= 15 * 16


# storage in cells

def _files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().get("numFiles").get().value()


def test_a_box_reads_few_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.where(rng.random((70, 130)) < 0.5, rng.integers(1, 99, (70, 130)), 0)
    t = tensor(spark, x, ("m", "n"))
    stored = clustered.Clustered.write(t, str(tmp_path / "t"), 64)
    for base, count, stride in (((3, 5), (6, 4), (2, 3)), ((0, 0), (70, 130), (1, 1)), ((60, 120), (9, 9), (4, 4)), ((0, 0), (2, 2), (64, 100)), ((-4, 2), (5, 1), (3, 1)), ((69, 129), (1, 1), (1, 1)), ((80, 0), (2, 2), (1, 1))):
        got = sorted(map(tuple, stored.scan(spark, base, count, stride).collect()))
        assert got == sorted(map(tuple, scan.strided(t, base, count, stride).collect()))
        points = {(b0, b1) for b0 in range(base[0], base[0] + count[0] * stride[0], stride[0]) for b1 in range(base[1], base[1] + count[1] * stride[1], stride[1]) if 0 <= b0 < 70 and 0 <= b1 < 130}
        cells = {clustered.z_number([p >> s for p, s in zip(at, stored.shift, strict=True)], stored.bits) for at in points}
        assert cells == set(stored.cells(base, count, stride)) or cells < set(stored.cells(base, count, stride)) and max(stride) < 1 << max(stored.shift)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        every = _files_read(spark.read.parquet(str(tmp_path / "t")))
        assert _files_read(stored.scan(spark, (3, 5), (6, 4), (2, 3))) * 8 < every
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_order_of_a_scan(spark):
    t = tensor(spark, np.arange(1, 201).reshape(20, 10), ("m", "n"))
    good = scan.strided(t, (0, 0), (20, 10), (1, 1), order=(1, 0))
    assert clustered.out_of_order(good, "n", "m") == 0 and clustered.out_of_order(good, "m", "n") > 0
    assert clustered.out_of_order(t.df.where("false"), "m") == 0


@pytest.mark.parametrize("n,k,piece", [(50, 1, 16), (200, 70, 16), (300, 300, 64), (129, 33, 1 << 14)])
def test_long_kernels(spark, n, k, piece):
    rng = np.random.default_rng(n)
    x, w = rng.integers(-10**6, 10**6, n), rng.integers(-10**6, 10**6, k)
    x[rng.random(n) < 0.5] = 0
    got = longconv.conv1d(tensor(spark, x, ("i",)), tensor(spark, w, ("s",)), piece)
    assert got.shape == (n - k + 1,) and {r.q: r.v for r in got.df.collect()} == dict(enumerate(np.correlate(x, w, "valid").tolist()))


def test_long_kernels_raise_before_they_are_wrong(spark):
    x = tensor(spark, np.full(20, 10**9), ("i",))
    with pytest.raises(OverflowError):
        longconv.conv1d(x, x)
    with pytest.raises(ValueError, match="longer"):
        longconv.conv1d(x, tensor(spark, np.ones(21, int), ("s",)))


def test_transforms():
    rng = np.random.default_rng(1)
    for p, root in longconv.PRIMES:
        x = rng.integers(0, p, (3, 64))
        assert (longconv.transform(longconv.transform(x, p, root), p, root, True) == x).all()
    a, b = rng.integers(-9, 9, 32), rng.integers(-9, 9, 32)
    assert longconv.cyclic(a, b).tolist() == [sum(int(a[i] * b[(k - i) % 32]) for i in range(32)) for k in range(32)]


def test_fiber_scan_in_sql(spark):
    fibers.register(spark)
    spark.createDataFrame([("x", i, 10) for i in range(50)] + [("y", 5, 1), ("z", 3, None), ("z", 1, 70)], "m string, n int, v long").createOrReplaceTempView("weft_fibers")
    got = spark.sql("SELECT * FROM fiber_scan(TABLE(weft_fibers) PARTITION BY (m) ORDER BY (n), 'v', 30)").collect()
    assert sorted(map(tuple, got)) == [("x", 0, 10, 0, 10), ("x", 1, 10, 1, 20), ("x", 2, 10, 2, 30), ("y", 5, 1, 0, 1), ("z", 1, 70, 0, 70)]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM fiber_scan(TABLE(weft_fibers) PARTITION BY (m), 'w', 30)").collect()


@pytest.mark.parametrize("salts", [1, 3, 8])
def test_products_with_few_inner_indices(spark, salts):
    rng = np.random.default_rng(2)
    x, y = rng.integers(-5, 5, (9, 2)), rng.integers(-5, 5, (2, 30))
    for a, b in ((x, y), (y.T, x.T)):
        got = linalg.matmul(tensor(spark, a, ("m", "k"), True), tensor(spark, b, ("k", "n"), True), 3, salts)
        assert (array(got) == 3 * a @ b).all()


def test_tiles_are_visited_in_order(spark, g):
    got = sorted(map(tuple, sparse.visit_tiles(g, 6, 7).collect()))
    tiles = sorted({(s // 6, d // 7) for s, d in _edges()})
    cursor = collections.Counter()
    wanted = []
    for s, d in _edges():
        wanted.append((tiles.index((s // 6, d // 7)), s // 6, d // 7, s, d, (s * 5 + d) % 9 + 1, cursor[s]))
        cursor[s] += 1
    assert got == sorted(wanted)


def test_small_inputs_have_few_partitions(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    small, key = spark.read.parquet(str(tmp_path / "t")), "spark.sql.shuffle.partitions"
    have = spark.conf.get(key)
    spark.conf.set(key, "200")
    try:
        with storage.partitions_for(small) as n:
            assert n == spark.sparkContext.defaultParallelism == int(spark.conf.get(key))
        with pytest.raises(ValueError), storage.partitions_for(small, 7):
            assert spark.conf.get(key) == "7"
            raise ValueError
        assert spark.conf.get(key) == "200"
        with storage.partitions_for(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "x int")) as n:
            assert n == 200  # of unknown size
    finally:
        spark.conf.set(key, have)


# sides and pieces whose size no estimate knows

def _broadcasts(df):
    df.collect()
    return _plan(df).split("Initial Plan")[0].count("BroadcastHashJoin")


def test_pieces_of_ranges_do_not_grow_with_their_length(spark, monkeypatch):
    monkeypatch.setattr(loops, "PIECES", 2)
    df = spark.createDataFrame([(k, k, k + 40_000) for k in range(10)], "k long, lo long, hi long")
    out = loops.inner(df, "i", F.col("lo"), F.col("hi"), deal=16)
    assert sorted(map(tuple, out.groupBy("k").agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).collect())) == [(k, 40_000, 40_000, k, k + 39_999) for k in range(10)]
    out.collect()
    dealt = [int(w.metrics().get("shuffleRecordsWritten").get().value()) for w in _nodes(out, "ShuffleExchange")]
    assert len(dealt) == 1 and dealt[0] <= 2 * 10 + 2 * 4  # 25,000 by pieces of 16


def _nodes(df, name):
    """Nodes of the executed plan by name, those inside finished stages included."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName().startswith(name):
            found.append(node)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_segments_are_not_spread_out(spark):
    rng = np.random.default_rng(7)
    x = np.where(rng.random((3, 4000)) < 0.7, rng.integers(1, 99, (3, 4000)), 0)
    t = tensor(spark, x, ("m", "n"))
    back = sparse.decode(sparse.encode(t), t.index)
    assert (array(back) == x).all()
    assert "sequence(start" not in _plan(back.df)


def test_einsum_broadcasts_by_extents(spark, monkeypatch):
    a, b = np.arange(1, 41).reshape(8, 5), np.arange(1, 31).reshape(5, 6)
    run = lambda: einsum("Z[m,n] += A[m,k] * B[k,n]", {"A": tensor(spark, a, ("m", "k")), "B": tensor(spark, b, ("k", "n"))})
    few = run()
    assert _broadcasts(few.df) == 1 and (array(few) == a @ b).all()
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 100)
    many = run()
    assert _broadcasts(many.df) == 0 and (array(many) == a @ b).all()


def test_long_kernels_ship_each_value_a_fixed_number_of_times(spark):
    rng = np.random.default_rng(4)
    n, k = 6000, 2000
    df = lambda x, c: Tensor(spark.createDataFrame(list(enumerate(x.tolist())), f"{c} int, v bigint"), (c,), (len(x),))
    x, w = rng.integers(-99, 99, n), rng.integers(-99, 99, k)
    got = longconv.conv1d(df(x, "i"), df(w, "s"), 16).df
    assert {r.q: r.v for r in got.collect()} == dict(enumerate(np.correlate(x, w, "valid").tolist()))
    shipped = sum(int(e.metrics().get("dataSize").get().value()) for e in _nodes(got, "ShuffleExchange"))
    assert shipped < 200 * (n + k)  # with a copy of the inputs for each piece of the taps, 125 times the inputs' rows


def test_empty_tiles_are_not_shuffled(spark):
    g = Graph(spark.createDataFrame([(0, 5), (0, 6), (99, 399), (399, 0), (200, 200)], "s int, d int"), 400)
    got = sparse.tile_mask(g, 4, 2, 64)
    full = {(s // 4, d // 2) for s, d in ((0, 5), (0, 6), (99, 399), (399, 0), (200, 200))}
    assert sorted(map(tuple, got.collect())) == [(a, b, (a, b) not in full) for a in range(100) for b in range(200)]
    moved = [int(e.metrics().get("shuffleRecordsWritten").get().value()) for e in _nodes(got, "ShuffleExchange")]
    assert sum(moved) < 2000  # of 20,000 tiles


def test_forms_sum_rows_where_they_lie(spark):
    df = catalog.queries()["spmv_forms"](spark, DATA)
    df.collect()
    edges = D.order_graph(spark, DATA).edges.count()
    moved = [int(e.metrics().get("shuffleRecordsWritten").get().value()) for e in _nodes(df, "ShuffleExchange")]
    assert moved and max(moved) < edges / 2


def test_sparse_graphs_have_few_blocks(spark):
    n = 20_000
    g = Graph(spark.range(40_000).select((F.col("id") * 7919 % n).cast("int").alias("s"), (F.col("id") * 104_729 % n).cast("int").alias("d"), (F.col("id") % 9).alias("w")), n)
    m = blocks.BlockMatrix.from_graph(g)
    assert m.blocks.edges.count() <= 8  # 400 of 1024 by 1024
    x = g.vertices.select("v", (F.col("v") % 7 + 1).alias("x"))
    wanted = g.edges.groupBy("d").agg(F.sum(F.col("w") * (F.col("s") % 7 + 1)).alias("y")).collect()
    assert {r.v: r.y for r in m.multiply(x).collect()} == {r.d: r.y for r in wanted}


def test_ranks_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(sparse, "SORTED", 100)
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = sparse.ranked(rows, ["k"], "at")
    assert sorted(map(tuple, got.select("k", "at").collect())) == [(k, k) for k in range(1000)]
    assert len(got.inputFiles()) >= 5  # a file per task
