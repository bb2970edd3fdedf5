"""Every query of the library, by name, with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark import check, storage
from weftspark.functions import reductions as R
from weftspark.functions import scalar as S
from weftspark.model import Graph, Tensor
from weftspark.operators import blocks, conv, dataflow, fibers, footprint, graph, linalg, longconv, loops, scan, sparse, trace
from weftspark.operators.einsum import einsum
from weftspark.plans import sql as Q
from weftspark.sources import archive, clustered, statistics
from weftspark.sources import driver as D
from weftspark.streaming import edges, groups

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "events").select("event_id", (F.floor("value") - 200).cast("bigint").alias("a"), (F.col("user_id") % 7 + 1).cast("bigint").alias("b"))


_PAIRS = "WITH p AS (SELECT event_id, floor(value)::BIGINT - 200 AS a, user_id % 7 + 1 AS b FROM events) "


@query(_PAIRS + "SELECT event_id, a + b AS add_, a - b AS subtract_, a * b AS multiply_, a // b AS divide_, a::DOUBLE / b::DOUBLE AS quotient_, a % b AS modulo_, b AS second_, a + 1 AS increment_ FROM p")
def scalar_arithmetic(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("event_id", S.add(a, b).alias("add_"), S.subtract(a, b).alias("subtract_"), S.multiply(a, b).alias("multiply_"), S.divide(a, b).alias("divide_"), S.divide_double(a, b).alias("quotient_"), S.modulo(a, b).alias("modulo_"), S.second(a, b).alias("second_"), S.increment(a).alias("increment_"))


@query(_PAIRS + "SELECT event_id, (a = b)::BIGINT AS eq_, (a::INT = b::INT)::BIGINT AS int_eq_, (a <> b)::BIGINT AS ne_, (a >= b)::BIGINT AS ge_, (a <= b)::BIGINT AS le_, (a > b)::BIGINT AS gt_, (a < b)::BIGINT AS lt_, (a <> 0 AND b - 1 <> 0)::BIGINT AS and_, (a <> 0 OR b - 1 <> 0)::BIGINT AS or_, a & b AS bit_and_, a | b AS bit_or_ FROM p")
def scalar_logic(spark, d):
    a, b = F.col("a"), F.col("b")
    named = {"eq_": S.eq, "int_eq_": S.int_eq, "ne_": S.ne, "ge_": S.ge, "le_": S.le, "gt_": S.gt, "lt_": S.lt, "bit_and_": S.bit_and, "bit_or_": S.bit_or}
    return _pairs(spark, d).select("event_id", *[f(a, b).alias(n) for n, f in named.items()], S.logical_and(a, b - 1).alias("and_"), S.logical_or(a, b - 1).alias("or_"))


@query(_PAIRS + "SELECT event_id, a + b AS plus, a - b AS minus, a * b AS times, a // b AS over, (a <> 0 AND b <> 0)::BIGINT AS both_, (a <> 0 OR b <> 0)::BIGINT AS either_ FROM p")
def assign_operators(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("event_id", *[S.ASSIGN[o](a, b).alias(n) for o, n in (("+=", "plus"), ("-=", "minus"), ("*=", "times"), ("/=", "over"), ("&=", "both_"), ("|=", "either_"))])


@query(_PAIRS + "SELECT b, sum(a)::BIGINT AS total, -sum(a)::BIGINT AS less, min(a) AS least, max(a) AS most, bool_and(a <> 0)::BIGINT AS every_, bool_or(a <> 0)::BIGINT AS some_, arg_min(a, event_id) AS first_, arg_max(a, event_id) AS last_, count(*) AS n, avg(a) AS mean FROM p GROUP BY b")
def update_assign(spark, d):
    a, o = F.col("a"), F.col("event_id")
    return _pairs(spark, d).groupBy("b").agg(R.total(a).alias("total"), R.less(a).alias("less"), F.min(a).alias("least"), F.max(a).alias("most"), R.every(a).alias("every_"), R.some(a).alias("some_"), R.first_by(a, o).alias("first_"), R.last_by(a, o).alias("last_"), F.count(a).alias("n"), F.avg(a).alias("mean"))


@query("SELECT o_custkey, product(o_orderkey % 3 + 1)::BIGINT AS v FROM orders GROUP BY o_custkey")
def update_product(spark, d):
    return D.table(spark, d, "orders").groupBy("o_custkey").agg(R.product(F.col("o_orderkey") % 3 + 1).alias("v"))


@query(_PAIRS + "SELECT event_id, CASE WHEN a < 0 THEN -1 WHEN a < 100 THEN b WHEN b > 3 THEN a ELSE 0 END AS v FROM p")
def else_if_chain(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("event_id", loops.choose((a < 0, F.lit(-1).cast("bigint")), (S.lt(a, 100), b), (b > 3, a), otherwise=F.lit(0).cast("bigint")).alias("v"))


@query("SELECT i.range::INT AS i, j.range::INT AS j, k.range::INT AS k FROM range(2, 9) i, range(0, 5) j, range(3, 4) k")
def loop_nest(spark, d):
    return loops.domain(spark, i=(2, 9), j=(0, 5), k=(3, 4))


@query(Q.with_(Q.GRAPH) + "SELECT s, row_number() OVER (PARTITION BY s ORDER BY d) - 1 AS pos, d FROM e")
def loop_over_rows(spark, d):
    """Data-dependent bounds: offsets from degrees, and each row's range opened again."""
    g = sparse.with_positions(D.order_graph(spark, d))
    off = sparse.row_offsets(g)
    starts = off.withColumnRenamed("v", "s")
    flat = g.edges.join(starts, "s").select((F.col("off") + F.col("pos")).alias("pos"), F.col("d").alias("t"))
    back = Graph.from_rows(off, flat, g.n)
    return back.edges.join(starts, "s").select("s", (F.col("pos") - F.col("off")).alias("pos"), "d")


@query(Q.with_(Q.GRAPH) + "SELECT d, min(s) AS s FROM e WHERE w > 8 GROUP BY d")
def loop_first_match(spark, d):
    return loops.first_match(D.order_graph(spark, d).edges, ["d"], F.col("w") > 8, F.col("s"), "s")


@query("SELECT event_id, (event_id % 16 // 4) % 4 AS wide, event_id % 3 AS narrow FROM events")
def spatial_buffers(spark, d):
    e = D.table(spark, d, "events").select("event_id")
    e = loops.spatial(e, 8, "event_id")
    return e.select("event_id", loops.buffer_index(F.col("event_id") % 16, 16, 4).cast("bigint").alias("wide"), loops.buffer_index(F.col("event_id") % 3, 3, 4).cast("bigint").alias("narrow"))


@query("SELECT l_orderkey * 7 + l_linenumber % 7 AS flat, l_orderkey AS row, (l_linenumber % 7)::INT AS col FROM lineitem")
def flatten_index(spark, d):
    x = D.table(spark, d, "lineitem").select(scan.flat([F.col("l_orderkey"), F.col("l_linenumber") % 7], (1 << 40, 7)).alias("flat"))
    row, col = F.floor(F.col("flat") / 7).cast("bigint").alias("row"), scan.unflat(F.col("flat"), ("r", "col"), (1 << 40, 7))[1]
    return x.select("flat", row, col)


@query(Q.with_(Q.EV) + "SELECT sum(a.v * b.v)::BIGINT AS v FROM ev a JOIN ev b ON a.i = b.i")
def dot_dense(spark, d):
    a = D.event_vector(spark, d)
    return linalg.dot(a, a)


_ROWS2 = ", ".join(f"{c} AS (SELECT l_orderkey AS n, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1)" for c, f in (("x", "A"), ("y", "R")))


def _two_rows(spark, d) -> tuple[Tensor, Tensor]:
    """Quantities by order, of lines with either return flag: two sparse vectors."""
    x = D.table(spark, d, "lineitem")
    n = int(x.agg(F.max("l_orderkey") + 1).first()[0])
    return tuple(Tensor(x.where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("n")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v")), ("n",), (n,)) for f in "AR")


@query(Q.with_(_ROWS2) + "SELECT coalesce(sum(x.v * y.v), 0)::BIGINT AS v FROM x JOIN y USING (n)")
def dot_sparse(spark, d):
    return linalg.dot(*_two_rows(spark, d))


@query(Q.with_(_ROWS2) + "SELECT n, x.v AS a, y.v AS b FROM x JOIN y USING (n)")
def intersect_fibers(spark, d):
    x, y = _two_rows(spark, d)
    return loops.intersect(x.df.withColumnRenamed("v", "a"), y.df.withColumnRenamed("v", "b"), ["n"])


@query(Q.with_(_ROWS2) + "SELECT n, x.v AS a, y.v AS b FROM x FULL JOIN y USING (n)")
def union_fibers(spark, d):
    x, y = _two_rows(spark, d)
    return loops.union(x.df.withColumnRenamed("v", "a"), y.df.withColumnRenamed("v", "b"), ["n"])


@query(Q.with_(Q.SUP) + "SELECT m, n, v FROM sup WHERE m IN (SELECT m FROM sup GROUP BY m HAVING sum(v) >= (SELECT sum(v) FROM sup) / (SELECT count(DISTINCT m) FROM sup))")
def scan_fibers(spark, d):
    """The fibers of suppliers with an average total or more."""
    t = D.supply_matrix(spark, d)
    totals = t.df.groupBy("m").agg(F.sum("v").alias("_t"))
    parents = totals.crossJoin(F.broadcast(totals.agg(F.avg("_t").alias("_a")))).where("_t >= _a").select("m")  # one row
    return loops.scan(t.df, parents, ["m"]).select("m", "n", "v")


@query(Q.with_(Q.EV) + "SELECT sum(v * (v % 13))::BIGINT AS v FROM ev")
def fully_connected(spark, d):
    a = D.event_vector(spark, d)
    return linalg.dot(a, a.transform(F.col("v") % 13))


@query(Q.with_(Q.EV) + "SELECT sum(v * (v % 13))::BIGINT AS v FROM ev")
def fully_connected_parallel(spark, d):
    a = D.event_vector(spark, d)
    return linalg.dot_in_parts(a, a.transform(F.col("v") % 13), 16)


def _part_sizes(spark, d) -> tuple[Tensor, Tensor]:
    """Customers per nation, and parts per size."""
    c = D.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("a")).agg(F.count(F.lit(1)).alias("v"))
    p = D.table(spark, d, "part").groupBy(F.col("p_size").cast("int").alias("b")).agg(F.count(F.lit(1)).alias("v"))
    return Tensor(c, ("a",), (25,)), Tensor(p, ("b",), (51,))


@query("WITH x AS (SELECT c_nationkey AS a, count(*) AS v FROM customer GROUP BY 1), y AS (SELECT p_size AS b, count(*) AS v FROM part GROUP BY 1) SELECT a, b, x.v * y.v AS v FROM x, y")
def outer_product(spark, d):
    return linalg.outer(*_part_sizes(spark, d)).df


_GRAM = "g AS (SELECT x.k AS m, y.k AS n, sum(x.v * y.v)::BIGINT AS v FROM a x JOIN a y ON x.m = y.m GROUP BY ALL)"


def _gram(spark, d) -> Tensor:
    a = D.embedding_matrix(spark, d)
    t = Tensor(a.df.select(F.col("k").alias("m"), F.col("m").alias("k"), "v"), ("m", "k"), a.shape[::-1])
    return linalg.matmul(t, Tensor(a.df.select(F.col("m").alias("k"), F.col("k").alias("n"), "v"), ("k", "n"), a.shape))


@query(Q.with_(Q.EMB, _GRAM) + "SELECT m, n, v FROM g")
def matmul_gram(spark, d):
    return _gram(spark, d).df


_MM = Q.with_(Q.EMB, _GRAM, "z AS (SELECT a.m, g.n, sum(a.v * g.v)::BIGINT AS v FROM a JOIN g ON a.k = g.m GROUP BY ALL)")


def _operands(spark, d) -> tuple[Tensor, Tensor]:
    return D.embedding_matrix(spark, d), _gram(spark, d).rename("k", "n")


@query(_MM + "SELECT m, n, v FROM z")
def matmul(spark, d):
    return linalg.matmul(*_operands(spark, d)).df


@query(_MM + "SELECT m, n, v FROM z")
def matmul_tiled(spark, d):
    return linalg.matmul_tiled(*_operands(spark, d), (128, 32, 32)).df


def _fused(form: str, tile=None):
    return lambda spark, d: dataflow.multiply_then_scale(*_operands(spark, d), 17, form, tile).df


for _form in ("fused", "decoupled", "staged"):
    _QUERIES[f"mm_scale_{_form}"] = _fused(_form)
    _SQL[f"mm_scale_{_form}"] = _MM + "SELECT m, n, v * 17 AS v FROM z"
    _QUERIES[f"mm_scale_{_form}_tiled"] = _fused(_form, (128, 32, 32))
    _SQL[f"mm_scale_{_form}_tiled"] = _MM + "SELECT m, n, v * 17 AS v FROM z"


@query(Q.with_(Q.SUP) + "SELECT m, n, v * 17 AS v FROM sup")
def elementwise_scale(spark, d):
    return linalg.scale(D.supply_matrix(spark, d), 17).df


@query(Q.with_(Q.SUP, "b AS (SELECT p_partkey AS n, j.range AS j, (p_size + j.range)::BIGINT AS v FROM part, range(8) j)") + "SELECT m, j, sum(sup.v * b.v)::BIGINT AS v FROM sup JOIN b USING (n) GROUP BY ALL")
def matmul_sparse_dense(spark, d):
    t = D.supply_matrix(spark, d)
    b = D.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"), "p_size").select("n", "j", (F.col("p_size") + F.col("j")).cast("bigint").alias("v"))
    return einsum("Z[m,j] += A[m,n] * B[n,j]", {"A": t, "B": Tensor(b, ("n", "j"), (t.shape[1], 8))}).df


@query(Q.with_(Q.EV, "b AS (SELECT c_custkey AS i, c_nationkey AS v FROM customer)") + "SELECT b.i, (ev.v - 2 * b.v + 3)::BIGINT AS v FROM b JOIN ev ON ev.i = b.i")
def index_terms(spark, d):
    """Sums of terms, constants among them."""
    b = D.table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("i"), F.col("c_nationkey").cast("bigint").alias("v"))
    n = int(b.agg(F.max("i") + 1).first()[0])
    return einsum("Z[i] += A[i] - 2 * B[i] + 3", {"A": D.event_vector(spark, d), "B": Tensor(b, ("i",), (n,))}, {"i": n}).df


@query(Q.with_(Q.EV) + "SELECT i // 8 AS i0, i % 4 AS i1, sum(ev.v * x.v)::BIGINT AS v FROM ev JOIN (SELECT i AS t, v FROM ev) x ON x.t = ev.i // 8 GROUP BY ALL")
def index_tiles(spark, d):
    """Quotients and remainders of an index, read and written."""
    a = D.event_vector(spark, d)
    return einsum("Z[i/8,i%4] += A[i] * B[i/8]", {"A": a, "B": a}, {"i": a.shape[0]}).df


@query("WITH o AS (SELECT o_orderkey AS i, o_custkey AS c FROM orders), b AS (SELECT c_custkey AS c, c_nationkey AS v FROM customer) SELECT i, v::BIGINT AS v FROM o JOIN b USING (c)")
def index_gather(spark, d):
    """An element of one tensor as the index of another."""
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("i"), F.col("o_custkey").cast("bigint").alias("v"))
    b = D.table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("c"), F.col("c_nationkey").cast("bigint").alias("v"))
    size = lambda df, c: (int(df.agg(F.max(c) + 1).first()[0]),)
    return einsum("Z[i] += B[I[i]]", {"I": Tensor(o, ("i",), size(o, "i")), "B": Tensor(b, ("c",), size(b, "c"))}).df


@query(Q.with_(Q.SUP) + "SELECT m, sum(v)::BIGINT AS v FROM sup GROUP BY m")
def spmv_ones(spark, d):
    return linalg.spmv(D.supply_matrix(spark, d)).df


@query(Q.with_(Q.SUP) + "SELECT m, sum(v * p_size)::BIGINT AS v FROM sup JOIN part ON n = p_partkey GROUP BY m")
def spmv(spark, d):
    t = D.supply_matrix(spark, d)
    x = Tensor(D.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("n"), F.col("p_size").cast("bigint").alias("v")), ("n",), t.shape[1:])
    return linalg.spmv(t, x).df


_W9 = "w AS (SELECT range AS s, range % 5 + 1 AS v FROM range(9))"
_C1 = Q.with_(Q.EV, _W9) + "SELECT i - s AS q, sum(ev.v * w.v)::BIGINT AS v FROM ev, w WHERE i - s BETWEEN 0 AND (SELECT max(i) + 1 FROM ev) - 9 GROUP BY 1"


def _weights(spark, *shape: int) -> Tensor:
    names = ("s",) if len(shape) == 1 else ("r", "s") if len(shape) == 2 else ("k", "c", "s", "r")
    base = Tensor(spark.range(0).select(*[F.col("id").cast("int").alias(n) for n in names], F.col("id").alias("v")), names, shape)
    total = F.lit(0)
    for n in names:
        total = total + F.col(n)
    return base.fill((total % 5 + 1).cast("bigint"))


@query(_C1)
def conv1d(spark, d):
    return conv.conv1d(D.event_vector(spark, d), _weights(spark, 9)).df


@query(_C1)
def conv1d_input_stationary(spark, d):
    return conv.conv1d_scatter(D.event_vector(spark, d), _weights(spark, 9)).df


@query(_C1)
def conv1d_tiled(spark, d):
    return conv.tiled(D.event_vector(spark, d), _weights(spark, 9), (4096,)).df


@query(Q.with_(Q.EMB, "w AS (SELECT r.range AS r, s.range AS s, (r.range + s.range) % 5 + 1 AS v FROM range(3) r, range(4) s)") + "SELECT m - r AS p, k - s AS q, sum(a.v * w.v)::BIGINT AS v FROM a, w WHERE m - r BETWEEN 0 AND (SELECT max(m) + 1 FROM a) - 3 AND k - s BETWEEN 0 AND (SELECT max(k) + 1 FROM a) - 4 GROUP BY 1, 2")
def conv2d(spark, d):
    return conv.conv2d(D.embedding_matrix(spark, d), _weights(spark, 3, 4)).df


@query(_SQL["conv2d"])
def conv2d_tiled(spark, d):
    return conv.tiled(D.embedding_matrix(spark, d), _weights(spark, 3, 4), (128, 64)).df


_IMG = "img AS (SELECT k // 16 AS c, k % 16 AS h, m AS w, v FROM a)"


def _image(spark, d) -> Tensor:
    """Four channels of 16 rows, a column per embedding."""
    a = D.embedding_matrix(spark, d)
    df = a.df.select(F.floor(F.col("k") / 16).cast("int").alias("c"), (F.col("k") % 16).alias("h"), F.col("m").alias("w"), "v")
    return Tensor(df, ("c", "h", "w"), (-(-a.shape[1] // 16), 16, a.shape[0]))


@query(Q.with_(Q.EMB, _IMG, "w AS (SELECT k.range AS k, c.range AS c, s.range AS s, r.range AS r, (k.range + c.range + s.range + r.range) % 5 + 1 AS v FROM range(2) k, range(4) c, range(3) s, range(2) r)") + "SELECT w.k, img.h - s AS q, img.w - r AS p, sum(img.v * w.v)::BIGINT AS v FROM img JOIN w ON img.c = w.c WHERE img.h - s BETWEEN 0 AND 13 AND img.w - r BETWEEN 0 AND (SELECT max(w) + 1 FROM img) - 2 GROUP BY ALL")
def conv_channels(spark, d):
    return conv.conv_channels(_image(spark, d), _weights(spark, 2, 4, 3, 2)).df


@query(_SQL["conv_channels"])
def conv_channels_tiled(spark, d):
    return conv.tiled(_image(spark, d), _weights(spark, 2, 4, 3, 2), (14, 256)).df


@query(Q.with_(Q.SUP) + "SELECT m, n, v FROM sup WHERE m < 20 AND n < 50")
def resized(spark, d):
    """A sparse matrix cut to other sizes."""
    return D.supply_matrix(spark, d).resize(20, 50).df


@query(Q.with_(Q.SUP, "p AS (SELECT s_suppkey AS m, s_suppkey * 3 AS n, s_nationkey AS x FROM supplier)") + "SELECT m, n, coalesce(x, v)::BIGINT AS v FROM sup FULL JOIN p USING (m, n)")
def values_set(spark, d):
    """A value for each supplier, stored before or not."""
    p = D.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("m"), (F.col("s_suppkey") * 3).cast("int").alias("n"), F.col("s_nationkey").cast("bigint").alias("v"))
    return D.supply_matrix(spark, d).with_values(p).df


@query(Q.with_(Q.SUP) + "SELECT (m * (SELECT max(l_partkey) + 1 FROM lineitem) + n)::BIGINT AS place, '[' || m || ', ' || n || '] = ' || v AS line FROM sup")
def tensor_listing(spark, d):
    return D.supply_matrix(spark, d).listing()


@query(Q.with_(Q.SUP) + "SELECT m, n, v FROM sup WHERE m = 3 AND n = (SELECT max(n) FROM sup WHERE m = 3)")
def key_lookup(spark, d):
    t = D.supply_matrix(spark, d)
    return scan.find_key(t, (3, t.df.where("m = 3").agg(F.max("n")).first()[0]))


@query(Q.with_(Q.SUP, "o AS (SELECT DISTINCT m, dense_rank() OVER (ORDER BY m) - 1 AS p FROM sup), i AS (SELECT m, row_number() OVER (ORDER BY m, n) - 1 AS p FROM sup)") + "SELECT 0 AS level, 0 AS parent_pos, 0 AS start, (SELECT count(*) FROM o) AS stop UNION ALL SELECT 1, o.p, min(i.p), max(i.p) + 1 FROM o JOIN i USING (m) GROUP BY o.p")
def csf_segments(spark, d):
    return sparse.encode(D.supply_matrix(spark, d)).segments


@query(Q.with_(Q.SUP) + "SELECT 0 AS level, dense_rank() OVER (ORDER BY m) - 1 AS pos, m AS coord FROM (SELECT DISTINCT m FROM sup) UNION ALL SELECT 1, row_number() OVER (ORDER BY m, n) - 1, n FROM sup")
def csf_coordinates(spark, d):
    return sparse.encode(D.supply_matrix(spark, d)).coords


@query(Q.with_(Q.SUP) + "SELECT m, n, v FROM sup")
def csf_round_trip(spark, d):
    t = D.supply_matrix(spark, d)
    return sparse.decode(sparse.encode(t), t.index).df


@query(Q.with_(Q.SUP) + "SELECT m, min(n) AS n, arg_min(v, n) AS v FROM sup GROUP BY m")
def csf_locate(spark, d):
    """Each supplier's first part, found by both coordinates."""
    t = D.supply_matrix(spark, d)
    return sparse.locate(t, t.df.groupBy("m").agg(F.min("n").alias("n")))


@query(Q.with_(Q.GRAPH) + "SELECT v, (SELECT count(*) FROM e WHERE s < v) AS off FROM (SELECT range AS v FROM range((SELECT n + 1 FROM nv)))")
def csr_offsets(spark, d):
    return sparse.row_offsets(D.order_graph(spark, d))


@query(Q.with_(Q.GRAPH) + "SELECT v, coalesce(o, 0) AS out_deg, coalesce(i, 0) AS in_deg FROM vs LEFT JOIN (SELECT s AS v, count(*) AS o FROM e GROUP BY s) USING (v) LEFT JOIN (SELECT d AS v, count(*) AS i FROM e GROUP BY d) USING (v)")
def degrees(spark, d):
    return D.order_graph(spark, d).degrees()


@query(Q.with_(Q.GRAPH) + "SELECT v, (SELECT count(*) FROM e WHERE d = v) AS deg FROM vs")
def degrees_from_offsets(spark, d):
    return sparse.adjacent_difference(sparse.row_offsets(D.order_graph(spark, d), by_source=False))


_FORMS = {
    "csr3": "d // 64 AS d1, s, d % 64 AS d0", "csc3": "s // 32 AS s1, d, s % 32 AS s0", "csc4": "d // 64 AS d1, s // 32 AS s1, d % 64 AS d0, s % 32 AS s0",
    "csc5_dst_tile": "d // 64 AS d1, s // 32 // 4 AS s2, s // 32 % 4 AS s1, d % 64 AS d0, s % 32 AS s0",
    "csr5_dst_tile": "d // 64 AS d1, s // 32 // 4 AS s2, s // 32 % 4 AS s1, s % 32 AS s0, d % 64 AS d0",
    "csr5_dst_tile_ct": "s // 32 // 4 AS s2, d // 64 AS d1, s // 32 % 4 AS s1, s % 32 AS s0, d % 64 AS d0",
}
for _f, _cols in _FORMS.items():
    _QUERIES[f"tiles_{_f}"] = lambda spark, d, f=_f: sparse.tiled(D.order_graph(spark, d), f, 32, 64, 4 if "5" in f else 0).df
    _SQL[f"tiles_{_f}"] = Q.with_(Q.GRAPH) + f"SELECT {_cols}, w AS v FROM e"


@query(Q.with_(Q.GRAPH) + "SELECT s AS v, sum(w)::BIGINT AS y FROM e GROUP BY s")
def spmv_tiled(spark, d):
    """Row sums from the five-level tiles: the tile columns are put together again."""
    t = sparse.tiled(D.order_graph(spark, d), "csr5_dst_tile", 32, 64, 4)
    return t.df.groupBy(((F.col("s2") * 4 + F.col("s1")) * 32 + F.col("s0")).alias("v")).agg(F.sum("v").alias("y"))


@query(Q.with_(Q.GRAPH) + "SELECT form, s AS v, sum(w)::BIGINT AS y FROM e, (SELECT unnest(['csr3', 'csc3', 'csc4', 'csc5_dst_tile', 'csr5_dst_tile', 'csr5_dst_tile_ct']) AS form) GROUP BY ALL")
def spmv_forms(spark, d):
    """Row sums from each of the tiled forms."""
    g, out = D.order_graph(spark, d), None
    # rows of a vertex lie together, so that each form's sums are nearly made before they are shuffled
    g = Graph(storage.save(g.edges.repartition("s"), "edges"), g.n)
    for form in sparse.TILED:
        sizes = (32, 64, 4 if "5" in form else 0)
        rows = sparse.untile(sparse.tiled(g, form, *sizes), *sizes).groupBy(F.col("s").alias("v")).agg(F.sum("v").alias("y")).select(F.lit(form).alias("form"), "v", "y")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(Q.with_(Q.GRAPH) + "SELECT s AS v, sum(w)::BIGINT AS y, count(*) AS deg FROM e GROUP BY s HAVING sum(w) <> count(*)")
def spmv_validate(spark, d):
    """A product with ones that weighs its edges isn't the out-degree: the rows that say so."""
    g = D.order_graph(spark, d)
    return sparse.validate(g, g.edges.groupBy(F.col("s").alias("v")).agg(F.sum("w").alias("y")))


@query(Q.with_(Q.GRAPH, "t AS (SELECT s // 32 AS s1, d // 64 AS d1 FROM e GROUP BY ALL)") + "SELECT a.range AS s1, b.range AS d1, t.s1 IS NULL AS empty FROM range((SELECT (n + 31) // 32 FROM nv)) a CROSS JOIN range((SELECT (n + 63) // 64 FROM nv)) b LEFT JOIN t ON t.s1 = a.range AND t.d1 = b.range")
def tile_mask(spark, d):
    return sparse.tile_mask(D.order_graph(spark, d), 32, 64)


@query(Q.with_(Q.GRAPH) + "SELECT s, d, w, row_number() OVER (PARTITION BY s ORDER BY d) - 1 AS pos FROM e")
def row_positions(spark, d):
    return sparse.with_positions(D.order_graph(spark, d)).edges


@query(Q.with_(Q.GRAPH) + "SELECT s // 32 AS s1, d // 64 AS d1, count(*) AS n FROM e GROUP BY ALL")
def tile_histogram(spark, d):
    return sparse.tile_histogram(D.order_graph(spark, d), 32, 64)


@query(Q.with_(Q.GRAPH) + "SELECT s // 32 AS s1, d // 64 AS d1, d, count(*) AS n FROM e GROUP BY ALL")
def tile_valid_vertices(spark, d):
    return sparse.valid_vertices(D.order_graph(spark, d), 32, 64)


@query(Q.with_(Q.GRAPH) + "SELECT s, d, w FROM e WHERE s // 32 = 2 AND d // 64 = 3")
def tile_edges(spark, d):
    return sparse.tile_of(D.order_graph(spark, d), 2, 3, 32, 64).edges


@query(Q.with_(Q.GRAPH, "t AS (SELECT s, d // 64 AS d1, count(*) AS n FROM e GROUP BY ALL)") + "SELECT s, d1, n, coalesce(sum(n) OVER (PARTITION BY s ORDER BY d1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM t")
def row_tile_offsets(spark, d):
    return sparse.row_tile_offsets(D.order_graph(spark, d), 64)


_ORD = "od AS (SELECT v, coalesce(o, 0) AS o FROM vs LEFT JOIN (SELECT s AS v, count(*) AS o FROM e GROUP BY s) USING (v)), mp AS (SELECT v, row_number() OVER (ORDER BY o DESC, v) - 1 AS new_v FROM od)"


@query(Q.with_(Q.GRAPH, _ORD) + "SELECT v, new_v FROM mp")
def degree_order(spark, d):
    return sparse.degree_order(D.order_graph(spark, d))


@query(Q.with_(Q.GRAPH, _ORD) + "SELECT a.new_v AS s, b.new_v AS d, w FROM e JOIN mp a ON a.v = s JOIN mp b ON b.v = d")
def relabel_by_degree(spark, d):
    g = D.order_graph(spark, d)
    return sparse.relabel(g, sparse.degree_order(g)).edges


@query(Q.with_(Q.EV) + "SELECT i, v, coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_ FROM ev")
def prefix_sum(spark, d):
    return sparse.exclusive_sum(D.event_vector(spark, d).df, "i", "v", "before_")


@query(Q.with_(Q.SUP) + "SELECT m, n, v FROM sup WHERE m >= 5 AND m < 5 + 20 * 3 AND (m - 5) % 3 = 0 AND n >= 7 AND n < 7 + 100 * 4 AND (n - 7) % 4 = 0")
def strided_scan(spark, d):
    return scan.strided(D.supply_matrix(spark, d), (5, 7), (20, 100), (3, 4), order=(1, 0))


@query(Q.with_(Q.SUP, "p AS (SELECT s_suppkey AS m, s_suppkey * 3 AS n FROM supplier)") + "SELECT p.m, p.n, sup.v IS NOT NULL AS has FROM p LEFT JOIN sup USING (m, n)")
def point_lookup(spark, d):
    p = D.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("m"), (F.col("s_suppkey") * 3).cast("int").alias("n"))
    return scan.has(D.supply_matrix(spark, d), p)


@query("SELECT l_suppkey + 2 AS t0, l_partkey + 5 AS t1, least(l_suppkey + 2, 49) AS b0, least(l_partkey + 5, 99) AS b1, l_suppkey * 3 AS s0, l_partkey * 2 AS s1, l_suppkey % 2 = 0 AND l_partkey % 3 = 0 AS mult, l_partkey AS p0, l_suppkey AS p1, l_suppkey > 10 AND l_partkey > 20 AS over, 9 AS h0, l_suppkey AS h1 FROM lineitem")
def point_algebra(spark, d):
    x = D.table(spark, d, "lineitem")
    p = [F.col("l_suppkey"), F.col("l_partkey")]
    cols = {f"t{i}": c for i, c in enumerate(scan.translate(p, [2, 5]))} | {f"b{i}": c for i, c in enumerate(scan.translate_bounded(p, [2, 5], [50, 100]))} | {f"s{i}": c for i, c in enumerate(scan.scale(p, [3, 2]))} | {f"p{i}": c for i, c in enumerate(scan.permute(p, [1, 0]))} | {f"h{i}": c for i, c in enumerate(scan.shift(p, 9))}
    return x.select(*[c.alias(n) for n, c in cols.items()], scan.multiple_of(p, [2, 3]).alias("mult"), scan.all_compare(p, ">", [10, 20]).alias("over"))


@query(Q.with_(Q.GRAPH, Q.LEVELS, recursive=True) + "SELECT v, (level IS NOT NULL)::INT AS connected FROM vs LEFT JOIN lev USING (v)")
def bfs_reachable(spark, d):
    return graph.reachable(D.order_graph(spark, d))


@query(Q.with_(Q.GRAPH, Q.LEVELS, "par AS (SELECT e.d AS v, min(e.s) AS parent FROM e JOIN lev a ON a.v = e.s JOIN lev b ON b.v = e.d WHERE b.level = a.level + 1 GROUP BY e.d)", recursive=True) + "SELECT v, coalesce(level, -1) AS level, CASE WHEN v = 0 THEN 0 ELSE coalesce(parent, -1) END AS parent FROM vs LEFT JOIN lev USING (v) LEFT JOIN par USING (v)")
def bfs_parents(spark, d):
    return graph.bfs(D.order_graph(spark, d))


@query(Q.with_(Q.GRAPH, Q.LEVELS, recursive=True) + "SELECT max(level) AS depth, count(*) AS reached FROM lev")
def bfs_depth(spark, d):
    return graph.depth(graph.bfs(D.order_graph(spark, d)))


@query(Q.with_(Q.GRAPH, Q.LABELS.format(edges="e"), recursive=True) + "SELECT v, label FROM lab")
def ancestor_labels(spark, d):
    return graph.least_labels(D.order_graph(spark, d))


@query(Q.with_(Q.GRAPH, Q.SYM, Q.LABELS.format(edges="sym"), recursive=True) + "SELECT label, count(*) AS size FROM lab GROUP BY label")
def connected_components(spark, d):
    return graph.component_sizes(graph.components(D.order_graph(spark, d)))


@query(Q.with_(Q.GRAPH, Q.SYM, Q.LABELS.format(edges="sym"), recursive=True) + "SELECT v, label FROM lab")
def component_labels(spark, d):
    return graph.components(D.order_graph(spark, d))


@query(Q.pagerank())
def pagerank_delta(spark, d):
    return graph.pagerank_delta(D.order_graph(spark, d), most=12)


def _seeds(spark) -> DataFrame:
    return spark.range(3).select(F.col("id").alias("seed"))


@query(Q.nibble(3, "170 * residual", "187 * residual // deg.k", "12", "BIGINT", "rank, residual"))
def nibble_multiseed(spark, d):
    return graph.nibble(D.order_graph(spark, d), _seeds(spark), 3)


@query("SELECT v, rank, residual FROM (" + Q.nibble(3, "170 * residual", "187 * residual // deg.k", "12", "BIGINT", "rank, residual") + ") WHERE seed = 0")
def nibble_single(spark, d):
    return graph.nibble(D.order_graph(spark, d), _seeds(spark).where("seed = 0"), 3).select("v", "rank", "residual")


@query("WITH f AS (SELECT seed, v FROM (" + Q.nibble(2, "170 * residual", "187 * residual // deg.k", "12", "BIGINT", "front") + ") WHERE front), " + Q.GRAPH + ", a AS (SELECT seed, 'residual' AS tensor, v AS addr, 1 AS r, 0 AS u FROM f UNION ALL SELECT seed, 'rank', v, 0, 1 FROM f UNION ALL SELECT seed, 'residual', d, 0, 1 FROM f JOIN e ON e.s = f.v) SELECT seed, tensor, addr::INT AS addr, sum(r)::BIGINT AS reads, sum(u)::BIGINT AS updates FROM a GROUP BY ALL")
def nibble_trace(spark, d):
    """The accesses of the third round, after two."""
    return graph.nibble_accesses(D.order_graph(spark, d), _seeds(spark), 2)


@query(Q.nibble(4, "2 * 0.15::DOUBLE / 1.15 * residual", "0.85::DOUBLE / 1.15 * residual / deg.k", "1e-6::DOUBLE", "DOUBLE", "round(rank, 9) AS rank, round(residual, 9) AS residual"))
def nibble_double(spark, d):
    return graph.nibble_double(D.order_graph(spark, d), _seeds(spark), most=4).select("seed", "v", F.round("rank", 9).alias("rank"), F.round("residual", 9).alias("residual"))


@query()
def nibble_double_fixpoint(spark, d):
    """nibble_double, whose SQL unrolls four rounds only, until no residual reaches epsilon."""
    return graph.nibble_double(D.order_graph(spark, d), _seeds(spark)).select("seed", "v", F.round("rank", 9).alias("rank"), F.round("residual", 9).alias("residual"))


@query(Q.with_(Q.GRAPH, Q.DIST, recursive=True) + "SELECT v, d AS dist FROM dist")
def shortest_paths(spark, d):
    return graph.shortest_paths(D.order_graph(spark, d))


@query(Q.with_(Q.GRAPH) + "SELECT v, 10 * (SELECT count(*) FROM e WHERE d = v) AS y FROM vs")
def spmv_rounds(spark, d):
    return graph.spmv_rounds(D.order_graph(spark, d))


@query(Q.with_(Q.GRAPH) + "SELECT v, coalesce((SELECT 10 * sum(w * (s % 7)) FROM e WHERE d = v), 0)::BIGINT AS y FROM vs")
def spmv_rounds_weighted(spark, d):
    g = D.order_graph(spark, d)
    return graph.spmv_rounds(g, x=g.vertices.select("v", (F.col("v") % 7).alias("x")))


@query(Q.power_rounds(10, 1_000_003))
def spmv_ten_rounds(spark, d):
    """Ten products, each with the remainders of the one before, over blocks of the matrix that stay where they are."""
    g = D.order_graph(spark, d)
    return blocks.BlockMatrix.from_graph(g).rounds(g.vertices.select("v", (F.col("v") % 7 + 1).alias("x")), g.n, 10, 1_000_003)


@query(Q.with_(Q.GRAPH) + "SELECT d AS v, sum(w * (s % 7))::BIGINT AS y FROM e GROUP BY d")
def spmv_five_levels(spark, d):
    """A product straight from the five-level tiles."""
    g = D.order_graph(spark, d)
    matrix = blocks.BlockMatrix.from_tiles(sparse.tiled(g, "csr5_dst_tile", 32, 64, 4))
    return matrix.multiply(g.vertices.select("v", (F.col("v") % 7).alias("x")))


@query(Q.with_(Q.GRAPH) + "SELECT d AS v, sum(w)::BIGINT AS y FROM e WHERE s IN (SELECT s FROM e GROUP BY s HAVING count(*) > 10) GROUP BY d")
def spmv_frontier(spark, d):
    g = D.order_graph(spark, d)
    return graph.frontier_spmv(g, g.out_degree().where("deg > 10"))


@query(Q.with_(Q.GRAPH) + "SELECT count(*) AS n FROM e a JOIN e b ON a.d = b.s JOIN e c ON b.d = c.s AND c.d = a.s WHERE a.s <> a.d AND b.s <> b.d AND c.s <> c.d")
def cycles3(spark, d):
    return graph.cycles3(D.order_graph(spark, d))


@query(Q.with_(Q.GRAPH, Q.SYM) + "SELECT count(*) AS n FROM sym a JOIN sym b ON a.d = b.s JOIN sym c ON b.d = c.s AND c.d = a.s")
def triangles(spark, d):
    return graph.triangles(D.order_graph(spark, d))


@query(Q.with_(Q.TRACE) + "SELECT buffer, sum((kind = 'R')::INT)::BIGINT AS reads, sum((kind = 'U')::INT)::BIGINT AS updates FROM tr GROUP BY buffer")
def trace_counts(spark, d):
    return trace.counts(D.event_trace(spark, d), "buffer")


@query(Q.with_(Q.LRU.format(trace=Q.TRACE, g=4, lines=8)) + "SELECT h.buffer, sum((NOT hit AND kind = 'R')::INT)::BIGINT AS fills, sum((NOT hit AND kind = 'U')::INT)::BIGINT AS allocations, sum(hit::INT)::BIGINT AS hits, sum((NOT hit)::INT)::BIGINT AS evicts, sum((NOT hit)::INT)::BIGINT AS backing_reads, any_value(x.n)::BIGINT AS backing_updates FROM hit h JOIN (SELECT buffer, sum(dirty::INT) AS n FROM dirty GROUP BY buffer) x USING (buffer) GROUP BY h.buffer")
def trace_lru(spark, d):
    stats = trace.lru_statistics(trace.lru(D.event_trace(spark, d), 32, 4))
    return stats.select("buffer", "fills", "allocations", "hits", "evicts", "backing_reads", "backing_updates")


@query(Q.with_(Q.TRACE, "x AS (SELECT buffer, coalesce(addr // 16 = lag(addr // 16) OVER (PARTITION BY buffer ORDER BY seq), false) AS hit FROM tr)") + "SELECT buffer, sum(hit::INT)::BIGINT AS row_hits, sum((NOT hit)::INT)::BIGINT AS row_misses FROM x GROUP BY buffer")
def trace_row_buffer(spark, d):
    return trace.row_buffer(D.event_trace(spark, d), ["buffer"])


@query(Q.with_(Q.TRACE, "x AS (SELECT buffer, seq, coalesce(addr // 16 = lag(addr // 16) OVER (PARTITION BY buffer ORDER BY seq), false) AS hit FROM tr WHERE kind = 'U')") + "SELECT buffer, sum(hit::INT)::BIGINT AS row_hits, sum((NOT hit)::INT)::BIGINT AS row_misses FROM x GROUP BY buffer")
def trace_row_buffer_updates(spark, d):
    """Row hits of the updates alone, compared in short stretches."""
    return trace.row_buffer(D.event_trace(spark, d).where("kind = 'U'"), ["buffer"], stride=100)


@query()
def trace_coalescing(spark, d):
    """Multicast and multi-reduce: a state machine per buffer, all requestors in one."""
    t = D.event_trace(spark, d, 1).withColumn("requestor", (F.col("seq") % 4).cast("int"))
    return trace.coalesce(t, 16).groupBy("buffer", "kind").agg(F.sum(F.col("coalesced").cast("bigint")).alias("coalesced"), F.count(F.lit(1)).alias("n"))


@query(Q.with_(Q.TRACE, "c AS (SELECT kind, buffer, requestor, count(*) AS n FROM tr GROUP BY ALL)") + "SELECT kind AS stat, buffer, requestor, sum(n)::BIGINT AS n FROM c GROUP BY ROLLUP (kind, buffer, requestor) HAVING grouping(kind) = 0")
def statistics_rollup(spark, d):
    c = D.event_trace(spark, d).groupBy(F.col("kind").alias("stat"), "buffer", "requestor").agg(F.count(F.lit(1)).alias("n"))
    return trace.statistics_tree(c, ["buffer", "requestor"])


@query(Q.with_(Q.TRACE, Q.OPS, recursive=True) + "SELECT o.engine, o.op, coalesce(sum(CASE WHEN t.p < o.stop THEN 1 << t.x END), 0)::BIGINT AS inputs, coalesce(sum(CASE WHEN t.p = o.stop AND t.kind = 'U' THEN 1 << t.x END), 0)::BIGINT AS outputs FROM op o JOIN t ON t.engine = o.engine AND t.p BETWEEN o.a AND o.stop GROUP BY o.engine, o.op")
def compute_ops(spark, d):
    t = D.event_trace(spark, d).select(F.col("buffer").alias("engine"), "seq", (F.col("addr") % 8).cast("int").alias("tensor_id"), "kind")
    return trace.compute_ops(t)


@query(Q.with_(Q.TRACE, "l AS (SELECT buffer, seq % 7 AS level FROM tr)") + "SELECT level::INT AS level, buffer::INT AS buffer, CASE WHEN level = 2 AND buffer = 1 THEN 'near' WHEN level = 4 AND buffer = 3 THEN 'far' ELSE 'unit.' || level || '.' || buffer % [1, 1, 2, 8, 8][least(level + 1, 5)] END AS unit, count(*) AS n FROM l GROUP BY ALL")
def trace_binding(spark, d):
    """Buffers of seven levels, two of them bound by name, the others by their level's units."""
    named = spark.createDataFrame([("events", 2, 1, "near"), ("events", 4, 3, "far"), ("other", 0, 0, "none")], "tensor string, level int, buffer int, unit string")
    t = D.event_trace(spark, d).withColumn("level", (F.col("seq") % 7).cast("int"))
    return trace.bind(t, named).groupBy("level", "buffer", "unit").agg(F.count(F.lit(1)).alias("n"))


@query(Q.with_(Q.TRACE, "o AS (SELECT buffer AS engine, count(*) AS ops FROM tr WHERE kind = 'U' GROUP BY buffer)") + "SELECT 0 AS level, engine::INT AS engine, CASE WHEN engine = 1 THEN 'mac' ELSE 'compute.0.' || engine END AS unit, ops FROM o WHERE engine <> 2")
def compute_binding(spark, d):
    """Operations of each engine: one bound by name, one disabled."""
    ops = D.event_trace(spark, d).where("kind = 'U'").groupBy(F.col("buffer").alias("engine")).agg(F.count(F.lit(1)).alias("ops")).withColumn("level", F.lit(0))
    named = spark.createDataFrame([(0, 1, "mac"), (0, 2, None), (1, 3, "other")], "level int, engine int, unit string")
    return trace.bind_compute(ops, named)


@query(Q.with_(Q.TRACE) + "SELECT 'buffer ' || buffer AS header, CASE kind WHEN 'R' THEN 'reads' ELSE 'updates' END AS name, count(*) AS n FROM tr GROUP BY ALL")
def statistics_text(spark, d):
    """Counters through text files, written and read back."""
    path = _path(spark, "statistics")
    c = D.event_trace(spark, d).groupBy(F.concat(F.lit("buffer "), "buffer").alias("header"), F.when(F.col("kind") == "R", "reads").otherwise("updates").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    statistics.write_counters(c, path, "header", "name", "n")
    return statistics.with_header(statistics.read_counters(spark, path)).select("header", "name", "n")


@query("SELECT tensor, max(volume) AS volume, sum(backing) AS backing, sum(local) AS local FROM (" + Q.FOOTPRINT + ") GROUP BY tensor")
def static_footprint_totals(spark, d):
    """The same nest's buffer sizes and accesses by tensor."""
    return footprint.totals(static_footprint(spark, d))


@query(Q.FOOTPRINT)
def static_footprint(spark, d):
    """A 16 x 16 matrix product by tiles of 8 x 8 x 4, its output half of the time, and a window over rows and columns of a tile."""
    nest = [footprint.Loop(v, 0, n) for v, n in (("m1", 2), ("n1", 2), ("k1", 4), ("m0", 8), ("n0", 8), ("k0", 4))]
    use = footprint.Use
    return footprint.analyse(spark, nest, [use("A", ("8*m1+m0", "4*k1+k0"), 6, level=3), use("B", ("4*k1+k0", "8*n1+n0"), 6, level=3), use("Z", ("8*m1+m0", "8*n1+n0"), 6, True, 0.5, 3), use("I", ("m0+k0",), 6)])


def _path(spark, name: str) -> str:
    return f"{storage.shared_folder(spark)}/weft/{name}-{uuid.uuid4().hex}"


@query(Q.with_(Q.EV) + "SELECT i::INT AS i, v FROM ev")
def archive_dense(spark, d):
    """A vector through a dense archive, written and read back."""
    path = _path(spark, "dense")
    archive.write_dense(D.event_vector(spark, d), path)
    return archive.read_dense(spark, path, ("i",)).df


@query(Q.with_(Q.SUP) + "SELECT m::INT AS m, n::INT AS n, v FROM sup")
def archive_compressed(spark, d):
    """A sparse matrix through a compressed archive, written and read back."""
    path = _path(spark, "compressed")
    archive.write_compressed(D.supply_matrix(spark, d), path)
    return archive.read_compressed(spark, path, ("m", "n")).df


@query(Q.with_(Q.EV) + "SELECT i, (v - v % 3)::BIGINT AS got, v AS wanted FROM ev WHERE v % 3 > 1")
def tensor_differences(spark, d):
    """Entries that differ by more than the tolerance."""
    t = D.event_vector(spark, d)
    return check.differences(t.transform(F.col("v") - F.col("v") % 3), t, 1)


@query("SELECT user_id % 5 AS stream, event_id AS seq, floor(value)::BIGINT AS value, coalesce(sum((event_type = (SELECT min(event_type) FROM events))::INT) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g0 FROM events QUALIFY event_type <> (SELECT min(event_type) FROM events)")
def punctuated_groups(spark, d):
    e = D.table(spark, d, "events")
    mark = e.agg(F.min("event_type")).first()[0]
    s = e.select((F.col("user_id") % 5).alias("stream"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == mark, 0).alias("tag"), F.floor("value").cast("bigint").alias("value"))
    return dataflow.groups(s, 1, "stream").select("stream", "seq", "value", "g0")


_TAGS = "t AS (SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 1 WHEN event_id % 5 = 0 THEN 0 END AS tag, floor(value)::BIGINT AS value FROM events)"
_BEFORE = "OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(Q.with_(_TAGS, f"o AS (SELECT *, coalesce(sum((tag >= 2)::INT) {_BEFORE}, 0) AS a, coalesce(sum((tag >= 1)::INT) {_BEFORE}, 0) AS b FROM t)") + f"SELECT seq, value, coalesce(sum((tag = 0)::INT) {_BEFORE.replace('(ORDER', '(PARTITION BY b ORDER')}, 0)::BIGINT AS g0, coalesce(sum((tag = 1)::INT) {_BEFORE.replace('(ORDER', '(PARTITION BY a ORDER')}, 0)::BIGINT AS g1, a::BIGINT AS g2 FROM o QUALIFY tag IS NULL")
def punctuated_nested(spark, d):
    """One stream without keys, markers of three nesting levels: each group's number in the group around it."""
    i = F.col("event_id")
    e = D.table(spark, d, "events").select(i.alias("seq"), F.when(i % 97 == 0, 2).when(i % 13 == 0, 1).when(i % 5 == 0, 0).alias("tag"), F.floor("value").cast("bigint").alias("value"))
    return dataflow.groups(e, 3, nested=True, stride=1024)


@query(Q.with_(Q.GRAPH, "b AS (SELECT s, min(d) AS lo, max(d) + 1 AS hi FROM e GROUP BY s)") + "SELECT s, unnest(range(lo, hi))::BIGINT AS i FROM b")
def loop_over_spans(spark, d):
    """Every vertex between the first and the last neighbour of each: long ranges, cut and dealt out."""
    b = D.order_graph(spark, d).edges.groupBy("s").agg(F.min("d").cast("bigint").alias("lo"), (F.max("d") + 1).cast("bigint").alias("hi"))
    return loops.inner(b, "i", F.col("lo"), F.col("hi"), deal=256).select("s", "i")


@query(Q.with_(Q.SUP) + "SELECT m::INT AS m, n::INT AS n, v FROM sup WHERE m BETWEEN 8 AND 60 AND m % 4 = 0 AND n BETWEEN 100 AND 399 AND (n - 100) % 3 = 0")
def clustered_scan(spark, d):
    """A strided box of a matrix in Z-ordered cells: files of other cells aren't read."""
    t = D.supply_matrix(spark, d)
    stored = clustered.Clustered.write(t, _path(spark, "clustered"), 64)
    return stored.scan(spark, (8, 100), (14, 100), (4, 3))


_STREAM = "r AS (SELECT user_id % 5 AS key, event_id AS seq, CASE WHEN event_id % 67 = 0 THEN 1 WHEN event_id % 11 = 0 THEN 0 END AS tag, floor(value)::BIGINT AS value FROM events), l AS (SELECT * FROM r, (SELECT unnest([0, 1]) AS level))"


@query(Q.with_(_STREAM, "o AS (SELECT *, coalesce(sum((tag >= level)::INT) OVER (PARTITION BY key, level ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM l)") + "SELECT key, level, g, count(*) FILTER (WHERE tag IS NULL)::BIGINT AS n, coalesce(sum(value) FILTER (WHERE tag IS NULL), 0)::BIGINT AS total FROM o GROUP BY ALL HAVING bool_or(coalesce(tag >= level, false))")
def stream_groups(spark, d):
    """Groups of a stream fed in batches, a third of the rows a batch late, as they end; every row is counted in its place."""
    i = F.col("event_id")
    e = D.table(spark, d, "events")
    last = e.agg(F.max("event_id")).first()[0]
    width, day = last // 4 + 1, 86400  # a watermark starts at second 0
    rows = e.select((F.col("user_id") % 5).cast("bigint").alias("key"), i.cast("bigint").alias("seq"), F.timestamp_seconds(i + day).alias("ts"), F.when(i % 67 == 0, 1).when(i % 11 == 0, 0).alias("tag"), F.floor("value").cast("bigint").alias("value"))
    fed = rows.withColumn("batch", (F.floor(F.col("seq") / width) + (F.col("seq") % 3 == 0).cast("int")).cast("int"))
    # rows far behind all others end the wait; they are no part of the streams
    end = rows.select("key").distinct().select("key", F.lit(last + 1).cast("bigint").alias("seq"), F.timestamp_seconds(F.lit(last + 4 * width + day)).alias("ts"), F.lit(None).cast("int").alias("tag"), F.lit(None).cast("bigint").alias("value"))
    source = _path(spark, "feed")
    for k in range(5):
        fed.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(source)
    end.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return groups.run(groups.ended(stream, 2, f"{2 * width} seconds"), _path(spark, "ended"), _path(spark, "groups"))


@query(Q.with_(Q.EV, "k AS (SELECT (max(i) + 1) // 3 AS k FROM ev), w AS (SELECT unnest(range((SELECT k FROM k))) AS s)") + "SELECT (i - s)::INT AS q, sum(v * (s % 11 - 5))::BIGINT AS v FROM ev JOIN w ON i >= s WHERE i - s <= (SELECT max(i) + 1 FROM ev) - (SELECT k FROM k) GROUP BY 1")
def conv1d_long_kernel(spark, d):
    """A kernel a third as long as the inputs: transforms of blocks modulo two primes."""
    x = D.event_vector(spark, d)
    k = x.shape[0] // 3
    w = Tensor(spark.range(k).select(F.col("id").cast("int").alias("s"), (F.col("id") % 11 - 5).alias("v")), ("s",), (k,))
    return longconv.conv1d(x, w, 1024).df


@query(Q.with_(Q.SUP, "t AS (SELECT m, n, v, row_number() OVER (PARTITION BY m ORDER BY n) - 1 AS place, sum(v) OVER (PARTITION BY m ORDER BY n) AS total FROM sup)") + "SELECT m, n, v, place, total::BIGINT AS total FROM t WHERE total - v < 500")
def fiber_scan_sql(spark, d):
    """Each supplier's parts in order until 500 are together, in SQL with a table function."""
    fibers.register(spark)
    fibers.needed(D.supply_matrix(spark, d).df, ["m"], ["n"], "v", 500).createOrReplaceTempView("weft_supply")
    return spark.sql("SELECT * FROM fiber_scan(TABLE(weft_supply) PARTITION BY (m) ORDER BY (n), 'v', 500)")


@query("SELECT event_id AS i, CASE WHEN user_id = 0 THEN 0 ELSE user_id // (user_id & -user_id) END::BIGINT AS v FROM events")
def while_halving(spark, d):
    """A loop that runs until no value is even."""
    state = D.table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("user_id").cast("bigint").alias("v"), F.lit(True).alias("changed"))
    step = lambda df: df.select("i", F.when((F.col("v") % 2 == 0) & (F.col("v") != 0), F.expr("v div 2")).otherwise(F.col("v")).alias("v"), ((F.col("v") % 2 == 0) & (F.col("v") != 0)).alias("changed"))
    return loops.repeat(state, step, F.col("changed"), 64)[0].select("i", "v")


@query(Q.with_(Q.TRACE, "r AS (SELECT addr, count(*) AS reads FROM tr WHERE kind = 'R' GROUP BY addr), u AS (SELECT addr, max(seq) AS last_update FROM tr WHERE kind = 'U' AND seq % 3 = 0 GROUP BY addr)") + "SELECT addr, reads, last_update FROM r FULL JOIN u USING (addr)")
def stage_fan_out(spark, d):
    """One producer, two consumers, and the groups that are done in either."""
    reads, updates = dataflow.fan_out(
        D.event_trace(spark, d).select("addr", "seq", "kind"),
        lambda df: df.where("kind = 'R'").groupBy("addr").agg(F.count(F.lit(1)).alias("reads")),
        lambda df: df.where("kind = 'U' AND seq % 3 = 0").groupBy("addr").agg(F.max("seq").alias("last_update")),
    )
    return dataflow.pair(reads, updates, ["addr"], "any")


@query(Q.with_(Q.GRAPH) + "SELECT v, coalesce(o, 0)::BIGINT AS out_deg, coalesce(i, 0)::BIGINT AS in_deg FROM (SELECT s AS v, count(*) AS o FROM e GROUP BY s) FULL JOIN (SELECT d AS v, count(*) AS i FROM e GROUP BY d) USING (v)")
def stream_degrees(spark, d):
    """Degrees kept up over a stream of edges that comes in several batches."""
    source = _path(spark, "edges")
    D.order_graph(spark, d).edges.select("s", "d").repartition(6, "s").write.parquet(source)
    stream = edges.edge_stream(spark, source, "s int, d int", 2)
    return edges.drain_to(edges.degrees(stream), _path(spark, "degrees"), _path(spark, "stream"))


@query(Q.with_(Q.GRAPH) + "SELECT dense_rank() OVER (ORDER BY s // 32, d // 64) - 1 AS visit, s // 32 AS s1, d // 64 AS d1, s, d, w, row_number() OVER (PARTITION BY s ORDER BY d) - 1 AS cursor FROM e")
def tile_visits(spark, d):
    """All tiles in order, each with its edges and where its rows' cursors stand."""
    return sparse.visit_tiles(D.order_graph(spark, d), 32, 64)
