"""DuckDB SQL that says what the catalogue's queries say."""

from __future__ import annotations

EMB = "emb AS (SELECT vec_id AS m, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT m, k, floor(x * 1000 + 0.5)::BIGINT AS v FROM emb)"
EV = "ev AS (SELECT event_id AS i, floor(value)::BIGINT AS v FROM events)"
SUP = "sup AS (SELECT l_suppkey AS m, l_partkey AS n, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL)"
GRAPH = "nv AS (SELECT count(*) AS n FROM customer), e AS (SELECT o_custkey AS s, (o_orderkey * 7 + 3) % (SELECT n FROM nv) AS d, min(o_orderkey % 16 + 1)::BIGINT AS w FROM orders GROUP BY ALL), vs AS (SELECT range AS v FROM range((SELECT n FROM nv)))"
SYM = "sym AS (SELECT s, d FROM e WHERE s <> d UNION SELECT d, s FROM e WHERE s <> d)"
DEG = "deg AS (SELECT s AS v, count(*) AS k FROM e GROUP BY s)"
TRACE = "tr AS (SELECT event_id % 4 AS buffer, event_id AS seq, user_id AS addr, event_id % 4 AS requestor, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'U' ELSE 'R' END AS kind FROM events)"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "


def pagerank(rounds: int = 12) -> str:
    parts = [GRAPH, DEG, "p0 AS (SELECT v, 0::BIGINT AS rank, (1000000 // (SELECT n FROM nv))::BIGINT AS delta, true AS active FROM vs)"]
    for k in range(rounds):
        new = "(coalesce(got, 0) * 85 * (SELECT n FROM nv) - 85000000) // (100 * (SELECT n FROM nv))" if k == 0 else "85 * coalesce(got, 0) // 100"
        parts.append(f"g{k} AS MATERIALIZED (SELECT e.d AS v, sum(p.delta // deg.k)::BIGINT AS got FROM e JOIN p{k} p ON p.v = e.s AND p.active JOIN deg ON deg.v = e.s GROUP BY e.d)")
        parts.append(f"n{k} AS MATERIALIZED (SELECT p.v, p.rank, p.delta AS old, p.active AS was, ({new})::BIGINT AS delta FROM p{k} p LEFT JOIN g{k} USING (v))")
        live = f"(SELECT bool_or(active) FROM p{k})"
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT v, CASE WHEN {live} THEN rank + delta ELSE rank END AS rank, CASE WHEN {live} THEN delta ELSE old END AS delta, CASE WHEN {live} THEN rank + delta > 0 AND (delta > (rank + delta) // 100 OR delta < -((rank + delta) // 100)) ELSE was END AS active FROM n{k})")
    return with_(*parts) + f"SELECT v, rank, delta, active FROM p{rounds}"


def power_rounds(rounds: int, modulus: int) -> str:
    """Products of the graph's matrix, each with the remainders of the one before."""
    parts = [GRAPH, "x0 AS (SELECT v, v % 7 + 1 AS x FROM vs)"]
    for k in range(rounds):
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT vs.v, coalesce(y, 0)::BIGINT AS x FROM vs LEFT JOIN (SELECT e.d AS v, sum(w * x) % {modulus} AS y FROM e JOIN x{k} ON x{k}.v = e.s GROUP BY e.d) USING (v))")
    return with_(*parts) + f"SELECT v::INT AS v, x FROM x{rounds}"


def nibble(rounds: int, gain: str, update: str, test: str, kind: str, out: str) -> str:
    parts = [GRAPH, DEG, f"p0 AS (SELECT range AS seed, range AS v, 0::{kind} AS rank, 1::{kind} AS residual, true AS front FROM range(3))"]
    for k in range(rounds):
        parts.append(f"g{k} AS MATERIALIZED (SELECT seed, e.d AS v, sum({update})::{kind} AS got FROM e JOIN p{k} p ON p.v = e.s AND p.front JOIN deg ON deg.v = e.s GROUP BY ALL)")
        parts.append(f"n{k} AS MATERIALIZED (SELECT coalesce(p.seed, g.seed) AS seed, coalesce(p.v, g.v) AS v, coalesce(CASE WHEN p.front THEN rank + {gain} ELSE rank END, 0) AS rank, coalesce(CASE WHEN p.front THEN 0 ELSE residual END, 0) + coalesce(got, 0) AS residual FROM p{k} p FULL JOIN g{k} g ON p.seed = g.seed AND p.v = g.v)")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT seed, n.v, rank, residual, coalesce(k, 0) > 0 AND residual >= coalesce(k, 0) * {test} AS front FROM n{k} n LEFT JOIN deg USING (v))")
    return with_(*parts) + f"SELECT seed::INT AS seed, v::INT AS v, {out} FROM p{rounds}"


LEVELS = "walk(v, l) AS (SELECT 0::BIGINT, 0 UNION SELECT e.d, l + 1 FROM walk JOIN e ON e.s = walk.v WHERE l < 40), lev AS (SELECT v, min(l) AS level FROM walk GROUP BY v)"
LABELS = """lab(v, label) USING KEY (v) AS (SELECT v, v AS label FROM vs UNION
  SELECT x.d, min(r.label) FROM lab r JOIN {edges} x ON x.s = r.v JOIN recurring.lab o ON o.v = x.d WHERE r.label < o.label GROUP BY x.d)"""
DIST = """dist(v, d) USING KEY (v) AS (SELECT v, CASE WHEN v = 0 THEN 0 ELSE 1073741823 END::BIGINT FROM vs UNION
  SELECT e.d, min(r.d + e.w) FROM dist r JOIN e ON e.s = r.v JOIN recurring.dist o ON o.v = e.d WHERE r.d < 1073741823 AND r.d + e.w < o.d GROUP BY e.d)"""
LRU = """{trace}, ln AS (SELECT *, addr - addr % {g} AS line FROM tr),
pv AS (SELECT *, lag(seq) OVER (PARTITION BY buffer, line ORDER BY seq) AS prev FROM ln),
hit AS (SELECT p.buffer, p.seq, p.line, p.kind, p.prev IS NOT NULL AND (SELECT count(DISTINCT q.line) FROM ln q WHERE q.buffer = p.buffer AND q.seq > p.prev AND q.seq < p.seq) < {lines} AS hit FROM pv p),
iv AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY buffer, line ORDER BY seq) AS stay FROM hit),
dirty AS (SELECT buffer, line, stay, bool_or(kind = 'U') AS dirty FROM iv GROUP BY ALL)"""

#: Accesses numbered per engine; where each would end an operation that starts here at the latest; and the operations one after another.
OPS = """t AS (SELECT buffer AS engine, row_number() OVER (PARTITION BY buffer ORDER BY seq) AS p, addr % 8 AS x, kind FROM tr),
nx AS (SELECT engine, p, kind, CASE WHEN kind = 'U' THEN p ELSE lead(p) OVER (PARTITION BY engine, x, kind ORDER BY p) END AS q FROM t),
st AS MATERIALIZED (SELECT engine, p, kind, min(q) OVER (PARTITION BY engine ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM nx),
op(engine, op, a, stop) AS (SELECT engine, 0::BIGINT, p, stop FROM st WHERE p = 1 AND stop IS NOT NULL
  UNION ALL SELECT o.engine, o.op + 1, n.p, n.stop FROM op o JOIN st k ON k.engine = o.engine AND k.p = o.stop
  JOIN st n ON n.engine = o.engine AND n.p = o.stop + (k.kind = 'U')::INT WHERE n.stop IS NOT NULL)"""
#: Every turn of a 16 x 16 product's nest by tiles of 8 x 8 x 4, and each access counted turn by turn.
FOOTPRINT = """WITH d AS (SELECT m1.range AS m1, n1.range AS n1, k1.range AS k1, 8 * m1.range + m0.range AS m, 8 * n1.range + n0.range AS n, 4 * k1.range + k0.range AS k, m0.range + k0.range AS w
  FROM range(2) m1, range(2) n1, range(4) k1, range(8) m0, range(8) n0, range(4) k0),
t AS (SELECT m1, n1, k1, count(DISTINCT (m, k)) AS a, count(DISTINCT (k, n)) AS b, count(DISTINCT (m, n)) AS z FROM d GROUP BY ALL)
SELECT 'A' AS tensor, 0 AS place, 'R' AS kind, max(a) AS volume, (SELECT count(*) FROM d) AS executions, sum(a)::DOUBLE AS backing, (SELECT count(*) FROM d)::DOUBLE AS local FROM t
UNION ALL SELECT 'B', 1, 'R', max(b), (SELECT count(*) FROM d), sum(b)::DOUBLE, (SELECT count(*) FROM d)::DOUBLE FROM t
UNION ALL SELECT 'Z', 2, 'U', max(z), (SELECT count(*) FROM d), sum(z)::DOUBLE * 0.5, (SELECT count(*) FROM d)::DOUBLE * 0.5 FROM t
UNION ALL SELECT 'I', 3, 'R', count(DISTINCT w), count(*), count(DISTINCT w)::DOUBLE, count(*)::DOUBLE FROM d"""
