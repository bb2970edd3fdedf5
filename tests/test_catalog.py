"""Every query against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftspark.plans import catalog

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (bool, str)):
        return str(value)
    return f"{float(value):.6f}"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    wanted = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == wanted
