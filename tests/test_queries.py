"""Every registered query against its oracle SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from ledgerspark import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    want = db.sql(catalog.oracle_sql()[name])
    assert table_of(df.columns, df.collect()) == table_of(want.columns, want.fetchall())


def test_no_cartesian_product(spark):
    for name in ("emparejar_facturas", "nit_igual_join", "rango_dian", "resumen_registros", "panorama_validados"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
