"""Every driver query against its DuckDB form, at the smallest scale."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from posada.plans import driver_queries

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = driver_queries.queries(), driver_queries.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert columns
        return
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(x[i]) for i in at) for x in found.fetchall()), key=repr)


def test_invoice_totals_of_all_orders(spark):
    """q29 extracts every order's invoice, with the total that its text shows."""
    cent = decimal.Decimal("0.01")
    want = {}
    for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_totalprice").collect():
        base = decimal.Decimal(str(r.o_totalprice)).quantize(cent, decimal.ROUND_HALF_UP)
        want[r.o_orderkey] = base + (base / 10).quantize(cent, decimal.ROUND_HALF_UP)
    got = {r.document_id: r.total for r in QUERIES["q29_invoice_totals"](spark, DATA).collect()}
    assert got == want


@pytest.mark.parametrize("name, rows", [("ud03_invoice_lines", "SELECT count(DISTINCT l_orderkey) FROM lineitem"), ("d02_reversal", "SELECT count(*) FROM lineitem")])
def test_whole_tables(spark, duck, name, rows):
    """These leave out no order or entry; their values are compared in test_query."""
    assert QUERIES[name](spark, DATA).count() >= duck.execute(rows).fetchone()[0]
