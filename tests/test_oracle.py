"""Every query of the trade catalogue against its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from tradelake.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, type(v).__name__, round(v, 3) if isinstance(v, float) else v) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if name not in ORACLE_SQL:
        assert rows
        return
    sql = ORACLE_SQL[name]
    assert sorted(r[0] for r in duck.sql("describe " + sql).fetchall()) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert rows == ordered([tuple(map(plain, r)) for r in duck.sql(f"select {picked} from ({sql})").fetchall()])
