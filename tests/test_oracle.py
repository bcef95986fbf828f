"""Every registered query equals its DuckDB oracle (sf 0.001, all tables whole)."""

import decimal
import math

import duckdb
import pytest

from __spark_entry__ import entry
from ledgerlens.plans.oracle import oracle_sql
from ledgerlens.plans.queries import queries
from ledgerlens.sources.tables import TABLES
from tests.conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral() else str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_key_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_matches_oracle(spark, duck, key):
    df = queries()[key](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[key])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _canon(df.columns, s_rows) == _canon(d_cols, d_rows)


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["reconcile_status", "reconcile_class", "description", "order_count", "total_amount",
                          "avg_amount", "percent"]
