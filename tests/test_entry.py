"""The registry, and parity with SQL where the reference database is installed."""

import math

import pytest

import __spark_entry__ as entry
from touchline.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "team_metrics_asof" in entry.queries()


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)[:19]

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", ["league_table", "rolling_form", "integrity", "fair_shin", "settle_all", "season_breakdown", "reconcile_band_join", "availability_window"])
def test_parity(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({queries.ORACLE[name]})").fetchall()
    assert plain(map(tuple, df.select(columns).collect())) == plain(want)
