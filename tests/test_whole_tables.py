"""Registered queries reach every match of the tables, not a slice of them."""

import os

import pytest
from test_entry import DATA, TABLES, plain

from touchline.plans import lens, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def by_sql(sql, columns):
    """Rows of sql in the reference database."""
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return plain(con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall())


@pytest.mark.parametrize("name", ["goal_markets", "correct_scores", "total_distribution", "count_totals", "day_picks", "total_fit", "price_offered", "reconcile_band_join"])
def test_every_match_is_covered(spark, name):
    """Query and SQL both reach every match of the table, and agree."""
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert "% 10 = 0" not in queries.ORACLE[name] and "% 3 = 0" not in queries.ORACLE[name].replace("bookmaker = 'betfair_exchange' AND CAST(m.match_id AS BIGINT) % 3 = 0", "")
    key = {"reconcile_band_join": "content_hash"}.get(name, "match_id")
    if key in columns:
        assert df.select(key).distinct().count() == lens.read(spark, DATA, "matches").count()
    assert plain(map(tuple, df.select(columns).collect())) == by_sql(queries.ORACLE[name], columns)


def test_every_match_has_its_week(spark):
    df = queries.QUERIES["weekly_buckets"](spark, DATA)
    n, first, last = lens.read(spark, DATA, "matches").selectExpr("count(*)", "min(date)", "max(date)").first()
    assert df.count() == n and df.selectExpr("min(as_of)", "max(bucket)").first() == (first, (last - first).days // 7)
    columns = sorted(df.columns)
    assert plain(map(tuple, df.select(columns).collect())) == by_sql(queries.ORACLE["weekly_buckets"], columns)


def test_effects_are_of_all_seasons_and_draws(spark, monkeypatch):
    seen = {}

    def study(rows, keys, draws=200):
        seen.update(draws=draws, seasons=rows.select("match_id").join(lens.read(spark, DATA, "matches"), "match_id").select("season_start_year").distinct().count())
        return rows.select("match_id")

    monkeypatch.setattr(queries.research, "offset_poisson", study)
    queries.QUERIES["availability_effect"](spark, DATA)
    assert seen["draws"] == 200 and seen["seasons"] > 1
