"""Identities, recovery, look-ahead and idempotence of the odds engine."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline import config, schema
from touchline.functions import dates, names, pricing, settlement
from touchline.operators import archive, availability, fair, fits, matrix, profile, quality, scoring, teams
from touchline.plans import build, research, scan, walk
from touchline.sources import feeds, generator, season_files
from touchline.sources.store import Store, export_csv, import_rows, require_fresh
from touchline.streaming import archive as stream


@pytest.fixture(scope="module")
def season():
    return pd.concat([generator.season(12, dt.date(2022 + k, 8, 6), seed=k) for k in range(3)], ignore_index=True)


@pytest.fixture(scope="module")
def matches(spark, season):
    frame = season.assign(season_start_year=season["date"].map(lambda d: d.year - (d.month < 8)), total_goals=season.home_goals + season.away_goals, btts=(season.home_goals > 0) & (season.away_goals > 0))
    return spark.createDataFrame(frame).cache()


def shin_reference(prices):
    q = np.array([1 / p for p in prices])
    s = q.sum()
    f = lambda z: (np.sqrt(z * z + 4 * (1 - z) * q * q / s) - z) / (2 * (1 - z))
    if s <= 1 or f(0.4).sum() > 1:
        return q / s
    low, high = 1e-12, 0.4
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid).sum() > 1 else (low, mid)
    return f(low) / f(low).sum()


def test_margins(spark):
    rows = [[2.1, 3.4, 3.6], [1.01, 20.0, 51.0], [1.9, 1.95], [2.2, 2.2], [1.0, 3.0], [None, 2.0], [1.5]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, p array<double>")
    got = df.select("k", *[m(F.col("p")).alias(n) for n, m in pricing.METHODS.items()]).orderBy("k").collect()
    for k in range(4):
        assert np.allclose(got[k]["shin"], shin_reference(rows[k])) and math.isclose(sum(got[k]["additive"]), 1) and min(got[k]["additive"]) > 0
        assert np.allclose(got[k]["multiplicative"], np.array([1 / p for p in rows[k]]) / sum(1 / p for p in rows[k]))
    assert all(got[k][m] is None for k in (4, 5, 6) for m in pricing.METHODS)


def test_settlement(spark):
    cases = [
        ("1x2", "home", None, 2, 1, 1, 0), ("draw_no_bet", "away", None, 1, 1, 0, 1), ("double_chance", "draw_or_away", None, 0, 2, 1, 0), ("winning_margin", "home_3_plus", None, 5, 1, 1, 0), ("btts", "no", None, 2, 0, 1, 0),
        ("total_goals", "over", 3.0, 2, 1, 0, 1), ("total_goals", "under", 2.75 - 0.25, 1, 1, 1, 0), ("asian_handicap", "home", -0.25, 1, 1, 0, 0.5), ("asian_handicap", "away", 0.25, 1, 1, 0.5, 0.5), ("asian_handicap", "home", -0.75, 2, 1, 0.5, 0.5),
        ("asian_handicap", "away", 1.0, 2, 1, 0, 1), ("correct_score", "2-1", None, 2, 1, 1, 0), ("total_corners", "over", 9.5, 1, 0, None, None), ("1x2_ht", "home", None, 1, 0, None, None),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "market string, selection string, line double, home_goals int, away_goals int")
    df = df.withColumns({c: F.lit(None).cast("int") for c in ("home_goals_ht", "away_goals_ht", "home_corners", "away_corners", "home_cards", "away_cards", "total_corners", "total_cards")})
    got = df.select(settlement.settle(F.col("market"), F.col("selection"), F.col("line")).alias("o")).collect()
    assert [(None, None) if r["o"] is None else (r["o"]["win"], r["o"]["push"]) for r in got] == [c[5:] for c in cases]
    with pytest.raises(Exception, match="no settlement rule"):
        df.limit(1).withColumn("market", F.lit("odd_even_goals")).select(settlement.settle(F.col("market"), F.col("selection"), F.col("line"))).collect()


def test_markets_agree_with_each_other(spark):
    rates = spark.createDataFrame([(1, 1.6, 1.1, -0.08), (2, 0.4, 2.3, 0.1), (3, 3.1, 0.2, 0.0)], "k int, lam double, mu double, rho double")
    cell = matrix.cells(rates, ["k"]).cache()
    assert all(math.isclose(r[1], 1, abs_tol=1e-9) for r in cell.groupBy("k").agg(F.sum("p")).collect())
    rows = matrix.all_goal_markets(cell, ["k"], handicaps=(-0.5, 0.0, -0.25)).collect()
    for k in (1, 2, 3):
        p = {(r["market"], r["selection"], r["line"]): (r["probability"], r["push_probability"]) for r in rows if r["k"] == k}
        h, d, a = (p["1x2", s, None][0] for s in ("home", "draw", "away"))
        assert math.isclose(h + d + a, 1, abs_tol=1e-9) and math.isclose(p["double_chance", "home_or_draw", None][0], h + d)
        assert math.isclose(p["asian_handicap", "home", -0.5][0], h) and math.isclose(p["asian_handicap", "home", 0.0][0], h) and math.isclose(p["asian_handicap", "home", 0.0][1], d)
        assert p["draw_no_bet", "away", None] == pytest.approx((a, d)) and math.isclose(sum(v[0] for q, v in p.items() if q[0] == "winning_margin"), 1, abs_tol=1e-9)
        assert math.isclose(p["asian_handicap", "home", -0.25][0], h) and math.isclose(p["asian_handicap", "home", -0.25][1], d / 2) and math.isclose(p["asian_handicap", "away", 0.25][0], a + d / 2)
        assert math.isclose(p["total_goals", "over", 2.5][0] + p["total_goals", "under", 2.5][0], 1, abs_tol=1e-9) and p["btts", "yes", None][0] <= p["home_goals", "over", 0.5][0]
        assert sum(q[0] == "correct_score" for q in p) == 8
    t = matrix.totals(cell, ["k"]).where("k = 1").first()
    assert math.isclose(sum(t["total_pmf"]), 1, abs_tol=1e-9) and math.isclose(sum(x * y for x, y in enumerate(t["total_pmf"])), t["expected_total"])


def test_counts(spark):
    df = spark.createDataFrame([(1, 5.0, 8.0)], "k int, m double, d double").select("k", matrix.count_pmf(F.col("m"), F.col("d")).alias("pmf"))
    pmf = df.first()["pmf"]
    mean = sum(k * p for k, p in enumerate(pmf))
    assert len(pmf) == 41 and math.isclose(sum(pmf), 1) and abs(mean - 5) < 1e-3 and abs(sum((k - mean) ** 2 * p for k, p in enumerate(pmf)) - (5 + 25 / 8)) < 0.02
    h = matrix.count_handicaps(df, ["k"], "pmf", "pmf", "corner_handicap", (0.0,)).collect()
    assert math.isclose(h[0]["probability"], h[1]["probability"]) and {r["market"] for r in h} == {"corner_handicap"}


def test_fit_recovers_strengths(season):
    rows = season.assign(weight=1.0)
    m = fits.goals(rows, target="goals")
    truth = generator.strengths(12, 1000)
    assert m.converged and abs(m.home_advantage - generator.HOME) < 0.2 and abs(m.rho) <= config.RHO_BOUND
    assert len(m.teams) == 12 and set(m.matches) == {66} and len(truth) == 12
    blend = fits.goals(rows)
    assert blend.target == "blend" and np.corrcoef(m.attack, blend.attack)[0, 1] > 0.7
    assert fits.goals(rows, ridge="auto").ridge_attack > 0 and fits.goals(rows, ridge="auto-split").ridge_attack > 0
    with pytest.raises(fits.TooFewMatches):
        fits.goals(rows.head(30))
    with pytest.raises(fits.NoChances):
        fits.goals(rows.drop(columns=["home_xg", "away_xg"]), target="xg")


def test_fit_slope_is_that_of_its_value():
    r = np.random.default_rng(0)
    sides = fits.Sides(r.integers(0, 4, 80), r.integers(0, 4, 80), 4)
    x, y = r.poisson(1.4, 80).astype(float), r.poisson(1.1, 80).astype(float)
    theta, rho, done = fits._poisson_stage(sides, x, y, np.ones(80), (2.0, 2.0), np.zeros(10), True)
    matrix_, z = sides.matrix(), np.r_[x, y]

    def value(v):
        eta = matrix_ @ v
        return -(z * eta - np.exp(eta)).sum() - np.log(fits.low_scores(x, y, np.exp(eta[:80]), np.exp(eta[80:]), rho)[0]).sum() + 2 * (v[2:] ** 2).sum()

    steps = np.eye(10) * 1e-5
    assert done and np.abs([(value(theta + s) - value(theta - s)) / 2e-5 for s in steps]).max() < 1e-2


def test_count_fit(season):
    m = fits.counts(season.assign(weight=1.0), "corners")
    assert m.converged and 3 < m.dispersion < 40 and 3 < m.total_dispersion < 80 and abs(math.exp(m.intercept) - 4.5) < 1
    with_referee = fits.counts(season.assign(weight=1.0), "corners", referees=True)
    assert len(with_referee.referees) == 6 and max(map(abs, with_referee.referees.values())) < 0.3


def test_nothing_later_moves_a_profile(spark, matches, season):
    rows = teams.team_matches(matches)
    day = str(season["date"].sort_values().iloc[250])
    later = matches.withColumn("home_goals", F.when(F.col("date") >= day, 9).otherwise(F.col("home_goals")))
    key = lambda df: sorted(map(str, df.collect()))
    for f in (lambda r: profile.metrics(teams.before(r, day), ["team"]), lambda r: profile.form_lines(r, day), lambda r: profile.rest(r, day)):
        assert key(f(rows)) == key(f(teams.team_matches(later)))
    t = teams.training_rows(matches, day, 180.0)
    assert t.agg(F.max("date")).first()[0] < dt.date.fromisoformat(day) and t.where("weight > 1 or weight <= 0").count() == 0


def test_availability_never_reads_its_own_match(spark):
    games = [(f"m{k:02d}", dt.date(2024, 1, 1) + dt.timedelta(days=7 * k), "A", "B") for k in range(14)]
    rows = [(f"m{k:02d}", True, p, 90, True, 0.5) for k in range(14) for p in ("p1", "p2", "p3") if not (p == "p1" and k == 10)]
    lineups = spark.createDataFrame(rows, "match_id string, is_home boolean, player_id string, minutes int, started boolean, xgchain double")
    fixtures = spark.createDataFrame(games, "match_id string, date date, home_team string, away_team string")
    f = {r["match_id"]: r for r in availability.features(availability.appearances(lineups, fixtures)).collect()}
    assert f["m05"]["missing_share"] is None and f["m06"]["missing_share"] == 0 and f["m10"]["n_missing"] == 0
    assert f["m11"]["n_missing"] == 1 and math.isclose(f["m11"]["missing_share"], 1 / 11) and math.isclose(f["m11"]["missing_xgchain_share"], 1 / 3)
    up = spark.createDataFrame([("next", dt.date(2025, 1, 1), "A", "B")], "match_id string, date date, home_team string, away_team string")
    assert {(r["team"], r["n_prior"]) for r in availability.for_unplayed(lineups, fixtures, up).collect()} == {("A", 14), ("B", 0)}


def test_files_to_tables(spark, season, tmp_path):
    first = season[season.date < dt.date(2023, 7, 1)]
    for k, old in enumerate((False, True)):
        (tmp_path / f"s{k}.csv").write_text(generator.season_csv(first.assign(home_team=first.home_team.replace("Club 00", "Manchester United")), old))
    m, odds = season_files.season(spark, str(tmp_path / "s0.csv"), "E0", 2022)
    assert m.count() == len(first) and m.select("match_id").distinct().count() == len(first) and m.columns == [f.split()[0] for f in schema.MATCHES.split(", ")]
    assert m.where("home_team = 'Man United'").count() == 11 and m.where("total_goals <> home_goals + away_goals or home_shots is not null").count() == 0
    assert odds.where("bookmaker = 'pinnacle'").count() == 6 * len(first) and odds.where("price <= 1").count() == 0
    both = {(r["match_id"]): r for r in odds.where("market = 'asian_handicap'").groupBy("match_id").agg(F.sum("line").alias("s"), F.count("*").alias("n")).collect()}
    assert all(r["s"] == 0 and r["n"] == 2 for r in both.values())
    o, p = (season_files.season(spark, str(tmp_path / f"s{k}.csv"), "E0", 2022)[1].where("market = '1x2'").count() for k in (0, 1))
    assert o == p
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        report, failed = build.database(spark, store, [("E0", 2022, str(tmp_path / "s0.csv")), ("E0", 2022, str(tmp_path / "none.csv"))], "2024-01-01")
        assert len(failed) == 1 and store.read("matches", schema.MATCHES).count() == len(first)
    assert {r["check"]: r["failures"] for r in report["integrity"].collect() if r["failures"]} == {}
    assert store.read("odds", schema.ODDS).count() == odds.count() and not store.exists("injuries")
    assert quality.overrounds(odds).count() == 4 * len(first)


def test_fair_line_falls_back_by_market(spark):
    rows = [("m", b, ph, "1x2", s, None, x) for b, ph in (("bet365", "open"), ("zbook", "open")) for s, x in (("home", 2.0), ("draw", 3.5), ("away", 4.2))]
    rows += [("m", "pinnacle", "close", "1x2", "home", None, 2.1), ("m", "abook", "close", "total_goals", "over", 2.5, 1.9), ("m", "abook", "close", "total_goals", "under", 2.5, 2.0)]
    odds = spark.createDataFrame(rows, schema.ODDS)
    got = {(r["market"], r["selection"]): r["fair_line_source"] for r in fair.fair_probabilities(odds).collect()}
    assert got == {("1x2", s): "bet365" for s in ("home", "draw", "away")} | {("total_goals", s): "abook" for s in ("over", "under")}
    assert {r["market"] for r in fair.fair_probabilities(odds, fallback=False).collect()} == {"1x2"}


def test_repeated_prices_of_a_book(spark):
    """The smallest price of a book and phase counts; a repeat loses no market and ends no job."""
    rows = [("m", "bet365", ph, "1x2", s, None, x) for ph, more in (("open", 0.1), ("close", 0.0)) for s, x in (("home", 2.0 + more), ("draw", 3.5 + more), ("away", 4.2 + more))]
    again = [("m", "bet365", "close", "1x2", "home", None, 2.2), ("m", "bet365", "open", "1x2", "home", None, 2.3), ("m", "bet365", "close", "1x2", "away", None, 1.0)]
    odds, more = spark.createDataFrame(rows, schema.ODDS), spark.createDataFrame(rows + again, schema.ODDS)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(fair.fair_probabilities(more)) == key(fair.fair_probabilities(odds)) and fair.fair_probabilities(odds).count() == 3
    got = {r["selection"]: r for r in fair.chosen_prices(more, books=True).collect()}
    assert got["home"]["price_taken"] == 2.1 and got["home"]["same_book_close"] == 2.0 and got["home"]["opens"] == {"bet365": 2.1}


def test_shin_sums_to_one_and_favours_the_favourite(spark):
    def solved(prices):  # the same equation by bisection
        q = [1 / x for x in prices]
        s, low, high = sum(q), 1e-12, 0.4
        at = lambda z: [(math.sqrt(z * z + 4 * (1 - z) * x * x / s) - z) / (2 * (1 - z)) for x in q]
        if s <= 1 or sum(at(high)) > 1:
            return [x / s for x in q]
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(at(mid)) > 1 else (low, mid)
        return [x / sum(at(low)) for x in at(low)]

    for prices in ([1.05, 11.0, 26.0], [2.0, 3.5, 4.2], [1.9, 1.9], [1.2, 4.0], [2.2, 2.2], [1.01, 1.01, 1.01], [1.5, 2.0, 501.0]):
        got = spark.range(1).select(pricing.shin(F.array(*[F.lit(x) for x in prices]))).first()[0]
        assert got == pytest.approx(solved(prices), abs=1e-9)


def test_repeated_fixtures_keep_the_first_hash(spark):
    columns = "Div string, Date string, Time string, HomeTeam string, AwayTeam string, B365H string, B365D string, B365A string"
    rows = [("E0", "02/09/2026", "15:00", "Arsenal", "Spurs", x, "3.4", "4.0") for x in ("2.0", "2.1", "2.2", "2.0")]
    hashes = [archive.snapshot(spark.createDataFrame([r], columns), F.current_timestamp())[0].first()["content_hash"] for r in rows]
    got = archive.snapshot(spark.createDataFrame(rows, columns), F.current_timestamp())[0].collect()
    assert [r["content_hash"] for r in got] == [min(hashes)]


def test_archive_is_append_only(spark, tmp_path):
    raw = spark.createDataFrame([("E0", "02/09/2026", "15:00", "Arsenal", "Spurs", "2.0", "3.4", "4.0")], "Div string, Date string, Time string, HomeTeam string, AwayTeam string, B365H string, B365D string, B365A string")
    store = Store(spark, str(tmp_path / "a"))
    at = lambda s: F.lit(s).cast("timestamp")
    assert archive.store_snapshot(store, raw, at("2026-08-28 18:00:00"))["new_snapshots"] == 1
    assert archive.store_snapshot(store, raw.withColumn("B365H", F.lit("2.00")), at("2026-08-29 18:00:00"))["repeat_snapshots"] == 1
    archive.store_snapshot(store, raw.withColumn("B365H", F.lit("2.1")), at("2026-08-30 18:00:00"))
    snaps = store.read("fixture_snapshots", schema.SNAPSHOTS)
    assert snaps.count() == 2 and store.read("snapshot_odds", schema.SNAPSHOT_ODDS).count() == 6
    assert snaps.agg(F.max(F.datediff("last_pulled_at_utc", "first_pulled_at_utc"))).first()[0] == 1
    assert archive.latest(snaps).count() == 1 and snaps.first()["collection_window"] == "midweek" and snaps.first()["away_team"] == "Tottenham"
    played = spark.createDataFrame([("x", "E0", dt.date(2026, 9, 3), "Arsenal", "Tottenham"), ("y", "E0", dt.date(2026, 9, 9), "Arsenal", "Tottenham")], "match_id string, league string, date date, home_team string, away_team string")
    assert {r["match_id"] for r in archive.reconciled(snaps, played).collect()} == {"x"}
    assert archive.coverage(snaps, "2026-09-01").first()["awaiting_kickoff"] == 2


def test_stream_merges_what_batches_bring_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("h1", "k", "E0", dt.datetime(2026, 8, 1)), ("h2", "k", "E0", dt.datetime(2026, 8, 2))], "content_hash string, fixture_key string, league string, first_pulled_at_utc timestamp")
    full = rows.select([F.col(c) if c in rows.columns else F.col("first_pulled_at_utc").alias(c) if c == "last_pulled_at_utc" else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in schema.SNAPSHOTS.split(", "))])
    full.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        q = spark.readStream.schema(full.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(stream.merge_into(store)).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert store.read("fixture_snapshots", schema.SNAPSHOTS).count() == 2


def test_feeds(spark, tmp_path):
    def put(name, x, kind):
        (tmp_path / name).write_text(json.dumps(x))
        return feeds.read(spark, str(tmp_path / name), kind)

    clubs = spark.createDataFrame([("Marseille",), ("Lyon",), ("Paris SG",)], "team string")
    cal = put("a.json", {"name": "x", "matches": [{"round": "1", "date": "2026-08-22", "time": "20:45", "team1": "Olympique de Marseille", "team2": "Olympique Lyonnais", "score": {"ft": [2, 1], "ht": [0, 0]}}, {"round": "1", "date": "2026-08-23", "team1": "Paris Saint-Germain FC", "team2": "Lyon", "score": [0, 3]}, {"round": "2", "date": "2026-08-30", "team1": "Lyon", "team2": "PSG", "score": None}]}, feeds.OPEN_CALENDAR)
    got = feeds.open_calendar(cal, "F1", 2026, clubs).orderBy("kickoff_utc").collect()
    assert [(r["home_team"], r["away_team"], r["home_goals"], r["played"]) for r in got] == [("Marseille", "Lyon", 2, True), ("Paris SG", "Lyon", 0, True), ("Lyon", "Paris SG", None, False)]
    assert got[0]["kickoff_utc"] == dt.datetime(2026, 8, 22, 18, 45)
    with pytest.raises(feeds.Refused, match="Lens"):
        feeds.open_calendar(put("b.json", {"matches": [{"date": "2026-08-22", "team1": "Lens", "team2": "Lyon"}]}, feeds.OPEN_CALENDAR), "F1", 2026, clubs)
    s = put("c.json", {"dates": [{"id": "1", "isResult": True, "datetime": "2026-08-22 19:00:00", "h": {"title": "Lyon"}, "a": {"title": "Marseille"}, "goals": {"h": "1", "a": "0"}, "xG": {"h": "1.5", "a": "nan"}}, {"id": "2", "isResult": False, "datetime": "2026-08-29 19:00:00", "h": {"title": "Lyon"}, "a": {"title": "Marseille"}, "goals": {"h": None, "a": None}, "xG": {"h": "0", "a": "0"}}], "teams": {"9": {"id": "9", "title": "Lyon", "history": [{"h_a": "h", "date": "2026-08-22 19:00:00", "xG": 1.5, "npxG": 0.7, "xGA": 1, "npxGA": 1, "deep": 3, "scored": 1}]}}}, feeds.SEASON)
    rows = feeds.season_calendar(s, "F1", 2026).orderBy("feed_id").collect()
    assert rows[0]["home_xg"] == 1.5 and rows[0]["away_xg"] is None and rows[1]["home_xg"] is None and feeds.played_matches(s, "F1", 2026).count() == 1
    assert feeds.team_history(s, "F1", 2026).first()["npxg"] == 0.7
    r = put("d.json", {"rosters": {"h": {"1": {"player_id": "7", "player": "O&#039;Neil", "position": "Sub", "time": "20", "xGChain": "0.1"}}, "a": {"2": {"player_id": "8", "player": "B", "position": "FW", "time": "90"}}}}, feeds.ROSTER)
    p = {x["player_id"]: x for x in feeds.roster(r, F.lit("m")).collect()}
    assert p["7"]["player"] == "O'Neil" and not p["7"]["started"] and p["8"]["started"] and not p["8"]["is_home"]
    i = {"errors": [], "paging": {"current": 1, "total": 1}, "response": [{"player": {"id": 1, "name": "X", "type": "Missing Fixture", "reason": "Knee"}, "team": {"id": 1, "name": "Olympique Lyonnais"}, "fixture": {"id": 1, "date": "2026-08-22T19:00:00+00:00"}}] * 2}
    good, lost = feeds.injuries(put("e.json", i, feeds.INJURIES), "F1", 2026, clubs, F.current_timestamp())
    assert good.count() == 1 and good.first()["ruled_out"] and lost.count() == 0
    with pytest.raises(feeds.Refused):
        feeds.injuries(put("f.json", i | {"paging": {"current": 1, "total": 2}}, feeds.INJURIES), "F1", 2026, clubs, F.current_timestamp())
    assert feeds.resolve_source("auto", False) == "open" and feeds.resolve_source("auto", True) == "keyed"


def test_names_and_dates(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(names.canonical_team(F.lit("1. Borussia Mönchengladbach".replace("1. ", "")))) == "M'gladbach" and one(names.slug(F.lit("Nott'm Forest"))) == "nott_m_forest"
    assert one(names.external_key(F.lit("FC Augsburg 1907"))) == "augsburg" and one(names.external_key(F.lit("FC"))) == "fc" and one(names.referee(F.lit(" M.  Oliver "))) == "M Oliver"
    assert [one(dates.match_date(F.lit(t))) for t in ("05/08/2023", "5/8/23", "1/1/70", "2023-08-05", "x", "")] == [dt.date(2023, 8, 5), dt.date(2023, 8, 5), dt.date(1970, 1, 1), dt.date(2023, 8, 5), None, None]
    w = one(dates.collection_window(F.lit("2026-08-31").cast("date")))
    assert w["window"] == "weekend" and w["collected_at"] == dt.datetime(2026, 8, 28, 16)
    known = spark.createDataFrame([(t,) for t in ("Man City", "Man United", "Ath Madrid", "Milan", "Inter")], "team string")
    asked = spark.createDataFrame([(q,) for q in ("manchester city", "man", "ATH MADRID", "atletico", "mil", "zzz")], "query string")
    assert {r["query"]: r["team"] for r in names.typed(asked, known).collect()} == {"manchester city": "Man City", "man": None, "ATH MADRID": "Ath Madrid", "atletico": "Ath Madrid", "mil": "Milan", "zzz": None}


def test_refused_fits(spark, matches):
    few = matches.limit(2).withColumn("weight", F.lit(1.0))
    for got in (fits.fit_goals(few, ["league"]), fits.fit_counts(few, ["league"], "corners")):
        row = got.first()
        assert row["status"] != "ok" and row["intercept"] is None and row["ratings"] == [] and not row["converged"]
    assert fits.fit_goals(few, ["league"]).first()["target"] is None


def test_walk_forward(spark, matches, season):
    last = season["date"].max()
    w = walk.Walk(str(last - dt.timedelta(days=20)), str(last), half_life=180.0, target="goals")
    r = np.random.default_rng(2)
    ids = season[season.date > last - dt.timedelta(days=21)]["match_id"]
    odds = spark.createDataFrame([(m, b, ph, "1x2", s, None, float(round(x + r.uniform(0, 0.1), 2))) for m in ids for b, ph in (("market_max", "open"), ("pinnacle", "close")) for s, x in (("home", 2.2), ("draw", 3.3), ("away", 3.4))], schema.ODDS)
    rows = walk.predictions(matches, odds, w).cache()
    n = rows.where("not priceless").count()
    assert n == 3 * walk.bucketed(matches, w).count() and rows.where("priceless and (expected_value is not null or price_taken is not null)").count() == 0
    assert rows.where("not priceless and (clv is null or profit_at_taken is null or size(book_prices) <> 1)").count() == 0
    assert {r["state"] for r in scoring.evidence(rows.where("market in ('1x2', 'btts')")).collect()} == {"backtested", "calibration-only"}
    changed = matches.withColumn("home_goals", F.when(F.col("date") >= w.start, 8).otherwise(F.col("home_goals")))
    first = walk.bucketed(matches, w).agg(F.min("as_of")).first()[0]
    pick = lambda df: df.where(F.col("as_of") == F.lit(first)).select("intercept", "home_advantage").first()
    assert pick(walk.weekly_fits(matches, w)) == pick(walk.weekly_fits(changed, w))


def test_scan_withholds_and_drops_nothing(spark):
    t = lambda n, ev: spark.range(1).select(scan.reasons(F.lit(n), F.lit(30), F.lit(ev))).first()[0]
    assert t(30, 0.1) == "" and "one side has 1 match of" in t(1, 0.1) and "; and " in t(2, 0.5)


def test_scores_by_hand(spark):
    rows = [("L", f"m{k}", dt.date(2024, 1, 1 + k % 9), "1x2", "home", None, 0.1 * (k % 10) + 0.04, None, float(k % 3 == 0), 0.0, 0.05, 0.01 * (k - 20), None, 2.0, 1.0 if k % 3 == 0 else -1.0, 0.5) for k in range(60)]
    df = spark.createDataFrame(rows, "league string, match_id string, date date, market string, selection string, line double, model_conditional double, market_probability double, win_fraction double, push_fraction double, expected_value double, clv double, price_movement double, price_taken double, profit_at_taken double, model_probability double")
    s = scoring.market_scores(df).first()
    p, y = np.array([r[6] for r in rows]), np.array([r[8] for r in rows])
    assert math.isclose(s["model_log_loss"], -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) and s["n_priced"] is None
    c = scoring.clustered(df, ["league"], "clv", "date").first()
    v, g = np.array([r[11] for r in rows]), np.array([r[2].day for r in rows])
    sums = np.array([(v - v.mean())[g == d].sum() for d in sorted(set(g))])
    assert math.isclose(c["se"], math.sqrt(9 / 8 * (sums**2).sum()) / 60)
    slope = scoring.calibration_slope(df, ["market"]).first()
    x = np.log(p / (1 - p))
    mu = 1 / (1 + np.exp(-(slope["intercept"] + slope["slope"] * x)))
    assert abs((y - mu).sum()) < 1e-6 and abs(((y - mu) * x).sum()) < 1e-6
    led = scoring.flat_ledger(df).orderBy("date", "match_id").collect()
    assert led[-1]["turnover"] == 60 and all(r["drawdown"] <= 0 for r in led)
    k = scoring.kelly_ledger(df.withColumn("model_probability", F.lit(0.6))).first()
    assert k["bets"] == 60 and k["max_drawdown"] <= 0
    b = scoring.bootstrap_roi(df).first()
    assert b["roi_low"] <= b["roi"] <= b["roi_high"] and scoring.bootstrap_roi(df.limit(5)).first()["roi"] is None


def test_files_in_latin_1_are_read(spark, tmp_path):
    for name, encoding in (("a.csv", "latin-1"), ("b.csv", "utf-8-sig")):
        (tmp_path / name).write_bytes("Div,HomeTeam\nD1,1. FC Köln\n".encode(encoding))
        raw = season_files.read_raw(spark, str(tmp_path / name))
        assert raw.columns == ["Div", "HomeTeam"] and [r["HomeTeam"] for r in raw.collect()] == ["1. FC Köln"]


def test_append_keeps_what_is_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda k: spark.createDataFrame([(k, "x")], "n int, t string")
    for k in range(3):
        store.append("log", rows(k), "n int, t string")
    assert sorted(r["n"] for r in store.read("log", "n int, t string").collect()) == [0, 1, 2] and store._versions("log") == [1]


def test_count_markets_at_a_books_line(spark):
    pmf = [0.5, 0.3, 0.2]
    rows = spark.createDataFrame([("m", pmf, [0.6, 0.4], pmf)], "match_id string, home array<double>, away array<double>, both array<double>")
    offered = [("total_corners", "over", 1.0), ("home_total_corners", "under", 1.5), ("corner_handicap", "home", -0.25), ("corner_handicap", "away", 1.0), ("total_cards", "over", 0.5), ("total_corners", "over", None)]
    got = matrix.price_counts(rows, spark.createDataFrame([("m", *o) for o in offered], "match_id string, market string, selection string, line double"), ["match_id"], "corners")
    found = {(r["market"], r["selection"], r["line"]): (r["probability"], r["push_probability"]) for r in got.collect()}
    joint = {(i, j): p * q for i, p in enumerate(pmf) for j, q in enumerate([0.6, 0.4])}
    level, ahead = sum(p for (i, j), p in joint.items() if i == j), sum(p for (i, j), p in joint.items() if i > j)
    assert found["total_corners", "over", 1.0] == pytest.approx((0.2, 0.3)) and found["home_total_corners", "under", 1.5] == pytest.approx((0.8, 0.0))
    assert found["corner_handicap", "home", -0.25] == pytest.approx((ahead, level / 2))
    assert found["corner_handicap", "away", 1.0] == pytest.approx((1 - ahead, sum(p for (i, j), p in joint.items() if i - j == 1)))
    assert found["total_cards", "over", 0.5] == (None, None) == found["total_corners", "over", None]


def test_all_checked_markets_have_records(matches, season):
    last = season["date"].max()
    w = walk.Walk(str(last - dt.timedelta(days=13)), str(last), target="goals", halves=True, counted=("corners", "cards"))
    half = lambda c: (F.col(c) / 2).cast("int")
    more = {"home_goals_ht": half("home_goals"), "away_goals_ht": half("away_goals"), "home_yellows": half("home_corners"), "away_yellows": half("away_corners")}
    rows = walk.predictions(matches.withColumns(more), None, w)
    got = {r["market"]: r for r in rows.groupBy("market").agg(F.sum(F.when(F.col("selection").isin("home", "over"), F.col("win_fraction"))).alias("wins"), F.count("*").alias("n")).collect()}
    assert set(got) == set(config.CALIBRATED_MARKETS)
    assert rows.where("not priceless or expected_value is not null or model_probability <= 0").count() == 0
    played = season[season.date >= last - dt.timedelta(days=13)]
    assert got["1x2_ht"]["wins"] == (played.home_goals // 2 > played.away_goals // 2).sum()


def test_grid_fits_each_choice_once(matches, season):
    last = season["date"].max()
    w = walk.Walk(str(last - dt.timedelta(days=6)), str(last), target="goals")
    walks = [w, walk.pinned(w, "pinnacle"), walk.Walk(w.start, w.end, target="goals", half_life=90.0)]
    fitted, choice = walk.grid_fits(matches, walks)
    assert choice == [0, 0, 1] and not walks[1].fallback
    alone = walk.weekly_fits(matches, walks[2]).orderBy("as_of").first()
    together = fitted.where("choice = 1").orderBy("as_of").first()
    assert abs(alone["intercept"] - together["intercept"]) < 1e-9 and alone["n_matches"] == together["n_matches"]
    assert walk.grid(matches, None, w, [{}, {"half_life": 90.0}]).where("n > 0").count() == 2


def test_pooled_variances_and_fits(spark, season):
    each = {"a": 0.01, "b": 0.09}
    assert fits.pooled_variances(each, 0.0) == pytest.approx(each)
    assert set(round(v, 9) for v in fits.pooled_variances(each, 1.0).values()) == {0.03} and fits.pooled_variances({}) == {}
    two = pd.concat([season.assign(league=k, weight=1.0, home_team=k + season.home_team, away_team=k + season.away_team) for k in ("X", "Y")])
    rows = spark.createDataFrame(pd.concat([two, two.head(20).assign(league="few")]))
    fitted = {r["league"]: r for r in fits.fit_goals_pooled(rows, share=1.0, target="goals").collect()}
    assert fitted["X"]["ridge_attack"] == pytest.approx(fitted["Y"]["ridge_attack"]) and fitted["few"]["intercept"] is None
    assert fitted["X"]["ridge_attack"] * fitted["X"]["ridge_defence"] == pytest.approx(config.RIDGE["goals"] ** 2)
    assert {r["league"] for r in fits.shrinkage(rows, ["league"], target="goals").collect()} == {"X", "Y"}
    table = fits.referee_table(fits.fit_counts(rows, ["league"], "corners", referees=True), ["league"]).where("league = 'X'").collect()
    assert len(table) == 6 and all(r["multiplier"] == pytest.approx(math.exp(r["effect"])) for r in table) and table == sorted(table, key=lambda r: -r["multiplier"])


def test_injury_effects(spark):
    r, day = np.random.default_rng(4), dt.date(2024, 1, 1)
    out = r.integers(0, 5, (1200, 2))
    lam = 1.5 * np.exp(-0.15 * out[:, 0] + 0.1 * out[:, 1])
    mu = 1.5 * np.exp(-0.15 * out[:, 1] + 0.1 * out[:, 0])
    ms = spark.createDataFrame([(str(k), "E0", day + dt.timedelta(days=k % 400), f"h{k}", f"a{k}") for k in range(1200)], "match_id string, league string, date date, home_team string, away_team string")
    totals = spark.createDataFrame([(str(k), "E0", int(r.poisson(lam[k])), int(r.poisson(mu[k])), 1.5, 1.5) for k in range(1200)], "match_id string, league string, observed_home int, observed_away int, lam double, mu double")
    lists = [(f"{side}{k}", f"p{j}", j < int(out[k, n]), j >= int(out[k, n]), day + dt.timedelta(days=k % 400 + k % 2)) for k in range(1200) for n, side in enumerate("ha") for j in range(int(out[k, n]) + 1)]
    injuries = spark.createDataFrame(lists, "team string, player string, ruled_out boolean, doubtful boolean, fixture_date date")
    got = {x["reading"]: x for x in research.injury_effects(totals, ms, injuries, draws=30).collect()}
    assert set(got) == set(research.INJURY_READINGS)
    for reading in ("all out or doubtful", "newly out or doubtful"):
        assert got[reading]["join_rate"] == 1.0 and abs(got[reading]["own"] + 0.15) < 4 * got[reading]["own_se"] and abs(got[reading]["opp"] - 0.1) < 4 * got[reading]["opp_se"]
    assert got["all out"]["join_rate"] < 1.0  # who has nobody ruled out has no report
    few = research.injury_effects(totals, ms, injuries.where("team like 'h%'"), draws=2)
    assert few.where("join_rate = 0 and own is null").count() == 4
    pooled = {(x["reading"], x["effect"]): x for x in research.pooled_effects(spark.createDataFrame([("r", -0.1, 0.1, 0.1, 0.1), ("r", -0.3, 0.2, -0.2, 0.0), ("r", 0.2, None, 0.3, 0.2)], "reading string, own double, own_se double, opp double, opp_se double")).collect()}
    assert pooled["r", "own"]["estimate"] == pytest.approx((-0.1 / 0.01 - 0.3 / 0.04) / (1 / 0.01 + 1 / 0.04)) and pooled["r", "own"]["agreeing"] == 2 and pooled["r", "opp"]["leagues"] == 2


def test_season_report(spark):
    rows = spark.createDataFrame([(str(k), "E0", dt.date(2019 + k % 4, 9, 1), "1x2", "home", None, 0.5, 0.5, 0.05, 0.01 * (k % 5 - 2), float(k % 2), 0.0, "pinnacle" if k % 4 < 2 else "betfair_exchange") for k in range(400)], "match_id string, league string, date date, market string, selection string, line double, model_conditional double, market_probability double, expected_value double, clv double, win_fraction double, push_fraction double, fair_line_source string")
    rows = rows.withColumn("price_movement", F.lit(None).cast("double"))
    stored = rows.select("match_id", F.lit(2019).alias("season_start_year") + (F.col("match_id").cast("int") % 4))
    got = research.season_report(rows, stored.toDF("match_id", "season_start_year"), 2021)
    assert got["seasons"].count() == 4 and got["eras"].first()["n_before"] == 200
    assert [tuple(r) for r in got["changes"].collect()] == [(2021, "pinnacle", "betfair_exchange")]


def test_exports_come_back_and_stale_fixtures_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    kind = "match_id string, n int"
    store.replace("t", spark.createDataFrame([("a", 1), ("b", 2)], kind))
    export_csv(store.read("t", kind), str(tmp_path / "csv"), ("match_id",))
    import_rows(store, str(tmp_path / "csv"), "t", kind, ("match_id",))
    assert sorted(map(tuple, store.read("t", kind).collect())) == [("a", 1), ("b", 2)]
    fixtures = spark.createDataFrame([(dt.date(2024, 1, 5),)], "fixture_date date")
    require_fresh(fixtures, "2024-01-05")
    for late in (fixtures, fixtures.where("false")):
        with pytest.raises(ValueError):
            require_fresh(late, "2024-01-06")


def test_ledgers_by_day_are_those_of_all_bets(spark):
    r = np.random.default_rng(9)
    rows = [(k % 2 and "A" or "B", dt.date(2024, 1, 1 + k // 40), str(k), "1x2", "home", None, 0.6, float(r.choice([1.5, 2.0, 3.0])), float(r.choice([-1.0, 0.5, 1.0, 0.0]))) for k in range(400)]
    df = spark.createDataFrame(rows, "league string, date date, match_id string, market string, selection string, line double, model_probability double, price_taken double, profit_at_taken double")
    got = {x["match_id"]: x for x in scoring.flat_ledger(df).collect()}
    for league in "AB":
        bank, peak, n = 0.0, -math.inf, 0
        for x in sorted((x for x in rows if x[0] == league), key=lambda x: (x[1], x[2])):
            bank, n = bank + x[8], n + 1
            peak = max(peak, bank)
            y = got[x[2]]
            assert (y["bankroll"], y["turnover"], y["peak"], y["drawdown"]) == pytest.approx((bank, n, peak, bank - peak))
    lost = df.withColumns({"profit_at_taken": F.lit(-1.0), "price_taken": F.lit(1.5)})
    assert {(x["bets"], x["final_bankroll"], x["busted"]) for x in scoring.kelly_ledger(lost.withColumn("model_probability", F.lit(1.0)), fraction=1.0, cap=1.0).collect()} == {(1, 0.0, True)}
    assert scoring.kelly_ledger(df.where("false")).count() == 0 and scoring.flat_ledger(df.where("false")).count() == 0
