"""What goes wrong only on long or wide tables, on small ones that have the same shape."""

import datetime as dt
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from touchline.functions import settlement
from test_entry import DATA
from touchline.operators import fits, matrix, scoring
from touchline.plans import queries, research, walk


def test_a_bankroll_past_the_largest_double_is_no_bust(spark):
    """as in SQL, it is not a number once it loses, and not nothing."""
    rows = [("A", dt.date(2024, 1, 1), f"{k:05}", "1x2", "home", None, 0.9, 2.0, 1.0 if k < 1300 else -1.0) for k in range(1301)]
    df = spark.createDataFrame(rows, "league string, date date, match_id string, market string, selection string, line double, model_probability double, price_taken double, profit_at_taken double")
    got = scoring.kelly_ledger(df, fraction=1.0, cap=1.0).first()
    assert got["bets"] == 1301 and math.isnan(got["final_bankroll"]) and math.isnan(got["peak"]) and not got["busted"]
    assert scoring.kelly_ledger(df.where("match_id < '01000'"), fraction=1.0, cap=1.0).first()["final_bankroll"] == pytest.approx(1000 * 1.8**1000, rel=1e-9)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_offered_prices_meet_rates_not_cells(spark):
    """no cell becomes a row and neither side is sent to the driver; by the rules of settlement on every cell."""
    rates = spark.createDataFrame([("a", 1.4, 1.1, -0.05), ("b", 0.6, 2.2, 0.1)], "k string, lam double, mu double, rho double")
    offers = [("1x2", "home", None), ("1x2", "away", None), ("1x2", "nobody", None), ("double_chance", "home_or_draw", None), ("draw_no_bet", "away", None), ("winning_margin", "home_3_plus", None), ("winning_margin", "away_1", None)]
    offers += [("btts", "yes", None), ("btts", "no", None), ("total_goals", "over", 2.5), ("total_goals", "under", 3.0), ("home_goals", "over", 1.0), ("away_goals", "under", 0.5)] + [("asian_handicap", s, x) for s in ("home", "away") for x in (-1.0, -0.75, -0.25, 0.0, 0.25, 0.5)]
    blank = [("total_goals", "over", None), ("total_corners", "over", 9.5), ("1x2_ht", "home", None)]
    offered = spark.createDataFrame([(k, *o) for k in "abc" for o in offers + blank], "k string, market string, selection string, line double")
    df = matrix.price_offered(rates, offered, ["k"])
    assert "Generate" not in plan(df) and "Broadcast" not in plan(df)
    none = {c: F.lit(None).cast("int") for c in ("home_goals_ht", "away_goals_ht", "home_corners", "away_corners", "home_cards", "away_cards", "total_corners", "total_cards")}
    cells = matrix.cells(rates, ["k"]).withColumns({"home_goals": F.col("h"), "away_goals": F.col("a")} | none)
    o = settlement.settle(F.col("market"), F.col("selection"), F.col("line"))
    some = spark.createDataFrame([(k, *x) for k in "ab" for x in offers], offered.schema)
    want = {r[:4]: r[4:] for r in some.join(cells, "k").withColumn("o", o).groupBy("k", "market", "selection", "line").agg(F.sum(F.col("p") * F.col("o.win")), F.sum(F.col("p") * F.col("o.push"))).collect()}
    got = {r[:4]: r[4:] for r in df.collect()}
    assert len(got) == 3 * len(offers + blank) and len(want) == 2 * len(offers)
    for key, value in got.items():
        assert value == (pytest.approx(want[key], abs=1e-12) if key in want else (None, None))


def test_likeliest_scores_are_found_in_the_fixtures_row(spark):
    """nothing is dealt out, so nothing lies on disk; equal scores stay in order."""
    rates = spark.createDataFrame([("a", 1.4, 1.1, -0.05), ("b", 0.6, 2.2, 0.1), ("c", 1.3, 1.3, 0.0)], "k string, lam double, mu double, rho double")
    df = queries.matrix.rated_scores(rates, ["k"], 5)
    assert "Exchange" not in plan(df) and "Generate explode" not in plan(df)
    of = lambda rows: sorted((r["k"], -round(r["probability"], 9), r["selection"]) for r in rows)
    assert of(df.collect()) == of(matrix.correct_scores(matrix.cells(rates, ["k"]), ["k"], 5).collect()) and df.count() == 15
    assert "Exchange" not in plan(queries.QUERIES["correct_scores"](spark, DATA))


def _count_means(spark):
    return spark.createDataFrame([("a", 5.0, 4.0, 8.0, 9.0), ("b", 2.5, 6.5, 20.0, 3.0)], "k string, home_mean double, away_mean double, dispersion double, total_dispersion double")


def _same(got, want):
    got, want = ({r[:4]: r[4:] for r in x.collect()} for x in (got, want))
    assert set(got) == set(want)
    for key, value in want.items():
        assert got[key] == (value if value[0] is None else pytest.approx(value, abs=1e-12))


def test_count_markets_are_worked_out_in_the_fixtures_row(spark):
    """no pair of counts becomes a row; by the distributions as columns."""
    means, k = _count_means(spark), ["k"]
    df = matrix.rated_counts(means, k, "corners", (9.5, 10.0), (4.5,), (-1.5, -0.25, 0.0))
    assert "Exchange" not in plan(df) and "Exchange" not in plan(queries.QUERIES["count_handicaps"](spark, DATA))
    pmf = lambda mean, spread, name: matrix.count_pmf(mean, F.col(spread)).alias(name)
    rows = means.select("k", pmf(F.col("home_mean"), "dispersion", "home"), pmf(F.col("away_mean"), "dispersion", "away"), pmf(F.col("home_mean") + F.col("away_mean"), "total_dispersion", "both"))
    want = matrix.count_over_under(rows, k, "both", "total_corners", (9.5, 10.0))
    for side in ("home", "away"):
        want = want.unionByName(matrix.count_over_under(rows, k, side, f"{side}_total_corners", (4.5,)))
    _same(df, want.unionByName(matrix.count_handicaps(rows, k, "home", "away", "corner_handicap", (-1.5, -0.25, 0.0))))


def test_offered_counts_meet_means_not_distributions(spark):
    """what travels to an offered selection is four numbers; by the distributions as columns."""
    means, k = _count_means(spark), ["k"]
    bets = [(m, s, x) for m in ("total_corners", "home_total_corners", "away_total_corners") for s in ("over", "under", "none") for x in (4.0, 9.5)] + [("corner_handicap", s, x) for s in ("home", "away") for x in (-1.25, 0.0, 0.5)]
    bets += [("total_goals", "over", 2.5), ("total_corners", "over", None), ("card_handicap", "home", 0.5)]
    offered = spark.createDataFrame([(x, *b) for x in "abc" for b in bets], "k string, market string, selection string, line double")
    df = matrix.price_rated_counts(means, offered, k, "corners")
    assert "transform(" not in plan(df) and "Broadcast" not in plan(df)
    assert "aggregate(" not in plan(queries.QUERIES["counts_offered"](spark, DATA))
    pmf = lambda mean, spread, name: matrix.count_pmf(mean, F.col(spread)).alias(name)
    rows = means.select("k", pmf(F.col("home_mean"), "dispersion", "home"), pmf(F.col("away_mean"), "dispersion", "away"), pmf(F.col("home_mean") + F.col("away_mean"), "total_dispersion", "both"))
    _same(df, matrix.price_counts(rows, offered, k, "corners"))


def test_effects_are_fitted_on_kinds_of_matches(spark, monkeypatch):
    """alike matches reach a fit as one row with their number, and give what they give one by one."""
    rows = [(str(k), "E", k % 3, k % 2, 1.5, 1.2, k % 4, k % 5) for k in range(600)]
    totals = spark.createDataFrame(rows, "match_id string, league string, observed_home int, observed_away int, lam double, mu double, vh int, va int")
    seen = {}

    def study(kinds, keys, draws=200, seed=0):
        seen.update(rows=kinds.count(), n=kinds.agg(F.sum("n")).first()[0])
        return real(kinds, keys, draws, seed)

    real = research.kinds_poisson
    monkeypatch.setattr(research, "kinds_poisson", study)
    got = research.offset_poisson(research.sides(totals.drop("vh", "va"), totals.select("match_id", "vh", "va"), "vh", "va"), ["league"], draws=50).first()
    assert seen == {"rows": 60, "n": 600} and got["n"] == 600
    g = np.array(rows, dtype=object)
    y, off, own, opp = (np.r_[g[:, a], g[:, b]].astype(float) for a, b in ((2, 3), (4, 5), (6, 7), (7, 6)))
    left = y - np.exp(np.log(off) + got["alpha"] + got["own"] * own + got["opp"] * opp)
    assert abs(left.sum()) < 1e-3 and abs((left * own).sum()) < 1e-3 and abs((left * opp).sum()) < 1e-3 and got["own_se"] > 0


def test_running_fits_are_those_of_all_matches_before(spark, monkeypatch):
    """F3, F5, F8: a match goes to one date, alike ones as one row, and each fit is that of all rows before its date."""
    monkeypatch.setattr(fits, "BLOCK", 2)
    r, day = np.random.default_rng(5), dt.date(2024, 1, 1)
    rows = [("E", str(k), day + dt.timedelta(days=k // 8), f"t{k % 5}", f"t{(k + 1 + k // 5 % 4) % 5}", int(r.poisson(1.4)), int(r.poisson(1.1))) for k in range(640)]
    ms = spark.createDataFrame(rows, "league string, match_id string, date date, home_team string, away_team string, home_goals int, away_goals int")
    w = walk.Walk("2024-01-01", "2024-12-31", step_days=20, half_life=60.0, target="goals")
    got = {x["as_of"]: x for x in walk.weekly_fits(ms, w).collect()}
    want = {x["as_of"]: x for x in fits.fit_goals(walk.weekly_training(ms, w), ["league", "as_of"], target="goals").collect()}
    assert set(got) == set(want) and len(got) == 3
    for d, x in want.items():
        y = got[d]
        assert (y["n_matches"], y["status"]) == (x["n_matches"], x["status"]) and y["effective_n"] == pytest.approx(x["effective_n"])
        assert (y["intercept"], y["home_advantage"], y["rho"]) == pytest.approx((x["intercept"], x["home_advantage"], x["rho"]), abs=1e-5)
    assert "_since" in plan(walk.weekly_fits(ms, w))
