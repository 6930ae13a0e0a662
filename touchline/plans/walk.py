"""Walk-forward: each week's matches priced by a fit of what was known before its first, then settled."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import dates, pricing, settlement
from ..operators import fair, fits, matrix, scoring, teams
from ..sources.store import landed
from . import predict


@dataclass(frozen=True)
class Walk:
    start: str
    end: str
    step_days: int = 7
    half_life: float = config.HALF_LIFE_DAYS
    target: str | None = None
    ridge: float | str | tuple | None = None
    shares: bool = False
    method: str = "shin"
    preference: tuple[str, ...] = config.FAIR_PREFERENCE
    fallback: bool = True
    calibrate: bool = True
    history_days: int | None = None
    halves: bool = False
    counted: tuple[str, ...] = ()


def pinned(w: Walk, book: str) -> Walk:
    """The walk with fair lines of one book only; where that is silent there is no fair line."""
    return replace(w, preference=(book,), fallback=False)


def bucketed(matches: DataFrame, w: Walk) -> DataFrame:
    """The window's played matches with bucket and as_of, the first date of the bucket's matches in the league."""
    day = F.col("date")
    rows = matches.where((day >= F.lit(w.start).cast("date")) & (day <= F.lit(w.end).cast("date")) & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    rows = rows.withColumn("bucket", F.floor(F.datediff(day, F.lit(w.start).cast("date")) / w.step_days))
    return rows.withColumn("as_of", F.min("date").over(Window.partitionBy("league", "bucket")))


_FACTS = ("home_goals", "away_goals", "home_goals_ht", "away_goals_ht", "home_corners", "away_corners", "home_cards", "away_cards", "total_corners", "total_cards")
#: What only a priced selection has; null in a walk without prices, so that both are scored alike.
_UNPRICED = {"price_taken": "double", "price_close": "double", "market_probability": "double", "fair_line_source": "string", "clv": "double", "price_movement": "double", "book_prices": "map<string,double>"}


def weekly_training(matches: DataFrame, w: Walk) -> DataFrame:
    """The weighted matches that each bucket's fits read, by league and as_of.

    Each match is sent to the buckets that read it, but only the columns that the walk's fits need. All matches
    before a bucket are read, or those of the last history_days.
    """
    buckets = bucketed(matches, w).select("league", "as_of").distinct()
    facts = teams.with_cards(matches) if "cards" in w.counted else matches
    more = ["home_xg", "away_xg", "missing_home", "missing_away"] + (["home_goals_ht", "away_goals_ht"] if w.halves else []) + [f"{s}_{k}" for k in w.counted for s in ("home", "away")] + (["referee"] if "cards" in w.counted else [])
    columns = ["league", "match_id", "date", "home_team", "away_team", "home_goals", "away_goals", *[c for c in more if c in facts.columns]]
    recent = F.lit(True) if w.history_days is None else F.col("date") >= F.date_sub("as_of", w.history_days)
    few = buckets.count() <= 100_000  # leagues by weeks
    history = facts.select(columns).join(F.broadcast(buckets) if few else buckets, "league").where((F.col("date") < F.col("as_of")) & recent)
    return history.withColumn("weight", dates.decay(F.col("date"), F.col("as_of"), w.half_life))


def weekly_models(matches: DataFrame, w: Walk) -> dict[str, DataFrame]:
    """The fits of every bucket: goals, and first halves and counts where the walk asks for them. Each is a row a
    league and bucket, read more than once, so it is written."""
    return {k: landed(fit) for k, fit in _models(matches, w).items()}


def weekly_fits(matches: DataFrame, w: Walk) -> DataFrame:
    """(league, as_of, parameters, status, ratings) of every bucket's goals."""
    return _models(matches, replace(w, halves=False, counted=()))["goals"]


def _models(matches: DataFrame, w: Walk) -> dict[str, DataFrame]:
    """Every bucket's fits. Where they read all that was before, a match is read once and carried on from bucket to
    bucket; of the last history_days each bucket reads its own rows."""
    facts = teams.with_cards(matches) if "cards" in w.counted else matches
    goals = lambda r: fits.goals_row(r, target=w.target, ridge=w.ridge, shares=w.shares)
    models = {"goals": (facts, ("home_goals", "away_goals", "home_xg", "away_xg", *(("missing_home", "missing_away") if w.shares else ())), goals, fits.GOALS_SCHEMA)}
    if w.halves and "home_goals_ht" in facts.columns:
        models["half"] = (teams.half_time(facts), ("home_goals", "away_goals"), lambda r: fits.goals_row(r, target="goals"), fits.GOALS_SCHEMA)
    for kind in w.counted:
        if f"home_{kind}" in facts.columns:
            more = ("referee",) if kind == "cards" else ()
            models[kind] = (facts, (f"home_{kind}", f"away_{kind}", *more), lambda r, kind=kind: fits.counts_row(r, kind), fits.COUNTS_SCHEMA)
    if w.history_days is not None:
        rows, keys = weekly_training(matches, w), ["league", "as_of"]
        fit = {"goals": lambda: fits.fit_goals(rows, keys, target=w.target, ridge=w.ridge, shares=w.shares), "half": lambda: fits.fit_goals(teams.half_time(rows), keys, target="goals")}
        return {k: fit[k]() if k in fit else fits.fit_counts(rows, keys, k) for k in models}
    as_ofs: dict = {}
    for league, day in bucketed(matches, w).select("league", "as_of").distinct().collect():  # leagues by weeks
        if league is not None:
            as_ofs.setdefault(league, []).append(day)
    out = {}
    for name, (rows, wanted, fit, schema) in models.items():
        columns = ["home_team", "away_team", *[c for c in wanted if c in rows.columns]]
        out[name] = fits.fit_running(rows.select("league", "date", *columns), "league", as_ofs, columns, w.half_life, fit, schema)
    return out


def own_markets(rated: DataFrame, columns: list[str], fitted: dict[str, DataFrame]) -> DataFrame:
    """The models' own selections at their own lines of the markets that are checked against results, of fixtures (rated:
    columns, lam, mu, rho). All are worked out in the fixture's row and keep its columns."""
    ok = lambda k: fitted[k].where("intercept is not null")
    by = ["league", "as_of"]
    out = matrix.rated_markets(rated, columns, handicaps=(-0.5, -0.25, 0.0, 0.25, 0.5))
    fixtures = rated.select(*columns)
    if "half" in fitted:
        out = out.unionByName(predict.half_markets(fits.rates(fixtures, ok("half"), by), columns))
    for kind in ("corners", "cards"):
        if kind in fitted:
            out = out.unionByName(predict.count_markets(fits.count_rates(fixtures, ok(kind), by), columns, kind))
    return out.where(F.col("market").isin(*config.CALIBRATED_MARKETS) & (F.col("probability") > 0))


def predictions(matches: DataFrame, odds: DataFrame | None, w: Walk, fitted: DataFrame | dict[str, DataFrame] | None = None, market: str | None = None) -> DataFrame:
    """One row for each selection offered in the window, priced at the offered line, settled and compared with the
    market; and, where calibrate is set, one for each of the models' own selections, without a price.

    fitted is what weekly_fits() or weekly_models() gave, where that is at hand. With a market the rows are those of that
    market, and no other is priced. Matches of buckets without a fit of
    goals are left out; skipped() counts them. Those without a fit of halves or counts lack those markets only. A
    selection whose count isn't known has no row. A fixture's facts travel with its rates, so selections aren't joined
    with their match again.
    """
    fixtures = bucketed(teams.with_cards(matches), w)
    for c in _FACTS:
        if c not in fixtures.columns:
            sides = [c.replace("total", s) for s in ("home", "away")]
            fixtures = fixtures.withColumn(c, F.col(sides[0]) + F.col(sides[1]) if c.startswith("total") else F.lit(None).cast("int"))
    facts = ["match_id", "league", "date", "home_team", "away_team", *_FACTS]
    known = [*facts, "as_of", *[c for c in ("referee", "missing_home", "missing_away") if c in fixtures.columns]]
    fitted = weekly_models(matches, w) if fitted is None else fitted if isinstance(fitted, dict) else {"goals": fitted}
    rated = fits.rates(fixtures.select(known), fitted["goals"].where("intercept is not null"), ["league", "as_of"])
    parts = []
    if odds is not None:
        odds = odds if market is None else odds.where(F.col("market") == market)
        chosen = fair.closing_value(fair.compared(fair.chosen_prices(odds, books=True), fair.fair_probabilities(odds, w.method, w.preference, w.fallback)))
        offered = matrix.price_offered(rated.select(*facts, "lam", "mu", "rho"), chosen, ["match_id"], tuple(facts[1:]))
        parts.append(offered.where("probability > 0").withColumn("priceless", F.lit(False)))
    if w.calibrate:
        parts.append(own_markets(rated, known, fitted).drop(*[c for c in known if c not in facts]).withColumn("priceless", F.lit(True)))
        parts[-1] = parts[-1] if market is None else parts[-1].where(F.col("market") == market)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    for c, kind in _UNPRICED.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    # As a generated column: a later filter by market is then never mixed with the rules' own tests of it.
    outcome = settlement.settle(F.col("market"), F.col("selection"), F.col("line"))
    joined = rows.select("*", F.inline(F.array(F.struct(outcome.alias("o"))))).where("o is not null")
    ev = pricing.expected_value(F.col("probability"), F.col("price_taken"), F.col("push_probability"))
    more = {"model_probability": F.col("probability"), "model_conditional": pricing.conditional(F.col("probability"), F.col("push_probability")), "fair_price": pricing.fair_price(F.col("probability"), F.col("push_probability")), "expected_value": ev, "win_fraction": F.col("o.win"), "push_fraction": F.col("o.push")}
    more |= {"profit_at_taken": settlement.profit(F.col("o"), F.col("price_taken")), "profit_at_close": settlement.profit(F.col("o"), F.col("price_close"))}
    return joined.withColumns(more).drop("o", "probability")


def skipped(matches: DataFrame, w: Walk, fitted: DataFrame) -> DataFrame:
    """(league, as_of, matches, status) of buckets that had no fit."""
    n = bucketed(matches, w).groupBy("league", "as_of").agg(F.count("*").alias("matches"))
    return n.join(fitted.where("intercept is null").select("league", "as_of", "status"), ["league", "as_of"])


def match_totals(matches: DataFrame, w: Walk, fitted: DataFrame) -> DataFrame:
    """(match_id, observed_total, total_pmf, lam, mu) of every match that has a fit, priced by a book or not."""
    rated = fits.rates(bucketed(matches, w), fitted.where("intercept is not null"), ["league", "as_of"])
    pmf = matrix.totals(matrix.cells(rated, ["match_id"]), ["match_id"])
    return rated.select("match_id", "date", (F.col("home_goals") + F.col("away_goals")).alias("observed_total"), "lam", "mu").join(pmf, "match_id")


def summary(rows: DataFrame) -> dict[str, DataFrame]:
    taken = scoring.bets(rows)
    return {"markets": scoring.market_scores(rows), "value": scoring.closing_line_value(taken, ["market"]), "seasons": scoring.seasons(rows), "roi": scoring.bootstrap_roi(taken), "evidence": scoring.evidence(rows)}


#: What a fit of goals depends on; settings that agree in these share their fits.
_FITTED = ("start", "end", "step_days", "half_life", "target", "ridge", "shares", "history_days")


def grid_fits(matches: DataFrame, walks: list[Walk]) -> tuple[DataFrame, list[int]]:
    """(choice, league, as_of, parameters …) of all walks, and the choice of each. The choices are crossed with leagues
    and buckets, so all fits are tasks of one job."""
    of = [tuple(getattr(w, c) for c in _FITTED) for w in walks]
    choices = list(dict.fromkeys(of))
    rows = None
    for k, c in enumerate(choices):
        one = weekly_fits(matches, walks[of.index(c)]).withColumn("choice", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    return landed(rows), [choices.index(c) for c in of]


def grid(matches: DataFrame, odds: DataFrame | None, w: Walk, settings: list[dict], market: str = "1x2") -> DataFrame:
    """(setting, n, model_log_loss, …) of a market for each setting of the walk."""
    walks, out = [Walk(**(asdict(w) | s)) for s in settings], None
    fitted, choice = grid_fits(matches, walks)
    for k, (one, s) in enumerate(zip(walks, settings)):
        rows = predictions(matches, odds, one, fitted.where(F.col("choice") == choice[k]).drop("choice"), market)
        scores = scoring.market_scores(rows.where(F.col("market") == market)).select(F.lit(k).alias("setting"), F.lit(str(sorted(s.items()))).alias("options"), "n", "model_log_loss", "model_brier")
        out = scores if out is None else out.unionByName(scores)
    return out


def paired(first: DataFrame, second: DataFrame, market: str = "1x2") -> DataFrame:
    """(league, n, delta, se, t): the mean difference in log loss of two settings on the same selections."""
    keys = ["league", "match_id", "market", "selection", "line", "priceless"]
    loss = lambda df, name: scoring.judged(df.where(F.col("market") == market)).select(*keys, scoring.log_loss(F.col("model_conditional"), F.col("y")).alias(name))
    a, b = loss(first, "a"), loss(second, "b")
    both = a.join(b.withColumnsRenamed({k: f"_{k}" for k in keys}), [a[k].eqNullSafe(F.col(f"_{k}")) for k in keys])
    d = scoring.clustered(both.select("league", "match_id", (F.col("b") - F.col("a")).alias("d")), ["league"], "d", "match_id")
    return d.select("league", "n", F.col("mean").alias("delta"), "se", F.when(F.col("se") > 0, F.col("mean") / F.col("se")).alias("t"))


def season_of(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """rows with the stored season of their match; by date for all of them if any match isn't stored."""
    found = rows.join(matches.select("match_id", F.col("season_start_year").alias("_stored")), "match_id", "left")
    any_lost = found.agg(F.max(F.col("_stored").isNull().cast("int")).alias("lost")).first()["lost"]
    by_date = dates.season_start(F.col("date"))
    return found.withColumn("season", by_date if any_lost else F.col("_stored")).drop("_stored")


def holdout_best(results: pd.DataFrame) -> dict:
    """The setting of least log loss; of equal ones the first."""
    return results.sort_values(["model_log_loss", "setting"]).iloc[0].to_dict()
