"""Fixtures priced before they are played."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import pricing
from ..operators import fits, matrix, teams
from ..sources.store import landed

_PERIODS = {"_ht": "first half"}
_COUNTED = ("goals", "corners", "cards")


def _wording(market: str) -> str:
    """A market's title from its code: what is counted, of whom, over which part of the match."""
    part = next((words for end, words in _PERIODS.items() if market.endswith(end)), "full time")
    code = market.removesuffix("_ht")
    counted = next((c for c in _COUNTED if code.endswith(c)), None)
    if code == "1x2":
        what = "Winner"
    elif code == "btts":
        what = "Both sides score"
    elif counted and code.startswith(("home", "away")):
        what = f"{counted.capitalize()} for {{{code[:4]}}}"
    elif counted:
        what = f"{counted.capitalize()} in all"
    elif code.endswith("handicap"):
        what = f"Handicap, {'goals' if code.startswith('asian') else code.split('_')[0] + 's'}"
    else:
        what = code.replace("_", " ").capitalize()
    return f"{what} ({part})"


#: Titles of markets; {home} and {away} stand for the clubs.
TITLES = {market: _wording(market) for market in (*config.CALIBRATED_MARKETS, "correct_score")}


def title(market: Column, home: Column, away: Column) -> Column:
    """A market's title with the clubs' names; the code in words where there is none."""
    pairs = [F.lit(x) for kv in TITLES.items() for x in kv]
    plain = F.coalesce(F.create_map(*pairs)[market], F.initcap(F.replace(market, F.lit("_"), F.lit(" "))))
    return F.replace(F.replace(plain, F.lit("{home}"), home), F.lit("{away}"), away)


def label(market: Column, selection: Column, line: Column) -> Column:
    """The selection and its line, with a sign for handicaps."""
    number = F.regexp_replace(F.format_string("%.2f", F.abs(line)), r"\.?0+$", "")
    sign = F.when(line < 0, "-").when(market.endswith("handicap"), "+").otherwise("")
    return F.when(line.isNull(), selection).otherwise(F.concat(selection, F.lit(" "), sign, number))


def stat(value: Column, n: Column, percent: bool = False) -> Column:
    """A number for reading; a dash where nothing is known."""
    return F.when(value.isNull() | (n == 0), "-").otherwise(F.format_string("%.0f%%", value * 100) if percent else F.format_string("%.2f", value))


def models(matches: DataFrame, as_of, half_life: float = config.HALF_LIFE_DAYS, **options) -> dict[str, DataFrame]:
    """One fit a league of goals, first-half goals, corners and cards, from what was known before as_of."""
    rows = teams.training_rows(matches, as_of, half_life)
    out = {"goals": fits.fit_goals(rows, ["league"], **options)}
    if "home_goals_ht" in rows.columns:
        out["half"] = fits.fit_goals(teams.half_time(rows), ["league"], target="goals")
    for kind in ("corners", "cards"):
        if f"home_{kind}" in rows.columns:
            out[kind] = fits.fit_counts(rows, ["league"], kind)
    return {k: landed(fit) for k, fit in out.items()}  # a row a league; each is read more than once


def half_markets(rates: DataFrame, columns: list[str]) -> DataFrame:
    """The markets of the first half, from the rates of its own fit."""
    half = matrix.rated_markets(rates, columns, goal_lines=(0.5, 1.5, 2.5), team_lines=(), only=("1x2", "total_goals"))
    return half.withColumn("market", F.concat("market", F.lit("_ht")))


def count_markets(means: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """All markets of corners or cards, from the rows of fits.count_rates."""
    lines = config.CORNER_LINES if kind == "corners" else config.CARD_LINES
    side_lines = tuple(sorted({int(x / 2) + 0.5 for x in lines}))
    return matrix.rated_counts(means, columns, kind, lines, side_lines, (-1.5, -0.5, 0.5, 1.5))


def priced(fixtures: DataFrame, fitted: dict[str, DataFrame], key: str = "fixture_id") -> DataFrame:
    """(key, market, selection, line, probability, push_probability, fair_price) of every market of the fixtures
    (key, league, home_team, away_team): goals from one matrix, halves from theirs, counts from their own fits."""
    ok = lambda k: fitted[k].where("intercept is not null")
    rated = fits.rates(fixtures, ok("goals"), ["league"])
    out = matrix.all_goal_markets(matrix.cells(rated, [key]), [key], handicaps=(-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0))
    if "half" in fitted:
        out = out.unionByName(half_markets(fits.rates(fixtures, ok("half"), ["league"]), [key]))
    for kind in ("corners", "cards"):
        if kind in fitted:
            out = out.unionByName(count_markets(fits.count_rates(fixtures, ok(kind), ["league"]), [key], kind))
    return out.withColumn("fair_price", pricing.fair_price(F.col("probability"), F.col("push_probability")))


def day(fixtures: DataFrame, fitted: DataFrame, key: str = "fixture_id") -> DataFrame:
    """fixtures with the likeliest result, its probability, expected goals and whether both clubs are known."""
    rated = fits.rates(fixtures, fitted.where("intercept is not null"), ["league"])
    picks = matrix.day_picks(matrix.goal_markets(matrix.cells(rated, [key]), [key]), [key])
    return rated.join(picks, key).select(*fixtures.columns, "pick", "confidence", F.col("lam").alias("expected_home"), F.col("mu").alias("expected_away"), "known")


def on_day(fixtures: DataFrame, date, zone: str = "UTC") -> DataFrame:
    """Fixtures whose kick-off falls on a date in a zone."""
    return fixtures.where(F.to_date(F.from_utc_timestamp("kickoff_utc", zone)) == F.lit(date).cast("date")).orderBy("kickoff_utc", "league", "home_team")


def nearest_day(fixtures: DataFrame, date, zone: str = "UTC") -> DataFrame:
    """The date with fixtures nearest to a date; of two as near the later."""
    days = fixtures.select(F.to_date(F.from_utc_timestamp("kickoff_utc", zone)).alias("day")).distinct()
    return days.orderBy(F.abs(F.datediff("day", F.lit(date).cast("date"))), F.desc("day")).limit(1)
