"""A match as its two teams see it, and everything read strictly before a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

_SIDED = ("goals", "goals_ht", "shots", "sot", "corners", "fouls", "yellows", "reds")
_SHARED = ("match_id", "league", "season_start_year", "date", "referee", "total_goals", "btts", "over_1_5", "over_2_5", "over_3_5", "goals_ht", "goals_2h", "total_corners", "total_cards", "booking_points")


def team_matches(matches: DataFrame) -> DataFrame:
    """Two rows a match, in one scan. Columns that matches lacks are left out."""
    there = set(matches.columns)

    def seen(us: str, them: str) -> Column:
        parts = [F.col(c).alias(c) for c in _SHARED if c in there]
        parts += [F.lit(us == "home").alias("is_home"), F.col(f"{us}_team").alias("team"), F.col(f"{them}_team").alias("opponent")]
        for c in _SIDED:
            if f"{us}_{c}" in there:
                parts += [F.col(f"{us}_{c}").alias(f"{c}_for"), F.col(f"{them}_{c}").alias(f"{c}_against")]
        return F.struct(*parts)

    both = matches.select(F.inline(F.array(seen("home", "away"), seen("away", "home"))))
    f, a = F.col("goals_for"), F.col("goals_against")
    out = both.withColumns({"outcome": F.when(f > a, "W").when(f < a, "L").when(f == a, "D"), "points": F.when(f > a, 3).when(f < a, 0).when(f == a, 1)})
    cards = {"cards_for": F.col("yellows_for") + F.col("reds_for")} if "yellows_for" in out.columns else {}
    return out.withColumns(cards | {"clean_sheet": a == 0, "failed_to_score": f == 0})


def before(rows: DataFrame, as_of, league=None, season=None, team=None) -> DataFrame:
    """Rows strictly before as_of; None asks for nothing."""
    out = rows.where(F.col("date") < (as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")))
    for name, value in (("league", league), ("season_start_year", season), ("team", team)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def known_teams(matches: DataFrame, league=None, season=None) -> DataFrame:
    rows = before(matches, "9999-12-31", league, season)
    return rows.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct().orderBy("team")


def with_cards(matches: DataFrame) -> DataFrame:
    """matches with home_cards and away_cards, where there are yellow ones: unknown where those are, and red ones that
    are unknown count as none."""
    red = lambda s: F.coalesce(F.col(f"{s}_reds"), F.lit(0)) if f"{s}_reds" in matches.columns else F.lit(0)
    cards = {f"{s}_cards": F.when(F.col(f"{s}_yellows").isNotNull(), F.col(f"{s}_yellows") + red(s)) for s in ("home", "away") if f"{s}_yellows" in matches.columns}
    return matches.withColumns(cards) if cards else matches


def training_rows(matches: DataFrame, as_of, half_life: float, chances: DataFrame | None = None, shares: DataFrame | None = None) -> DataFrame:
    """What a fit reads: matches before as_of with their weight and cards; optional tables that are absent are null
    columns."""
    out = with_cards(before(matches, as_of))
    for table, columns in ((chances, ("home_xg", "away_xg")), (shares, ("missing_home", "missing_away"))):
        if table is not None:
            out = out.drop(*columns).join(table.select("match_id", *columns), "match_id", "left")
        else:
            out = out.withColumns({c: F.lit(None).cast("double") for c in columns if c not in out.columns})
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return out.withColumn("weight", dates.decay(F.col("date"), as_of, half_life))


def half_time(rows: DataFrame) -> DataFrame:
    """The first halves as matches; what is known of the whole match only is unknown of the half."""
    out = rows.where("home_goals_ht is not null and away_goals_ht is not null")
    return out.withColumns({"home_goals": F.col("home_goals_ht"), "away_goals": F.col("away_goals_ht")} | {c: F.lit(None).cast("double") for c in ("home_xg", "away_xg") if c in rows.columns})


def counts(rows: DataFrame) -> DataFrame:
    """(team, matches, effective) of weighted matches."""
    sides = rows.select(F.explode(F.array("home_team", "away_team")).alias("team"), "weight")
    return sides.groupBy("team").agg(F.count("*").alias("matches"), F.sum("weight").alias("effective"))


def latest_league(matches: DataFrame, teams: list[str], as_of) -> DataFrame:
    """(league) that any of the teams played in last; of one day's matches the largest id decides."""
    rows = before(matches, as_of).where(F.col("home_team").isin(teams) | F.col("away_team").isin(teams))
    return rows.agg(F.max_by("league", F.struct("date", "match_id")).alias("league"))
