"""Profiles of teams at a date: metrics with their counts, form, rest and meetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FORM_MATCHES, HEAD_TO_HEAD_MATCHES
from . import teams

#: Metrics, which are means of a column or rates of a flag, and their labels.
MEANS = {
    "goals_for": "Goals scored", "goals_against": "Goals conceded", "total_goals": "Total goals in match", "goals_ht": "Goals, 1st half", "goals_2h": "Goals, 2nd half",
    "corners_for": "Corners won", "corners_against": "Corners conceded", "total_corners": "Total corners in match", "cards_for": "Cards received", "total_cards": "Total cards in match",
    "shots_for": "Shots", "sot_for": "Shots on target", "shots_against": "Shots faced", "fouls_for": "Fouls committed", "points": "Points per game",
}
RATES = {"btts": "Both teams scored", "over_1_5": "Over 1.5 goals", "over_2_5": "Over 2.5 goals", "over_3_5": "Over 3.5 goals", "clean_sheet": "Clean sheet", "failed_to_score": "Failed to score"}
METRICS = MEANS | RATES
SCOPES = ("season", "season_venue", "last6", "last6_venue")


def metrics(rows: DataFrame, keys: list[str], scopes: dict[str, Column] | None = None) -> DataFrame:
    """(keys, scope, metric, value, n): every metric over the known values of each scope's rows, in one pass.

    A metric that no row knows has a null value and n 0.
    """
    scopes = scopes or {"all": F.lit(True)}
    there = [m for m in METRICS if m in rows.columns]
    sums = []
    for scope, within in scopes.items():
        for m in there:
            x = F.when(within, F.col(m).cast("int") if m in RATES else F.col(m)).cast("double")
            sums += [F.avg(x).alias(f"{scope}.{m}.v"), F.count(x).alias(f"{scope}.{m}.n")]
    wide = rows.groupBy(*keys).agg(*sums)
    entries = [F.struct(F.lit(s).alias("scope"), F.lit(m).alias("metric"), F.col(f"`{s}.{m}.v`").alias("value"), F.col(f"`{s}.{m}.n`").alias("n")) for s in scopes for m in there]
    return wide.select(*keys, F.inline(F.array(*entries)))


def scoped(rows: DataFrame, as_of, season: int, is_home: bool) -> DataFrame:
    """(team, scope, metric, value, n) of team rows before as_of for a fixture on one side of the venue."""
    past = teams.before(rows, as_of)
    newest = [F.desc("date"), F.desc("match_id")]
    ranked = past.withColumns(
        {
            "_k": F.row_number().over(Window.partitionBy("team").orderBy(*newest)),
            "_kv": F.row_number().over(Window.partitionBy("team", "is_home").orderBy(*newest)),
        }
    )
    now, venue = F.col("season_start_year") == season, F.col("is_home") == is_home
    scopes = {"season": now, "season_venue": now & venue, "last6": F.col("_k") <= FORM_MATCHES, "last6_venue": venue & (F.col("_kv") <= FORM_MATCHES)}
    return metrics(ranked, ["team"], scopes)


def rolling_form(rows: DataFrame, n: int = FORM_MATCHES) -> DataFrame:
    """rows with the means of goals and points over the n rows of the team before each; its own isn't read."""
    w = Window.partitionBy("team").orderBy("date", "match_id").rowsBetween(-n, -1)
    return rows.withColumns({"form_n": F.count("points").over(w), "form_points": F.avg("points").over(w), "form_goals_for": F.avg("goals_for").over(w), "form_goals_against": F.avg("goals_against").over(w)})


def form_lines(rows: DataFrame, as_of, n: int = FORM_MATCHES) -> DataFrame:
    """(team, form): the newest n matches, newest first, as structs."""
    past = teams.before(rows, as_of)
    newest = past.withColumn("_k", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("date"), F.desc("match_id")))).where(F.col("_k") <= n)
    score = F.coalesce(F.concat_ws("-", *[F.col(c).cast("string") for c in ("goals_for", "goals_against")]), F.lit("-"))
    line = F.struct(F.col("_k").alias("k"), "date", "opponent", F.when(F.col("is_home"), "H").otherwise("A").alias("venue"), F.when(F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull(), score).otherwise("-").alias("score"), "outcome")
    return newest.groupBy("team").agg(F.array_sort(F.collect_list(line)).alias("form"))


def rest(rows: DataFrame, as_of) -> DataFrame:
    """(team, rest_days, matches_last_14_days); a match exactly 14 days ago isn't counted."""
    day = F.lit(as_of).cast("date")
    return teams.before(rows, as_of).groupBy("team").agg(F.datediff(day, F.max("date")).alias("rest_days"), F.count_if(F.col("date") > F.date_sub(day, 14)).alias("matches_last_14_days"))


def meetings(matches: DataFrame, as_of, n: int = HEAD_TO_HEAD_MATCHES) -> DataFrame:
    """(first, second, n, first_wins, draws, second_wins, avg_total_goals, btts_rate) of every pair of clubs,
    over the newest n meetings before as_of. first is the lesser name."""
    past = teams.before(matches, as_of).withColumns({"first": F.least("home_team", "away_team"), "second": F.greatest("home_team", "away_team")})
    k = F.row_number().over(Window.partitionBy("first", "second").orderBy(F.desc("date"), F.desc("match_id")))
    by = F.when(F.col("home_team") == F.col("first"), 1).otherwise(-1) * (F.col("home_goals") - F.col("away_goals"))
    newest = past.withColumns({"_k": k, "_by": by}).where(F.col("_k") <= n)
    return newest.groupBy("first", "second").agg(
        F.count("*").alias("n"), F.count_if(F.col("_by") > 0).alias("first_wins"), F.count_if(F.col("_by") == 0).alias("draws"), F.count_if(F.col("_by") < 0).alias("second_wins"),
        F.avg("total_goals").alias("avg_total_goals"), F.avg(F.col("btts").cast("int").cast("double")).alias("btts_rate"),
    )


def league_table(rows: DataFrame, as_of, season: int) -> DataFrame:
    """(league, team, played, won, drawn, lost, goals_for, goals_against, points) of a season before as_of."""
    past = teams.before(rows, as_of, season=season)
    return past.groupBy("league", "team").agg(
        F.count("*").alias("played"), F.count_if(F.col("outcome") == "W").alias("won"), F.count_if(F.col("outcome") == "D").alias("drawn"), F.count_if(F.col("outcome") == "L").alias("lost"),
        F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"), F.sum("points").alias("points"),
    )


def fixture_profile(matches: DataFrame, home: str, away: str, as_of, league: str, season: int) -> dict[str, DataFrame]:
    """Everything known before as_of of a fixture: each side's scopes, form and rest, the league, the meetings."""
    rows = teams.team_matches(matches.where(F.col("league") == league))
    pick = lambda df, t: df.where(F.col("team") == t)
    out = {}
    for side, team in (("home", home), ("away", away)):
        own = rows.where(F.col("team") == team)
        out |= {f"{side}_scopes": pick(scoped(own, as_of, season, side == "home"), team), f"{side}_form": form_lines(own, as_of), f"{side}_rest": rest(own, as_of)}
    out["league"] = metrics(teams.before(rows, as_of, season=season), ["league"])
    out["meetings"] = meetings(matches.where(F.col("home_team").isin(home, away) & F.col("away_team").isin(home, away)), as_of)
    out["warnings"] = out["home_scopes"].unionByName(out["away_scopes"]).where("metric = 'goals_for' and n < 10").select("team", "scope", "n")
    return out
