"""Who is missing: shares of a team's recent minutes and chances, and injury reports near a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Matches that say how much a player matters, those that say whether they are missing, and the fewest before.
IMPORTANCE, ABSENCE, LEAST = 10, 1, 6
TEAM_MINUTES = 11 * 90
_SHARES = ("missing_share", "missing_starter_share", "missing_xgchain_share", "n_missing")


def appearances(lineups: DataFrame, fixtures: DataFrame) -> DataFrame:
    """lineups with the date and the team that each player played for."""
    f = fixtures.select("match_id", "date", "home_team", "away_team")
    return lineups.join(f, "match_id").withColumn("team", F.when(F.col("is_home"), F.col("home_team")).otherwise(F.col("away_team"))).drop("home_team", "away_team")


def features(rows: DataFrame, importance: int = IMPORTANCE, absence: int = ABSENCE, least: int = LEAST) -> DataFrame:
    """(match_id, is_home, team, shares, n_missing, n_prior) of each team's match from its matches before it.

    A match is numbered within its team by date and id. Each appearance is sent to the matches whose windows
    it lies in, which are importance + absence at most, and summed there by player: an equi-join on team and
    number whose volume is that many times the line-ups, whatever the length of the history. Windows never
    hold the match itself. With fewer than least matches before, shares are null.
    """
    order = Window.partitionBy("team").orderBy("date", "match_id", "is_home")
    placed = rows.withColumn("at", F.dense_rank().over(order) - 1)  # a team's appearances are few: its matches by some 14
    games = placed.select("team", "match_id", "is_home", "at").distinct()
    spread = placed.select("team", "player_id", "minutes", "xgchain", "started", "at", F.explode(F.sequence(F.lit(1), F.lit(importance + absence))).alias("back"))
    seen = spread.select("team", (F.col("at") + F.col("back")).alias("at"), "player_id", "minutes", F.when(~F.isnan("xgchain"), F.col("xgchain")).alias("xgchain"), "started", (F.col("back") > absence).alias("earlier"))
    one = seen.groupBy("team", "at", "player_id").agg(
        F.sum(F.when(F.col("earlier"), F.col("minutes"))).alias("minutes"), F.sum(F.when(F.col("earlier"), F.coalesce("xgchain", F.lit(0.0)))).alias("chain"),
        F.count_if(F.col("earlier") & F.col("started")).alias("starts"), F.max((~F.col("earlier")).cast("int")).alias("recent"),
    )
    window = F.least(F.greatest(F.col("at") - absence, F.lit(0)), F.lit(importance))
    known = F.col("minutes").isNotNull()
    missing = known & (F.col("recent") == 0)
    per = one.withColumn("w", window).groupBy("team", "at").agg(
        F.first("w").alias("w"), F.sum(F.when(missing, F.col("minutes"))).alias("m"), F.sum(F.when(missing & (F.col("starts") * 2 > F.col("w")), F.col("minutes"))).alias("r"),
        F.sum(F.when(missing, F.col("chain"))).alias("c"), F.sum("chain").alias("chain"), F.count_if(missing).alias("n"),
    )
    out = games.join(per, ["team", "at"], "left")
    enough = (F.col("at") >= least) & (F.col("w") > 0)
    total = F.col("w") * TEAM_MINUTES
    zero = F.lit(0.0)
    return out.select(
        "match_id", "is_home", "team", F.when(enough, F.coalesce(F.col("m"), zero) / total).alias("missing_share"), F.when(enough, F.coalesce(F.col("r"), zero) / total).alias("missing_starter_share"),
        F.when(enough & (F.col("chain") > 0), F.coalesce(F.col("c"), zero) / F.col("chain")).alias("missing_xgchain_share"), F.when(enough, F.col("n").cast("double")).alias("n_missing"), F.col("at").alias("n_prior"),
    )


def by_match(feature_rows: DataFrame) -> DataFrame:
    """One row a match with both sides' features; a match that has one side only is left out."""
    side = lambda c, home: F.max(F.when(F.col("is_home") == F.lit(home), F.col(c))).alias(f"{c}_{'home' if home else 'away'}")
    columns = (*_SHARES, "n_prior")
    out = feature_rows.groupBy("match_id").agg(F.count_distinct("is_home").alias("_sides"), *[side(c, h) for h in (True, False) for c in columns])
    return out.where("_sides = 2").drop("_sides")


def for_unplayed(lineups: DataFrame, fixtures: DataFrame, upcoming: DataFrame, **windows) -> DataFrame:
    """The features of upcoming fixtures (match_id, date, home_team, away_team) that have no line-ups yet: each
    gets a placeholder after its teams' matches."""
    played = appearances(lineups, fixtures).select("team", "date", "match_id", "is_home", "player_id", "minutes", "xgchain", "started")
    mark = lambda home: upcoming.select(F.col("home_team" if home else "away_team").alias("team"), "date", "match_id", F.lit(home).alias("is_home"), F.lit(None).cast("string").alias("player_id"), F.lit(None).cast("int").alias("minutes"), F.lit(None).cast("double").alias("xgchain"), F.lit(False).alias("started"))
    every = played.unionByName(mark(True)).unionByName(mark(False))
    return features(every, **windows).join(upcoming.select("match_id"), "match_id", "left_semi")


def _unavailable(injuries: DataFrame, doubtful: bool) -> DataFrame:
    out = F.coalesce(F.col("ruled_out"), F.lit(False))
    if doubtful:
        out = out | F.coalesce(F.col("doubtful"), F.lit(False))
    return injuries.where(out).where("team is not null and fixture_date is not null")


def out_counts(injuries: DataFrame, doubtful: bool = False) -> DataFrame:
    """(team, fixture_date, out): distinct players that are out."""
    return _unavailable(injuries, doubtful).groupBy("team", "fixture_date").agg(F.count_distinct("player").alias("out"))


def newly_out(injuries: DataFrame, doubtful: bool = False) -> DataFrame:
    """(team, fixture_date, out): those out who weren't at the team's report before."""
    now = _unavailable(injuries, doubtful).where("player is not null").groupBy("team", "fixture_date").agg(F.collect_set("player").alias("players"))
    before = F.coalesce(F.lag("players").over(Window.partitionBy("team").orderBy("fixture_date")), F.array().cast("array<string>"))
    return now.select("team", "fixture_date", F.size(F.array_except("players", before)).alias("out"))


def nearest(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, days: int = 1, left_id: str = "match_id") -> DataFrame:
    """left with the columns of the right row of the same key whose date is nearest within days, null if none
    is; of two as near the earlier. Each right row is put under the days it may serve, so the join is on equal
    keys and days and never compares a team's whole history."""
    offer = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns]).withColumn("_day", F.explode(F.sequence(F.date_sub(f"_{right_date}", days), F.date_add(f"_{right_date}", days))))
    near = F.struct(F.abs(F.datediff(F.col(left_date), F.col(f"_{right_date}"))), F.col(f"_{right_date}"))
    met = left.select(left_id, key, left_date).join(offer, (F.col(key) == F.col(f"_{key}")) & (F.col(left_date) == F.col("_day")))
    rest = [c for c in right.columns if c != key]
    best = met.groupBy(left_id, key).agg(F.min_by(F.struct(*[F.col(f"_{c}").alias(c) for c in rest]), near).alias("_b"))
    return left.join(best, [left_id, key], "left").select(*[left[c] for c in left.columns], *[F.col(f"_b.{c}").alias(c) for c in rest])


def reported(injuries: DataFrame, teams: list[str], day) -> DataFrame:
    """Injuries of the teams for a day, those ruled out first."""
    rows = injuries.where(F.col("team").isin(teams) & (F.col("fixture_date") == F.lit(day).cast("date")))
    return rows.orderBy(F.desc("ruled_out"), F.desc("doubtful"), "team", "player")


def freshness(injuries: DataFrame) -> DataFrame:
    return injuries.groupBy("league").agg(F.max("fetched_at").alias("fetched_at"))
