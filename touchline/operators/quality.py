"""Reports on stored data: coverage, contradictions and margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import REFEREE_MIN_MATCHES

COVERED = ("referee", "home_goals_ht", "home_shots", "home_sot", "home_corners", "home_fouls", "home_yellows", "home_reds", "attendance")


def contents(matches: DataFrame) -> DataFrame:
    return matches.groupBy("league", "season_start_year").agg(F.count("*").alias("matches"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def coverage(matches: DataFrame) -> DataFrame:
    """The percentage of matches that know each column."""
    there = [c for c in COVERED if c in matches.columns]
    return matches.groupBy("league", "season_start_year").agg(F.count("*").alias("matches"), *[F.round(100 * F.count(c) / F.nullif(F.count("*"), F.lit(0)), 1).alias(f"{c}_pct") for c in there])


def odds_coverage(odds: DataFrame, matches: DataFrame) -> DataFrame:
    both = odds.join(matches.select("match_id", "season_start_year"), "match_id")
    return both.groupBy("bookmaker", "phase", "market").agg(F.count_distinct("match_id").alias("matches"), F.min("season_start_year").alias("first_season"), F.max("season_start_year").alias("last_season"))


def integrity(matches: DataFrame, odds: DataFrame, today) -> DataFrame:
    """(check, failures) of eleven contradictions; each table is read once, but for the duplicates and orphans."""
    c = F.col
    wrong = F.when(c("home_goals") > c("away_goals"), "H").when(c("home_goals") < c("away_goals"), "A").otherwise("D")
    stats = [x for x in ("home_shots", "away_shots", "home_corners", "away_corners", "home_yellows", "away_yellows", "home_reds", "away_reds") if x in matches.columns]
    negative = F.lit(False)
    for x in ("home_goals", "away_goals", *stats):
        negative = negative | (c(x) < 0)
    single = {
        "self_play": c("home_team") == c("away_team"), "negative_count": negative, "implausible_goals": (c("home_goals") > 15) | (c("away_goals") > 15),
        "implausible_corners": (c("home_corners") > 30) | (c("away_corners") > 30), "half_over_full": (c("home_goals_ht") > c("home_goals")) | (c("away_goals_ht") > c("away_goals")),
        "result_not_score": c("result") != wrong, "future_match": c("date") > F.lit(today).cast("date"),
    }
    counts = matches.agg(*[F.count_if(x).alias(name) for name, x in single.items()])
    out = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), c(n).alias("failures")) for n in single])))
    more = lambda keys: matches.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("failures"))
    rest = {
        "duplicate_id": more(["match_id"]), "duplicate_fixture": more(["league", "date", "home_team", "away_team"]),
        "price_not_over_one": odds.agg(F.count_if(c("price") <= 1).alias("failures")), "orphan_odds": odds.join(matches, "match_id", "left_anti").agg(F.count("*").alias("failures")),
    }
    for name, df in rest.items():
        out = out.unionByName(df.select(F.lit(name).alias("check"), "failures"))
    return out


def overrounds(odds: DataFrame) -> DataFrame:
    """(match_id, bookmaker, phase, overround) of complete match-result markets."""
    one = odds.where("market = '1x2'").groupBy("match_id", "bookmaker", "phase").agg(F.count("*").alias("legs"), F.sum(1 / F.col("price")).alias("overround"))
    return one.where("legs = 3").drop("legs")


def overround_sample(odds: DataFrame, n: int = 5) -> DataFrame:
    """n markets to look at, the same on every run: the first by a hash of the key."""
    return overrounds(odds).orderBy(F.md5(F.concat_ws("|", F.col("match_id").cast("string"), "bookmaker", "phase"))).limit(n)


def market_margins(odds: DataFrame, least: int = 50) -> DataFrame:
    margins = overrounds(odds).groupBy("bookmaker", "phase").agg(F.count("*").alias("markets"), F.avg("overround").alias("mean_overround"))
    return margins.where(F.col("markets") >= least)


def card_conditions(matches: DataFrame) -> DataFrame:
    """What is known of cards and referees in each league, with the reason where a model of cards lacks it."""
    n = matches.groupBy("league").agg(F.count("*").alias("matches"), F.count("referee").alias("with_referee"), F.count("home_yellows").alias("with_cards"))
    share = lambda c: F.try_divide(F.col(c), F.col("matches"))
    note = F.when(F.col("with_cards") == 0, "no cards recorded").when(share("with_referee") < 0.5, "referees mostly unknown").when(share("with_cards") < 0.9, "cards partly unknown")
    return n.withColumns({"referee_share": share("with_referee"), "card_share": share("with_cards"), "note": note})


def referees(matches: DataFrame, least: int = REFEREE_MIN_MATCHES) -> DataFrame:
    """(match_id, referee_group): the referee's name from least matches on, else one group for all others."""
    enough = matches.where("referee is not null").groupBy("referee").count().where(F.col("count") >= least).select("referee", F.col("referee").alias("known"))
    return matches.select("match_id", "referee").join(F.broadcast(enough), "referee", "left").select("match_id", F.coalesce("known", F.lit("(other)")).alias("referee_group"))  # referees with a dozen matches: hundreds


def chances_check(matches: DataFrame, chances: DataFrame) -> DataFrame:
    both = matches.join(chances, "match_id")
    return both.groupBy("league").agg(F.count("*").alias("matches"), F.avg(F.col("home_goals") + F.col("away_goals")).alias("mean_goals"), F.avg(F.col("home_xg") + F.col("away_xg")).alias("mean_xg"))


def lineup_coverage(matches: DataFrame, lineups: DataFrame) -> DataFrame:
    starters = lineups.groupBy("match_id", "is_home").agg(F.count_if("started").alias("started"))
    return matches.join(starters, "match_id").groupBy("league", "season_start_year").agg(F.count_distinct("match_id").alias("matches"), F.avg("started").alias("mean_started"))


def calendar_summary(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy("source", "league", "season_start_year").agg(F.count("*").alias("fixtures"), F.count_if("played").alias("played"), F.min("kickoff_utc").alias("first_kickoff"), F.max("kickoff_utc").alias("last_kickoff"))


def fingerprint(matches: DataFrame) -> DataFrame:
    """What a kept fit depends on: it is stale once this changes."""
    return matches.groupBy("league").agg(F.count("*").alias("matches"), F.max("date").alias("last_date"))


def run_all(matches: DataFrame, odds: DataFrame, today) -> dict[str, DataFrame]:
    return {"coverage": coverage(matches), "odds_coverage": odds_coverage(odds, matches), "integrity": integrity(matches, odds, today)}
