"""JSON feeds: played and unplayed matches, rosters, calendars and injuries. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LEAGUES
from ..functions import dates, names

SEASON = (
    "dates array<struct<id:string,isResult:boolean,datetime:string,h:struct<title:string>,a:struct<title:string>,goals:struct<h:string,a:string>,xG:struct<h:string,a:string>>>, "
    "teams map<string,struct<id:string,title:string,history:array<struct<h_a:string,date:string,xG:string,npxG:string,xGA:string,npxGA:string,deep:string,scored:string>>>>"
)
_PLAYER = "struct<player_id:string,player:string,position:string,time:string,yellow_card:string,red_card:string,xG:string,xA:string,xGChain:string>"
ROSTER = f"rosters struct<h:map<string,{_PLAYER}>,a:map<string,{_PLAYER}>>"
OPEN_CALENDAR = "name string, matches array<struct<round:string,date:string,time:string,team1:string,team2:string,score:string>>"
KEYED_CALENDAR = "matches array<struct<id:string,utcDate:string,matchday:string,homeTeam:struct<name:string>,awayTeam:struct<name:string>,score:struct<fullTime:struct<home:int,away:int>>>>"
INJURIES = (
    "errors string, results int, paging struct<current:int,total:int>, response array<struct<player:struct<id:string,name:string,type:string,reason:string>,"
    "team:struct<id:string,name:string>,fixture:struct<id:string,date:string,timezone:string>,league:struct<id:string,season:int,name:string>>>"
)


class Refused(ValueError):
    """A payload or a name that must not be taken in part."""


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files, one document each."""
    return spark.read.json(path, schema=schema, multiLine=True)


def _number(value: Column, kind: str = "double") -> Column:
    x = value.try_cast("double")
    return F.when(~F.isnan(x), x).try_cast(kind)


def _instant(text: Column) -> Column:
    """A UTC instant from text with or without seconds, T or zone."""
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(Z|\+00:?00)$", "")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")))


def _dates(payload: DataFrame, league: str, season: int) -> DataFrame:
    d = payload.select(F.explode("dates").alias("d"))
    played = F.coalesce(F.col("d.isResult"), F.lit(False))
    when = lambda x: F.when(played, x)  # noqa: E731  an unplayed match has no goals and no chances, not none of them
    return d.select(
        F.col("d.id").alias("feed_id"), F.lit(league).alias("league"), F.lit(season).alias("season_start_year"), _instant(F.col("d.datetime")).alias("kickoff_utc"),
        names.canonical_team(F.col("d.h.title")).alias("home_team"), names.canonical_team(F.col("d.a.title")).alias("away_team"), played.alias("played"),
        when(_number(F.col("d.goals.h"), "int")).alias("home_goals"), when(_number(F.col("d.goals.a"), "int")).alias("away_goals"),
        when(_number(F.col("d.xG.h"))).alias("home_xg"), when(_number(F.col("d.xG.a"))).alias("away_xg"),
    )


def played_matches(payload: DataFrame, league: str, season: int) -> DataFrame:
    return _dates(payload, league, season).where("played").drop("played")


def season_calendar(payload: DataFrame, league: str, season: int) -> DataFrame:
    """Played and unplayed matches."""
    return _dates(payload, league, season)


def calendar_of(payloads: dict[str, DataFrame], season: int) -> DataFrame:
    """All leagues' calendars; a league without matches is refused, not left out."""
    parts = {league: season_calendar(p, league, season) for league, p in payloads.items()}
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    have = {r[0] for r in out.select("league").distinct().collect()}
    if missing := sorted(set(parts) - have):
        raise Refused(f"no matches for {', '.join(missing)}")
    return out


def team_history(payload: DataFrame, league: str, season: int) -> DataFrame:
    """One row for each team and match with chances without penalties."""
    t = payload.select(F.explode(F.map_values("teams")).alias("t")).select(F.col("t.title").alias("title"), F.explode("t.history").alias("g"))
    cols = {"xg": "xG", "npxg": "npxG", "xga": "xGA", "npxga": "npxGA"}
    return t.select(
        F.lit(league).alias("league"), F.lit(season).alias("season_start_year"), names.canonical_team(F.col("title")).alias("team"), (F.col("g.h_a") == "h").alias("is_home"),
        F.to_date(_instant(F.col("g.date"))).alias("date"), *[_number(F.col(f"g.{src}")).alias(dst) for dst, src in cols.items()],
        _number(F.col("g.deep"), "int").alias("deep"), _number(F.col("g.scored"), "int").alias("scored"),
    )


def _unescaped(text: Column) -> Column:
    """Text without the entities that names have."""
    for entity, char in (("&#039;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def roster(payload: DataFrame, match_id: Column) -> DataFrame:
    """One row for each appearance; a player starts who isn't listed as a substitute."""
    sides = payload.select(match_id.alias("match_id"), F.explode(F.map_from_arrays(F.array(F.lit(True), F.lit(False)), F.array("rosters.h", "rosters.a"))).alias("is_home", "side"))
    p = sides.select("match_id", "is_home", F.explode(F.map_values("side")).alias("p"))
    return p.select(
        "match_id", "is_home", F.col("p.player_id").alias("player_id"), _unescaped(F.col("p.player")).alias("player"), F.col("p.position").alias("position"), _number(F.col("p.time"), "int").alias("minutes"),
        F.coalesce(F.col("p.position") != "Sub", F.lit(False)).alias("started"), _number(F.col("p.xG")).alias("xg"), _number(F.col("p.xA")).alias("xa"), _number(F.col("p.xGChain")).alias("xgchain"),
    )


def _resolved(rows: DataFrame, teams: DataFrame, extra: dict[str, str] | None) -> DataFrame:
    """rows (home_raw, away_raw) with home_team and away_team; null where a name stands for no team."""
    both = rows.select(F.explode(F.array("home_raw", "away_raw")).alias("name"))
    found = names.resolved(both, teams, extra)
    out = rows
    for side in ("home", "away"):
        out = out.join(F.broadcast(found.select(F.col("name").alias(f"{side}_raw"), F.col("team").alias(f"{side}_team"))), f"{side}_raw", "left")  # club names: hundreds
    return out


def require_resolved(rows: DataFrame) -> DataFrame:
    """rows, or Refused naming every club that wasn't recognised."""
    lost = rows.select(F.explode(F.array(F.when(F.col("home_team").isNull(), F.col("home_raw")), F.when(F.col("away_team").isNull(), F.col("away_raw")))).alias("n")).where("n is not null").distinct()
    if missing := sorted(r[0] for r in lost.collect()):
        raise Refused(f"unknown clubs: {', '.join(missing)}")
    return rows.drop("home_raw", "away_raw")


def _calendar(rows: DataFrame, source: str, league: str, season: int) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), F.lit(league).alias("league"), F.lit(season).alias("season_start_year"), "kickoff_utc", "round", "home_raw", "away_raw", (F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()).alias("played"), "home_goals", "away_goals")


def open_calendar(payload: DataFrame, league: str, season: int, teams: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """The open calendar: a score is null, {ft, ht} or [home, away]; times are local to the league."""
    m = payload.select(F.explode("matches").alias("m")).select("m.*").withColumn("v", F.try_parse_json("score"))
    goal = lambda k: F.coalesce(F.try_variant_get("v", f"$.ft[{k}]", "int"), F.try_variant_get("v", f"$[{k}]", "int"))
    rows = m.select(
        dates.kickoff(F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))), F.col("time"), LEAGUES[league][2]).alias("kickoff_utc"), F.col("round"),
        F.col("team1").alias("home_raw"), F.col("team2").alias("away_raw"), goal(0).alias("home_goals"), goal(1).alias("away_goals"),
    )
    return require_resolved(_resolved(_calendar(rows, "open", league, season), teams, extra))


def keyed_calendar(payload: DataFrame, league: str, season: int, teams: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    m = payload.select(F.explode("matches").alias("m"))
    rows = m.select(
        _instant(F.col("m.utcDate")).alias("kickoff_utc"), F.col("m.matchday").alias("round"), F.col("m.homeTeam.name").alias("home_raw"), F.col("m.awayTeam.name").alias("away_raw"),
        F.col("m.score.fullTime.home").alias("home_goals"), F.col("m.score.fullTime.away").alias("away_goals"),
    )
    return require_resolved(_resolved(_calendar(rows, "keyed", league, season), teams, extra))


def chances_calendar(payload: DataFrame, league: str, season: int, teams: DataFrame) -> DataFrame:
    d = season_calendar(payload, league, season)
    rows = d.select("kickoff_utc", F.lit(None).cast("string").alias("round"), F.col("home_team").alias("home_raw"), F.col("away_team").alias("away_raw"), "home_goals", "away_goals")
    return require_resolved(_resolved(_calendar(rows, "chances", league, season), teams, None))


CALENDARS = {"open": open_calendar, "keyed": keyed_calendar, "chances": chances_calendar}


def resolve_source(name: str, has_token: bool) -> str:
    """auto is the keyed source where there is a token, else the open one."""
    chosen = ("keyed" if has_token else "open") if name == "auto" else name
    if chosen not in CALENDARS:
        raise Refused(f"no calendar source {name}")
    return chosen


def injuries(payload: DataFrame, league: str, season: int, teams: DataFrame, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, unmatched) of one whole, unpaged payload; paged and erroneous ones are refused."""
    head = payload.select("errors", F.col("paging.total").alias("pages")).first()
    if head is None or (head["pages"] or 1) > 1 or (head["errors"] or "[]") not in ("[]", "{}"):
        raise Refused("the injury payload is empty, paged or reports errors")
    r = payload.select(F.explode("response").alias("r")).select("r.*")
    status = F.lower(F.col("player.type"))
    rows = r.select(
        F.lit(league).alias("league"), F.lit(season).alias("season_start_year"), F.col("team.name").alias("name"), F.col("player.id").alias("player_id"), F.col("player.name").alias("player"),
        F.col("player.type").alias("status"), F.col("player.reason").alias("reason"), F.coalesce(status == "missing fixture", F.lit(False)).alias("ruled_out"),
        F.coalesce(status == "questionable", F.lit(False)).alias("doubtful"), F.to_date(_instant(F.substring("fixture.date", 1, 10))).alias("fixture_date"), fetched_at.alias("fetched_at"),
    )
    found = rows.join(F.broadcast(names.resolved(rows.select("name"), teams)), "name", "left")
    kept = found.where("team is not null")
    best = kept.groupBy("team", "player", "fixture_date").agg(F.max_by(F.struct(*[c for c in kept.columns if c not in ("team", "player", "fixture_date", "name")]), F.struct(F.col("ruled_out").cast("int"), F.col("doubtful").cast("int"), F.coalesce("reason", F.lit("")))).alias("b"))
    return best.select("team", "player", "fixture_date", "b.*"), found.where("team is null").groupBy("name").count()


def attach_chances(matches: DataFrame, chances: DataFrame, least: float = 0.8) -> DataFrame:
    """(match_id, feed_id, home_xg, away_xg) of matches found in the chances feed; a score that differs
    is dropped. Refused where fewer than the least share of matches is found."""
    keys = ["league", "season_start_year", "home_team", "away_team"]
    feed = chances.select(*keys, "feed_id", "home_xg", "away_xg", F.col("home_goals").alias("hg"), F.col("away_goals").alias("ag"))
    both = matches.select(*keys, "match_id", "home_goals", "away_goals").join(feed, keys, "left")
    rate = both.agg(F.avg(F.col("feed_id").isNotNull().cast("double"))).first()[0]
    if rate is not None and rate < least:
        raise Refused(f"only {rate:.0%} of matches were found")
    agreed = both.where("hg = home_goals and ag = away_goals")
    one = agreed.groupBy("match_id").agg(F.min_by(F.struct("feed_id", "home_xg", "away_xg"), "feed_id").alias("x"))
    return one.select("match_id", "x.*")
