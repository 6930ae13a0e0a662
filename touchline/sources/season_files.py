"""Season and fixture files with one wide row a match: canonical matches and long odds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..config import LEAGUES
from ..functions import dates, names

#: Source columns and canonical ones; the second of a pair stands in where the first is absent.
COLUMNS = {
    "date_raw": ("Date",), "kickoff_time": ("Time",), "home_team_raw": ("HomeTeam",), "away_team_raw": ("AwayTeam",), "referee_raw": ("Referee",), "attendance": ("Attendance",),
    "home_goals": ("FTHG", "HG"), "away_goals": ("FTAG", "AG"), "result": ("FTR", "Res"), "home_goals_ht": ("HTHG",), "away_goals_ht": ("HTAG",), "result_ht": ("HTR",),
    "home_shots": ("HS",), "away_shots": ("AS",), "home_sot": ("HST",), "away_sot": ("AST",), "home_corners": ("HC",), "away_corners": ("AC",), "home_fouls": ("HF", "HFKC"), "away_fouls": ("AF", "AFKC"),
    "home_offsides": ("HO",), "away_offsides": ("AO",), "home_woodwork": ("HHW",), "away_woodwork": ("AHW",), "home_yellows": ("HY",), "away_yellows": ("AY",), "home_reds": ("HR",), "away_reds": ("AR",),
}

#: Column prefixes and bookmakers, in order of precedence.
BOOKMAKERS = {
    "BFE": "betfair_exchange", "PS": "pinnacle", "P": "pinnacle", "Max": "market_max", "Avg": "market_avg", "B365": "bet365", "1XB": "1xbet", "BMGM": "betmgm", "BV": "betvictor",
    "WH": "william_hill", "LB": "ladbrokes", "PP": "paddy_power", "CL": "coral", "SKB": "skybet", "BF": "betfair_sportsbook", "BFD": "betfred", "IW": "interwetten", "BW": "bet_and_win",
    "VC": "vc_bet", "SB": "sportingbet", "SJ": "stan_james", "SY": "stanleybet", "SO": "sporting_odds", "BS": "blue_square", "GB": "gamebookers",
}
TOTALS_PREFIXES = ("P", "B365", "Max", "Avg", "GB", "BFE")
HANDICAP_PREFIXES = ("P", "B365", "Max", "Avg", "GB", "LB", "BFE")
OWN_LINES = {"B365": "B365AH", "GB": "GBAH", "LB": "LBAH"}
RETIRED = {"BbMx": "market_max", "BbAv": "market_avg"}


def price_columns() -> list[tuple[str, str, str, str, str, str | float | None, int]]:
    """(book, phase, market, selection, price column, line column or line, sign of the line), in order of precedence."""
    out: list = []
    for prefix, book in BOOKMAKERS.items():
        for phase, mark in (("open", ""), ("close", "C")):
            out += [(book, phase, "1x2", s, f"{prefix}{mark}{c}", None, 1) for s, c in (("home", "H"), ("draw", "D"), ("away", "A"))]
    for prefix, book in RETIRED.items():
        out += [(book, "open", "1x2", s, f"{prefix}{c}", None, 1) for s, c in (("home", "H"), ("draw", "D"), ("away", "A"))]
    for prefix, book in [(p, BOOKMAKERS[p]) for p in TOTALS_PREFIXES] + list(RETIRED.items()):
        for phase, mark in (("open", ""), ("close", "C"))[: 1 if prefix in RETIRED else 2]:
            out += [(book, phase, "total_goals", s, f"{prefix}{mark}{c}2.5", 2.5, 1) for s, c in (("over", ">"), ("under", "<"))]
    for prefix in HANDICAP_PREFIXES:
        lines = [("open", "", x) for x in (OWN_LINES.get(prefix), "AHh", "BbAHh") if x] + [("close", "C", "AHCh")]
        for phase, mark, line in lines:
            out += [(BOOKMAKERS[prefix], phase, "asian_handicap", s, f"{prefix}{mark}AH{c}", line, sign) for s, c, sign in (("home", "H", 1), ("away", "A", -1))]
    for prefix, book in RETIRED.items():
        out += [(book, "open", "asian_handicap", s, f"{prefix}AH{c}", "BbAHh", sign) for s, c, sign in (("home", "H", 1), ("away", "A", -1))]
    return out


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def number(value: Column) -> Column:
    """Text as a double; null where it is none, and for NaN."""
    x = F.trim(value).try_cast("double")
    return F.when(~F.isnan(x), x)


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8, or Latin-1 where the file's bytes aren't UTF-8. One aggregation over its lines."""
    lines = spark.read.format("binaryFile").load(path).select(F.expr("is_valid_utf8(cast(content as string))").alias("ok"))
    return "UTF-8" if lines.agg(F.coalesce(F.min("ok"), F.lit(True))).first()[0] else "ISO-8859-1"


def read_raw(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """One file as strings: nameless columns and blank rows go, rows that don't parse are skipped. A season file has a
    few hundred rows; without an encoding its bytes say which it has."""
    encoding = encoding or encoding_of(spark, path)
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="DROPMALFORMED", encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = [c for c in raw.columns if not c.startswith(("_c", "Unnamed")) and c.strip()]
    out = raw.select([_col(c).alias(c.strip().lstrip("﻿")) for c in named])
    return out.where(F.coalesce(*[_col(c) for c in out.columns]).isNotNull())


def wide_matches(raw: DataFrame, league: str, season: int) -> DataFrame:
    """raw's played rows with the canonical columns beside the source's own, which the odds need."""
    there = set(raw.columns)
    named = {dst: next((c for c in src if c in there), None) for dst, src in COLUMNS.items()}
    text = {dst: names.known(_col(src)) if src else F.lit(None).cast("string") for dst, src in named.items()}
    counts = {c: number(text[c]).try_cast("int") for c in schema.COUNTS}
    name, country, _ = LEAGUES[league]
    rows = raw.select("*", *[(counts.get(dst, value)).alias(f"_{dst}") for dst, value in text.items()])
    date = dates.match_date(F.col("_date_raw"))
    home, away = names.canonical_team(F.col("_home_team_raw")), names.canonical_team(F.col("_away_team_raw"))
    rows = rows.withColumns({"_date": date, "_home_team": home, "_away_team": away})
    rows = rows.where("_date is not null and _home_team is not null and _away_team is not null and _home_goals is not null and _away_goals is not null")
    return rows.withColumns(
        {
            "_match_id": names.match_id(F.lit(league), F.col("_date"), F.col("_home_team"), F.col("_away_team")),
            "_league": F.lit(league), "_league_name": F.lit(name), "_country": F.lit(country), "_season_start_year": F.lit(season),
            "_season": F.lit(f"{season}/{(season + 1) % 100:02d}"), "_referee": names.referee(F.col("_referee_raw")),
        }
    )


def derived(matches: DataFrame) -> DataFrame:
    """What markets are about, null where a part is unknown."""
    c = F.col
    both = lambda name: c(f"home_{name}") + c(f"away_{name}")
    out = matches.withColumns(
        {
            "total_goals": both("goals"), "goal_difference": c("home_goals") - c("away_goals"), "btts": (c("home_goals") > 0) & (c("away_goals") > 0),
            "goals_ht": both("goals_ht"),
            "total_corners": both("corners"), "total_yellows": both("yellows"), "total_reds": both("reds"), "total_shots": both("shots"), "total_sot": both("sot"), "total_fouls": both("fouls"),
        }
    )
    out = out.withColumns({f"over_{k}_5": c("total_goals") > k + 0.5 for k in (1, 2, 3)})
    return out.withColumns({"goals_2h": c("total_goals") - c("goals_ht"), "total_cards": c("total_yellows") + c("total_reds"), "booking_points": c("total_yellows") * 10 + c("total_reds") * 25})


def matches_of(wide: DataFrame) -> DataFrame:
    """The canonical match table of wide_matches()."""
    base = [f.split()[0] for f in schema.MATCHES.split(", ")]
    have = [c for c in base if f"_{c}" in wide.columns]
    out = derived(wide.select([_col(f"_{c}").alias(c) for c in have]))
    return out.select(base)


def odds_long(rows: DataFrame, key: str, key_name: str = "match_id") -> DataFrame:
    """(key_name, bookmaker, phase, market, selection, line, price) of the wide prices of rows.

    A price whose own column or line column is absent isn't emitted; a blank line is null. The line of an away
    handicap is that of the away side. Prices over 1 only; of repeated keys the one whose columns come first.
    One scan: the columns present become an array that is exploded.
    """
    there = set(rows.columns)
    entries = []
    for k, (book, phase, market, selection, price, line, sign) in enumerate(price_columns()):
        if price in there and (not isinstance(line, str) or line in there):
            at = number(_col(line)) * sign + F.lit(0.0) if isinstance(line, str) else F.lit(line).cast("double")
            entries.append(F.struct(F.lit(k).alias("nth"), F.lit(book).alias("bookmaker"), F.lit(phase).alias("phase"), F.lit(market).alias("market"), F.lit(selection).alias("selection"), at.alias("line"), number(_col(price)).alias("price")))
    if not entries:
        return rows.sparkSession.createDataFrame([], f"{key_name} string, {schema.ODDS.split(', ', 1)[1]}")
    long = rows.select(_col(key).alias(key_name), F.inline(F.array(*entries))).where("price > 1")
    first = Window.partitionBy(key_name, "bookmaker", "phase", "market", "selection", "line").orderBy("nth")
    return long.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first", "nth")


def season(spark: SparkSession, path: str, league: str, start_year: int) -> tuple[DataFrame, DataFrame]:
    """(matches, odds) of one season file."""
    wide = wide_matches(read_raw(spark, path), league, start_year)
    return matches_of(wide), odds_long(wide, "_match_id")


def fixtures(raw: DataFrame, leagues: list[str] | None = None) -> DataFrame:
    """Rows of the upcoming-fixtures file with canonical columns beside the source's; Div is required."""
    if "Div" not in raw.columns:
        raise ValueError("a fixtures file needs the column Div")
    there = set(raw.columns)
    text = lambda c: names.known(_col(c)) if c in there else F.lit(None).cast("string")
    rows = raw.withColumns(
        {
            "_league": text("Div"), "_fixture_date": dates.match_date(text("Date")), "_kickoff_time": text("Time"), "_home_team": names.canonical_team(text("HomeTeam")),
            "_away_team": names.canonical_team(text("AwayTeam")), "_referee": names.referee(text("Referee")),
        }
    )
    rows = rows.where("_league is not null and _fixture_date is not null and _home_team is not null and _away_team is not null")
    return rows.where(F.col("_league").isin(leagues)) if leagues else rows
