"""Jobs: files to tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import quality, scoring
from ..sources import season_files
from ..sources.store import Store
from . import walk


def database(spark: SparkSession, store: Store, files: list[tuple[str, int, str]], today) -> tuple[dict, list[str]]:
    """Load season files (league, start year, path); reports and the files that couldn't be read, which are
    skipped and named."""
    failed, all_matches, all_odds = [], None, None
    for league, year, path in files:
        try:
            m, o = season_files.season(spark, path, league, year)
        except Exception as e:  # a file's own fault; the others are loaded
            failed.append(f"{path}: {type(e).__name__}")
            continue
        all_matches = m if all_matches is None else all_matches.unionByName(m)
        all_odds = o if all_odds is None else all_odds.unionByName(o)
    if all_matches is not None:
        store.upsert("matches", all_matches, schema.MATCHES, ("match_id",))
        store.upsert("odds", all_odds, schema.ODDS, ("match_id",))
        n = all_matches.groupBy("league", "season_start_year").agg(F.count("*").alias("matches"))
        store.append("ingest_log", n.withColumns({"odds": F.lit(None).cast("bigint"), "loaded_at": F.current_timestamp()}), schema.INGEST_LOG)
    return quality.run_all(store.read("matches", schema.MATCHES), store.read("odds", schema.ODDS), today), failed


def evidence(store: Store, w: walk.Walk) -> None:
    """Score every market of the window and keep what is known of it."""
    matches, odds = store.read("matches", schema.MATCHES), store.read("odds", schema.ODDS)
    rows = scoring.evidence(walk.predictions(matches, odds, w)).withColumn("computed_at", F.current_timestamp())
    store.scoped_replace("market_evidence", rows, schema.EVIDENCE, ("league",))


def lineups(store: Store, lineup_rows, shares) -> None:
    """Line-ups and shares are replaced whole."""
    store.replace("match_lineups", lineup_rows)
    store.replace("match_availability", shares)


def calendar(store: Store, rows) -> None:
    store.scoped_replace("calendar", rows, schema.CALENDAR, ("source", "league", "season_start_year"))


def injuries(store: Store, rows) -> None:
    store.scoped_replace("injuries", rows, schema.INJURIES, ("league", "season_start_year"))


def fixtures(store: Store, rows) -> None:
    store.scoped_replace("fixtures", rows, schema.FIXTURES, ("league", "season_start_year"))
