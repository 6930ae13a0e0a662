"""The append-only archive of pre-match prices: snapshots, merging, reconciling with played matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RECONCILE_DAYS
from ..functions import dates, names
from ..sources import season_files

#: Part of every stored snapshot: a change in what is read isn't a change of prices.
PARSER_VERSION = 1
IDENTITY = ("league", "fixture_date", "kickoff_time", "home_team", "away_team", "referee")


def fixture_key(league: Column, date: Column, home: Column, away: Column) -> Column:
    return F.concat_ws("_", league, F.coalesce(F.date_format(date, "yyyyMMdd"), F.lit("unknown")), names.slug(home), names.slug(away))


def content_hash(odds: Column) -> Column:
    """A digest of the identity in the row and of its odds, an array of structs, each price at three decimals."""
    who = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in sorted(IDENTITY)]
    three = lambda x: F.format_string("%.3f", x)
    lines = F.transform(odds, lambda o: F.concat_ws("|", o["bookmaker"], o["phase"], o["market"], o["selection"], F.coalesce(F.when(o["line"].isNotNull(), three(o["line"])), F.lit("")), three(o["price"])))
    return F.substring(F.sha2(F.array_join(F.concat(F.array(*who), F.array_sort(lines)), "\n"), 256), 1, 32)


def snapshot(raw: DataFrame, pulled_at: Column, leagues: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshots, odds) of an upcoming-fixtures file: a row for each fixture, of repeated ones the first hash."""
    rows = season_files.fixtures(raw, leagues)
    base = rows.select("*", F.concat_ws("|", *[F.coalesce(F.col(f"_{c}").cast("string"), F.lit("")) for c in IDENTITY]).alias("_row"))
    one = base.withColumn("_raw", F.sha2(F.to_json(F.struct(*rows.columns)), 256)).dropDuplicates(["_raw"])
    long = season_files.odds_long(one, "_raw", "_raw")
    grouped = long.groupBy("_raw").agg(F.collect_list(F.struct("bookmaker", "phase", "market", "selection", "line", "price")).alias("odds"))
    head = one.select("_row", "_raw", *[F.col(f"_{c}").alias(c) for c in IDENTITY]).join(grouped, "_raw", "left")
    nothing = F.array().cast("array<struct<bookmaker:string,phase:string,market:string,selection:string,line:double,price:double>>")
    head = head.withColumn("odds", F.coalesce("odds", nothing)).withColumn("content_hash", content_hash(F.col("odds")))
    head = head.withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy("content_hash"))).where("_nth = 1")
    w = dates.collection_window(F.col("fixture_date"))
    snaps = head.select(
        "content_hash", fixture_key(F.col("league"), F.col("fixture_date"), F.col("home_team"), F.col("away_team")).alias("fixture_key"), "league", "fixture_date", "kickoff_time", "home_team", "away_team", "referee",
        w["window"].alias("collection_window"), w["collected_at"].alias("nominal_collected_at"), pulled_at.alias("first_pulled_at_utc"), pulled_at.alias("last_pulled_at_utc"),
        F.lit(None).cast("string").alias("match_id"), F.lit(PARSER_VERSION).alias("parser_version"),
    )
    return snaps, head.select("content_hash", F.inline("odds"))


def merged(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored and incoming snapshots with one row a hash: the stored one, or the earliest, with the first and
    the last sighting. No price is ever changed or removed."""
    columns = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.select(columns).withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in ("content_hash", "first_pulled_at_utc", "last_pulled_at_utc")]
    kept = F.min_by(F.struct(*rest), F.struct("_new", "first_pulled_at_utc"))
    out = both.groupBy("content_hash").agg(kept.alias("k"), F.min("first_pulled_at_utc").alias("first_pulled_at_utc"), F.max("last_pulled_at_utc").alias("last_pulled_at_utc"))
    return out.select(*[F.col(f"k.{c}").alias(c) if c in rest else F.col(c) for c in columns])


def new_odds(stored: DataFrame, incoming: DataFrame, incoming_odds: DataFrame) -> DataFrame:
    """The odds of snapshots whose hash isn't stored yet."""
    fresh = incoming.select("content_hash").distinct().join(stored.select("content_hash"), "content_hash", "left_anti")
    return incoming_odds.join(fresh, "content_hash", "left_semi").distinct()


def merge_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(fixtures_seen, new_snapshots, repeat_snapshots)."""
    have = stored.select("content_hash", F.lit(1).alias("have")).distinct()
    both = incoming.select("content_hash").join(have, "content_hash", "left")
    return both.agg(F.count("*").alias("fixtures_seen"), F.count_if(F.col("have").isNull()).alias("new_snapshots"), F.count("have").alias("repeat_snapshots"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The last sighted snapshot of each fixture; of equal ones the greater hash."""
    w = Window.partitionBy("fixture_key").orderBy(F.desc("last_pulled_at_utc"), F.desc("content_hash"))
    return snapshots.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def sighted(snapshots: DataFrame, leagues: list[str] | None = None, unplayed_only: bool = False, latest_only: bool = False) -> DataFrame:
    """Stored snapshots: of some leagues, without those that found their match, the last of each fixture, as asked."""
    rows = snapshots.where(F.col("league").isin(leagues)) if leagues else snapshots
    rows = rows.where("match_id is null") if unplayed_only else rows
    return latest(rows) if latest_only else rows


def odds_of(odds: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The stored prices of snapshots, each once."""
    return odds.join(snapshots.select("content_hash"), "content_hash", "left_semi")


def reconciled(snapshots: DataFrame, matches: DataFrame, days: int = RECONCILE_DAYS) -> DataFrame:
    """snapshots with the match_id of the match of the same clubs whose date is nearest within days, the
    earlier of two as near. Those that have an id keep it; those that find none stay, with a null id.

    Each match stands under the days that it may be sought by, so the join is on equal columns.
    """
    offer = matches.select("league", "home_team", "away_team", F.col("match_id").alias("_id"), F.col("date").alias("_date"))
    offer = offer.withColumn("fixture_date", F.explode(F.sequence(F.date_sub("_date", days), F.date_add("_date", days))))
    pending = snapshots.where("match_id is null").select("content_hash", "league", "home_team", "away_team", "fixture_date")
    near = F.struct(F.abs(F.datediff("fixture_date", "_date")), "_date", "_id")
    found = pending.join(offer, ["league", "home_team", "away_team", "fixture_date"]).groupBy("content_hash").agg(F.min_by("_id", near).alias("_found"))
    out = snapshots.join(found, "content_hash", "left")
    return out.withColumn("match_id", F.coalesce("match_id", "_found")).drop("_found").select(snapshots.columns)


def coverage(snapshots: DataFrame, today) -> DataFrame:
    """Per league: snapshots, fixtures, and how many found their match, should have, or await kick-off; null, not
    zero, where there are none."""
    past = F.col("fixture_date") < F.lit(today).cast("date")
    some = lambda c: F.sum(F.when(c, 1))
    return snapshots.groupBy("league").agg(
        F.count("*").alias("snapshots"), F.count_distinct("fixture_key").alias("fixtures"), some(F.col("match_id").isNotNull()).alias("reconciled"), some(F.col("match_id").isNull() & past).alias("unmatched_past"),
        some(F.col("match_id").isNull() & ~past).alias("awaiting_kickoff"), F.min("first_pulled_at_utc").alias("first_pull"), F.max("last_pulled_at_utc").alias("last_pull"),
    )


def store_snapshot(store, raw: DataFrame, pulled_at: Column, leagues: list[str] | None = None) -> dict[str, int]:
    """Merge a pulled file into the archive; how many fixtures were seen, new and seen again."""
    from .. import schema

    snaps, odds = snapshot(raw, pulled_at, leagues)
    have, have_odds = store.read("fixture_snapshots", schema.SNAPSHOTS), store.read("snapshot_odds", schema.SNAPSHOT_ODDS)
    counts = merge_counts(have, snaps).first().asDict()
    fresh = have_odds.unionByName(new_odds(have, snaps, odds).select(have_odds.columns))
    store.replace("snapshot_odds", fresh)  # odds first: a snapshot is never visible without its prices
    store.replace("fixture_snapshots", merged(have, snaps))
    return counts
