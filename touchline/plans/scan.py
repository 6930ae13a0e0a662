"""The forward scan: archived fixtures valued against their prices, with what speaks against each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import pricing
from ..operators import archive, fair, fits, matrix


def reasons(n_home: Column, n_away: Column, ev: Column, least: int = config.SCAN_MIN_TEAM_MATCHES, most: float = config.SCAN_MAX_TRUSTED_EV) -> Column:
    """Why a value shouldn't be ranked, both reasons if both hold; empty if it may be."""
    thin = F.least(n_home, n_away)
    few = F.when(thin < least, F.format_string(f"one side has %d match%s of history, under the {least} required", thin, F.when(thin == 1, "").otherwise("es")))
    big = F.when(ev > most, F.format_string(f"expected value %+.0f%% is over the {most * 100:+.0f}%% that is trusted", ev * 100))
    return F.concat_ws("; and ", few, big)


def thin_history(rows: DataFrame) -> Column:
    """A note on clubs that the model hardly knows."""
    note = lambda side: F.when(F.col(f"{side}_matches") == 0, F.concat(F.col(f"{side}_team"), F.lit(" has no history"))).when(F.col(f"{side}_matches") < config.PROMOTED_MATCHES, F.format_string("%s has %d matches", F.col(f"{side}_team"), F.col(f"{side}_matches")))
    return F.concat_ws("; ", note("home"), note("away"))


def upcoming(snapshots: DataFrame, as_of=None, leagues: list[str] | None = None) -> DataFrame:
    """The latest snapshot of each fixture that has no match; from as_of on, where it is given, so that a fixture of
    the past that never found its match isn't scanned; of some leagues only, where they are."""
    rows = archive.sighted(snapshots, leagues, unplayed_only=True)
    if as_of is not None:
        rows = rows.where(F.col("fixture_date") >= F.lit(as_of).cast("date"))
    return archive.latest(rows)


def valued(
    snapshots: DataFrame, odds: DataFrame, fitted: DataFrame, evidence: DataFrame | None = None, method: str = "shin", as_of=None, leagues: list[str] | None = None, price_source: str | None = None
) -> DataFrame:
    """One row for each offered selection of unplayed fixtures' latest snapshots: the model's probability, the
    market's, the expected value at the best price, notes, and withheld, the reasons not to rank it.

    Nothing is dropped but what has no price; rows that are withheld come last, others by value. price_source names
    the one book whose opening prices are taken, instead of the first in the order of preference.
    """
    now = upcoming(snapshots, as_of, leagues)
    fixtures = now.select("content_hash", "league", "fixture_date", "home_team", "away_team")
    rated = fits.rates(fixtures, fitted.where("intercept is not null"), ["league"])
    cell = matrix.cells(rated, ["content_hash"]).withColumnRenamed("content_hash", "match_id")
    mine = archive.odds_of(odds, now).withColumnRenamed("content_hash", "match_id")
    chosen = fair.compared(fair.chosen_prices(mine, (price_source,) if price_source else config.PRICE_PREFERENCE), fair.fair_probabilities(mine, method))
    priced = matrix.price_offered(cell, chosen, ["match_id"]).where("probability > 0 and price_taken is not null")
    rows = priced.withColumnRenamed("match_id", "content_hash").join(rated, "content_hash")
    ev = pricing.expected_value(F.col("probability"), F.col("price_taken"), F.col("push_probability"))
    conditional = pricing.conditional(F.col("probability"), F.col("push_probability"))
    rows = rows.withColumns({"expected_value": ev, "edge": pricing.edge(conditional, F.col("market_probability")), "note": thin_history(rows)})
    rows = rows.withColumn("withheld", reasons(F.col("home_matches"), F.col("away_matches"), F.col("expected_value")))
    if evidence is not None:
        rows = rows.join(evidence.select("league", "market", F.col("state").alias("evidence")), ["league", "market"], "left")
    else:
        rows = rows.withColumn("evidence", F.lit(None).cast("string"))
    rows = rows.withColumn("evidence", F.coalesce("evidence", F.lit("untested")))
    return rows.orderBy((F.col("withheld") != "").cast("int"), F.desc("expected_value"), "content_hash", "market", "selection", "line")


def top(rows: DataFrame, n: int = 25) -> DataFrame:
    return rows.where("withheld = ''").orderBy(F.desc("expected_value"), "content_hash", "market", "selection", "line").limit(n)
