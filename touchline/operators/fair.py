"""Prices chosen among bookmakers, and market probabilities without the margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLOSING_PREFERENCE, FAIR_PREFERENCE, PRICE_PREFERENCE
from ..functions import pricing

KEYS = ("match_id", "market", "selection", "line")


def _rank(book: Column, preference: tuple[str, ...]) -> Column:
    """The place in the order of preference, from 1; null if a book isn't in it."""
    return F.nullif(F.array_position(F.array(*[F.lit(b) for b in preference]), book), F.lit(0))


#: Selections of the markets that books price.
SIDES = ("home", "draw", "away", "over", "under", "yes", "no")


def chosen_prices(odds: DataFrame, taken: tuple[str, ...] = PRICE_PREFERENCE, closing: tuple[str, ...] = CLOSING_PREFERENCE, books: bool = False) -> DataFrame:
    """One row for each offered selection: the opening price taken and whose, the closing price and whose, and
    what the book taken closed at; with books also opens, every book's opening price.

    Where a book has several prices of a selection in a phase, the smallest counts. One aggregation of odds, of
    one double for each book in either order of preference; nothing is joined.
    """
    rows = odds.withColumn("line", pricing.line_key(F.col("line")))
    price = lambda phase, book: F.min(F.when((F.col("phase") == phase) & (F.col("bookmaker") == book), F.col("price")))
    slots = {("open", b): f"_open_{k}" for k, b in enumerate(taken)} | {("close", b): f"_close_{k}" for k, b in enumerate(dict.fromkeys((*closing, *taken)))}
    held = [price(*slot).alias(name) for slot, name in slots.items()]
    if books:  # a selection's books are few
        held.append(F.array_sort(F.collect_set(F.when(F.col("phase") == "open", F.struct("bookmaker", "price")))).alias("_opens"))
    got = rows.groupBy(*KEYS).agg(*held)

    def first(phase: str, order: tuple[str, ...], of) -> Column:
        return F.coalesce(*[F.when(F.col(slots[phase, b]).isNotNull(), of(b)) for b in order])

    out = [
        first("open", taken, lambda b: F.col(slots["open", b])).alias("price_taken"), first("open", taken, F.lit).alias("price_source"),
        first("close", closing, lambda b: F.col(slots["close", b])).alias("price_close"), first("close", closing, F.lit).alias("closing_source"),
        _same_book(slots, taken).alias("same_book_close"),
    ]
    if books:
        opens = F.filter("_opens", lambda x, k: (k == 0) | (F.get("_opens", k - 1)["bookmaker"] != x["bookmaker"]))
        out.append(F.map_from_entries(opens).alias("opens"))
    return got.select(*KEYS, *out)


def _same_book(slots: dict, taken: tuple[str, ...]) -> Column:
    """The closing price of the first book in taken that has an opening one."""
    out = F.lit(None).cast("double")
    for b in reversed(taken):
        out = F.when(F.col(slots["open", b]).isNotNull(), F.col(slots["close", b])).otherwise(out)
    return out


def fair_probabilities(odds: DataFrame, method: str = "shin", preference: tuple[str, ...] = FAIR_PREFERENCE, fallback: bool = True) -> DataFrame:
    """(match_id, market, selection, line, market_probability, fair_line_source).

    A market is a match's market at one line, as the home side sees it. Closing prices come first and opening
    ones only if no book closed the whole market; of books the first in preference, then others by name unless
    fallback is off. Probabilities are those of not pushing. Where a book has several prices of a selection in a
    phase, the smallest above 1 counts; prices of 1 or less and selections outside SIDES are none.

    The odds are dealt once, by market; both aggregations keep that dealing. The book is chosen before its
    margin is removed, so a market is solved once.
    """
    home_line = F.when((F.col("market") == "asian_handicap") & (F.col("selection") == "away"), -F.col("line")).otherwise(F.col("line"))
    rank = _rank(F.col("bookmaker"), preference)
    rows = odds.where("price > 1").select("match_id", "market", pricing.line_key(home_line).alias("group_line"), "phase", "bookmaker", "selection", "price")
    if not fallback:
        rows = rows.where(F.col("bookmaker").isin(*preference))
    market = ("match_id", "market", "group_line")
    sides = rows.repartition(*market).groupBy(*market, "phase", "bookmaker").agg(*[F.min(F.when(F.col("selection") == s, F.col("price"))).alias(s) for s in SIDES])
    held = sum((F.col(s).isNotNull().cast("int") for s in SIDES), F.lit(0))
    whole = sides.where(held == F.when(F.col("market") == "1x2", 3).otherwise(2))
    book = F.struct(F.when(F.col("phase") == "close", 0).otherwise(1).alias("phase"), F.coalesce(rank, F.lit(len(preference) + 1)).alias("rank"), "bookmaker", *SIDES)
    best = whole.groupBy(*market).agg(F.min(book).alias("b"))
    line = lambda s: F.when(F.col("market") == "asian_handicap", -F.col("group_line") + F.lit(0.0)).otherwise(F.col("group_line")) if s == "away" else F.col("group_line")
    legs = F.filter(F.array(*[F.struct(F.lit(s).alias("selection"), line(s).alias("line"), F.col(f"b.{s}").alias("price")) for s in SIDES]), lambda x: x["price"].isNotNull())
    chosen = best.select("match_id", "market", F.col("b.bookmaker").alias("fair_line_source"), legs.alias("legs"))
    solved = chosen.select("*", pricing.remove_margin(F.transform("legs", lambda x: x["price"]), method).alias("p"))
    out = solved.select("match_id", "market", "fair_line_source", F.inline(F.arrays_zip("legs", "p")))
    return out.select("match_id", "market", "legs.selection", "legs.line", F.col("p").alias("market_probability"), "fair_line_source")


def compared(chosen: DataFrame, fair: DataFrame) -> DataFrame:
    """chosen with the market's probability; a line that is null meets one that is null."""
    f = fair.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "market_probability", "fair_line_source")
    on = [chosen[k] == f[f"_{k}"] for k in KEYS[:3]] + [chosen["line"].eqNullSafe(f["_line"])]
    return chosen.join(f, on, "left").drop(*[f"_{k}" for k in KEYS])


def closing_value(rows: DataFrame) -> DataFrame:
    """rows with clv and price_movement, and where they have opens with book_prices: each book's opening price
    against the same fair line."""
    clv = F.col("price_taken") * F.col("market_probability") - 1
    out = rows.withColumns({"clv": clv, "price_movement": F.when(F.col("same_book_close") > 0, F.col("price_taken") / F.col("same_book_close") - 1)})
    if "opens" not in rows.columns:
        return out
    books = F.transform_values(F.map_filter("opens", lambda _, p: p > 1), lambda _, p: p * F.col("market_probability") - 1)
    return out.withColumn("book_prices", F.when(F.col("market_probability").isNotNull(), books)).drop("opens")
