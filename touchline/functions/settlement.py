"""What a bet returns: the parts of the stake that win and that are given back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pricing import is_quarter

EPS = 1e-9
#: Margins of victory from this one on are one selection.
TAIL = 3


def _part(win: Column, push: Column) -> Column:
    return F.struct(win.cast("double").alias("win"), push.cast("double").alias("push"))


def _if(won: Column) -> Column:
    return _part(F.when(won, 1.0).otherwise(0.0), F.lit(0.0))


def _margin_part(margin: Column) -> Column:
    return _part(F.when(margin > EPS, 1.0).otherwise(0.0), F.when(F.abs(margin) <= EPS, 1.0).otherwise(0.0))


def result(home: Column, away: Column) -> Column:
    return F.when(home > away, "home").when(home < away, "away").otherwise("draw")


def match_result(selection: Column, home: Column, away: Column) -> Column:
    return _if(selection == result(home, away))


def double_chance(selection: Column, home: Column, away: Column) -> Column:
    """Selections name two of home, draw and away with _or_ between them."""
    return _if(F.array_contains(F.split(selection, "_or_"), result(home, away)))


def draw_no_bet(selection: Column, home: Column, away: Column) -> Column:
    drawn = home == away
    return _part(F.when(~drawn & (selection == result(home, away)), 1.0).otherwise(0.0), F.when(drawn, 1.0).otherwise(0.0))


def margin_label(home: Column, away: Column) -> Column:
    by = F.abs(home - away)
    size = F.when(by >= TAIL, F.lit(f"{TAIL}_plus")).otherwise(by.cast("string"))
    return F.when(home == away, "draw").otherwise(F.concat_ws("_", result(home, away), size))


def winning_margin(selection: Column, home: Column, away: Column) -> Column:
    return _if(selection == margin_label(home, away))


def over_under(selection: Column, line: Column, count: Column) -> Column:
    away_from = count - line
    push = F.abs(away_from) < EPS
    won = ((selection == "over") & (away_from > 0)) | ((selection == "under") & (away_from < 0))
    return _part(F.when(won & ~push, 1.0).otherwise(0.0), F.when(push, 1.0).otherwise(0.0))


def both_score(selection: Column, home: Column, away: Column) -> Column:
    return _if((selection == "yes") == ((home > 0) & (away > 0)))


def handicap(selection: Column, line: Column, home: Column, away: Column) -> Column:
    """line is that of the side that is backed; a quarter line is two bets of half the stake."""
    margin = F.when(selection == "home", home - away).otherwise(away - home) + line
    low, high = _margin_part(margin - 0.25), _margin_part(margin + 0.25)
    halves = _part((low["win"] + high["win"]) / 2, (low["push"] + high["push"]) / 2)
    return F.when(is_quarter(line), halves).otherwise(_margin_part(margin))


def correct_score(selection: Column, home: Column, away: Column) -> Column:
    return _if(selection == F.concat_ws("-", home.cast("string"), away.cast("string")))


#: Markets of counts: the columns of the home and away count.
_COUNTS = {"corner": ("home_corners", "away_corners"), "card": ("home_cards", "away_cards")}


def settle(market: Column, selection: Column, line: Column) -> Column:
    """struct<win, push> of a bet on the match in the row, which has home_goals, away_goals, home_goals_ht,
    away_goals_ht, home_corners, away_corners, home_cards, away_cards, total_corners and total_cards.

    Null where the row lacks what the market counts. A market without a rule, a withdrawn one too, raises.
    """
    h, a = F.col("home_goals"), F.col("away_goals")
    hh, ah = F.col("home_goals_ht"), F.col("away_goals_ht")
    known, half = h.isNotNull() & a.isNotNull(), hh.isNotNull() & ah.isNotNull()
    cases: list[tuple[str, Column, Column]] = [
        ("1x2", known, match_result(selection, h, a)),
        ("double_chance", known, double_chance(selection, h, a)),
        ("draw_no_bet", known, draw_no_bet(selection, h, a)),
        ("winning_margin", known, winning_margin(selection, h, a)),
        ("btts", known, both_score(selection, h, a)),
        ("correct_score", known, correct_score(selection, h, a)),
        ("total_goals", known, over_under(selection, line, h + a)),
        ("home_goals", h.isNotNull(), over_under(selection, line, h)),
        ("away_goals", a.isNotNull(), over_under(selection, line, a)),
        ("asian_handicap", known, handicap(selection, line, h, a)),
        ("1x2_ht", half, match_result(selection, hh, ah)),
        ("total_goals_ht", half, over_under(selection, line, hh + ah)),
    ]
    for kind, (home, away) in _COUNTS.items():
        c, d, t = F.col(home), F.col(away), F.col(f"total_{kind}s")
        cases += [
            (f"total_{kind}s", t.isNotNull(), over_under(selection, line, t)),
            (f"home_total_{kind}s", c.isNotNull() & d.isNotNull(), over_under(selection, line, c)),
            (f"away_total_{kind}s", c.isNotNull() & d.isNotNull(), over_under(selection, line, d)),
            (f"{kind}_handicap", c.isNotNull() & d.isNotNull(), handicap(selection, line, F.bround(c, 0), F.bround(d, 0))),
        ]
    out = None
    for name, ready, value in cases:
        got = F.when(ready, value)
        out = F.when(market == name, got) if out is None else out.when(market == name, got)
    return out.otherwise(F.raise_error(F.concat(F.lit("no settlement rule for market "), market)).cast("struct<win:double,push:double>"))


def profit(outcome: Column, price: Column) -> Column:
    """Of a stake of one: what wins at the price, less what loses."""
    return outcome["win"] * (price - 1) - (1 - outcome["win"] - outcome["push"])
