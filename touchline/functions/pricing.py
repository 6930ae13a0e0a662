"""Prices and probabilities as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Newton steps for the share of informed money, and the bracket it must lie in.
SHIN_STEPS = 12
SHIN_LOW, SHIN_HIGH = 1e-12, 0.4


def implied(price: Column) -> Column:
    """1 / price; null where the price is no price."""
    return F.when(price > 1, 1 / price)


def total(values: Column) -> Column:
    """The sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def overround(prices: Column) -> Column:
    return total(F.transform(prices, implied))


def _usable(prices: Column) -> Column:
    return (F.size(prices) > 1) & F.forall(prices, lambda p: p.isNotNull() & (p > 1))


def _scaled(values: Column) -> Column:
    """values over their sum."""
    return let(total(values), lambda s: F.transform(values, lambda x: x / s))


def multiplicative(prices: Column) -> Column:
    """Implied probabilities over their sum; null if a price is unusable."""
    return F.when(_usable(prices), let(F.transform(prices, implied), _scaled))


def additive(prices: Column) -> Column:
    """An equal part of the margin off each; multiplicative where that leaves one at or below zero."""

    def less(q: Column) -> Column:
        each = let((total(q) - 1) / F.size(q), lambda m: F.transform(q, lambda x: x - m))
        return let(each, lambda out: F.when(F.exists(out, lambda x: x <= 0), _scaled(q)).otherwise(out))

    return F.when(_usable(prices), let(F.transform(prices, implied), less))


def shin(prices: Column) -> Column:
    """Probabilities with the share z of informed money such that they sum to 1.

    With c the square of an implied probability over the sum of all, z solves
    sum(sqrt(z^2 + 4 (1 - z) c)) = 2 + (n - 2) z. The difference of both sides is convex, above zero at z = 0
    and falls to the wanted root, so Newton's steps from 0 rise to it and never pass it. Where the implied
    probabilities sum to 1 or less, or the root isn't in the bracket, it is the multiplicative result. The
    result is scaled to sum to 1.
    """

    def root(c: Column) -> Column:
        def step(z: Column, _: Column) -> Column:
            roots = F.transform(c, lambda x: F.sqrt(z * z + 4 * (1 - z) * x))
            slopes = F.transform(c, lambda x: (z - 2 * x) / F.sqrt(z * z + 4 * (1 - z) * x))
            above = total(roots) - 2 - (F.size(c) - 2) * z
            return z - above / (total(slopes) - (F.size(c) - 2))

        return F.aggregate(F.sequence(F.lit(1), F.lit(SHIN_STEPS)), F.lit(0.0), step)

    def solved(q: Column, booksum: Column) -> Column:
        def at(c: Column, z: Column) -> Column:
            each = F.transform(c, lambda x: (F.sqrt(z * z + 4 * (1 - z) * x) - z) / (2 * (1 - z)))
            return F.when((z > SHIN_LOW) & (z < SHIN_HIGH), let(each, _scaled)).otherwise(_scaled(q))

        informed = let(F.transform(q, lambda x: x * x / booksum), lambda c: let(root(c), lambda z: at(c, z)))
        return F.when(booksum > 1, informed).otherwise(_scaled(q))

    return F.when(_usable(prices), let(F.transform(prices, implied), lambda q: let(total(q), lambda s: solved(q, s))))


METHODS = {"multiplicative": multiplicative, "additive": additive, "shin": shin}


def remove_margin(prices: Column, method: str = "shin") -> Column:
    return METHODS[method](prices)


def fair_price(probability: Column, push: Column) -> Column:
    """The price at which a bet breaks even, infinite for what can't win."""
    return F.when(probability > 0, (1 - push) / probability).otherwise(F.lit(float("inf")))


def expected_value(probability: Column, price: Column, push: Column) -> Column:
    return probability * price + push - 1


def edge(probability: Column, market_probability: Column) -> Column:
    return F.when(market_probability > 0, probability / market_probability - 1)


def conditional(probability: Column, push: Column) -> Column:
    """The probability of winning given that the stake isn't returned."""
    return F.when(1 - push > 1e-9, probability / (1 - push))


def kelly(probability: Column, price: Column, fraction: float = 0.25, cap: float = 0.02) -> Column:
    """The share of the bankroll to stake."""
    gain = probability * price - 1
    return F.when((gain > 0) & (price > 1), F.least(F.lit(cap), fraction * gain / (price - 1))).otherwise(F.lit(0.0))


def is_quarter(line: Column) -> Column:
    """Whether a line lies halfway between two half lines."""
    return F.abs(F.round(line * 2) / 2 - line) > 1e-9


def line_key(line: Column) -> Column:
    """Lines that are equal but for rounding; null stays null, and zero has no sign."""
    return F.bround(line, 3) + F.lit(0.0)
