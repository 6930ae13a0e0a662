"""Predictions against results: losses, calibration, closing-line value, uncertainty and staking.

Predictions have match_id, date, market, selection, line, model_conditional, market_probability,
win_fraction, push_fraction, expected_value, clv, price_movement, price_taken, profit_at_taken,
fair_line_source and book_prices; each function reads what it needs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from .fits import newton

EPSILON = 1e-12
BANDS = 10
EDGE = 0.02


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def judged(predictions: DataFrame) -> DataFrame:
    """Rows with an outcome y of 0 or 1: pushes and unknown probabilities are left out, a half win is none."""
    rows = predictions.where("push_fraction < 0.5 and model_conditional is not null")
    return rows.withColumn("y", (F.col("win_fraction") > 0.5).cast("double"))


def bets(predictions: DataFrame, edge: float = EDGE, low: float = 1.2, high: float = 15.0) -> DataFrame:
    """A bet has a known expected value of at least the edge and a price in range; no price, no bet."""
    return predictions.where(F.col("expected_value").isNotNull() & (F.col("expected_value") >= edge) & F.col("price_taken").between(low, high))


def edges(bands: int = BANDS) -> list[float]:
    return np.linspace(0, 1, bands + 1).tolist()


def band(p: Column, bands: int = BANDS) -> Column:
    """The band a probability lies in, from 0; null at 1 and beyond. Edges are compared as they are stored."""
    at, out = edges(bands), F.lit(None).cast("int")
    for k in reversed(range(bands)):
        out = F.when((p >= at[k]) & (p < at[k + 1]), k).otherwise(out)
    return out


def band_label(k: Column, bands: int = BANDS) -> Column:
    return F.format_string("%.2f-%.2f", k / bands, (k + 1) / bands)


def calibration(predictions: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """(keys, band, n, predicted, observed, gap) of judged rows; bands of fewer than least rows are left out."""
    rows = judged(predictions).withColumn("k", band(F.col("model_conditional"))).where("k is not null")
    out = rows.groupBy(*keys, "k").agg(F.count("*").alias("n"), F.avg("model_conditional").alias("predicted"), F.avg("y").alias("observed")).where(F.col("n") >= least)
    return out.select(*keys, band_label(F.col("k")).alias("band"), "n", "predicted", "observed", (F.col("observed") - F.col("predicted")).alias("gap"))


def calibration_by_line(predictions: DataFrame, market: str, side: str, least: int = 25) -> DataFrame:
    """Calibration of one side of a market at each line, with the error that its probabilities imply."""
    p = F.col("model_conditional")
    rows = judged(predictions.where((F.col("market") == market) & (F.col("selection") == side))).withColumn("k", band(p)).where("k is not null")
    out = rows.groupBy("line", "k").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg("y").alias("observed"), (F.sqrt(F.sum(p * (1 - p))) / F.count("*")).alias("se")).where(F.col("n") >= least)
    gap = F.col("observed") - F.col("predicted")
    return out.select("line", band_label(F.col("k")).alias("band"), "n", "predicted", "observed", gap.alias("gap"), "se", F.when(F.col("se") > 0, gap / F.col("se")).alias("z"))


def market_scores(predictions: DataFrame, keys: tuple[str, ...] = ("market",), least_priced: int = 30) -> DataFrame:
    """(keys, n, model_log_loss, model_brier, base_rate_log_loss, n_priced, …): the model against the share of
    winners and, where enough rows have one, against the market. One aggregation."""
    p, y, q = F.col("model_conditional"), F.col("y"), F.col("market_probability")
    priced = lambda x: F.when(q.isNotNull(), x)
    out = judged(predictions).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(log_loss(p, y)).alias("model_log_loss"), F.avg(brier(p, y)).alias("model_brier"), F.avg(y).alias("base"), F.count(q).alias("n_priced"), F.avg(priced(log_loss(p, y))).alias("m"), F.avg(priced(log_loss(q, y))).alias("k"))
    b = F.least(F.greatest(F.col("base"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    enough = lambda x: F.when(F.col("n_priced") >= least_priced, x)
    entropy = -(F.col("base") * F.ln(b) + (1 - F.col("base")) * F.ln(1 - b))
    return out.select(*keys, "n", "model_log_loss", "model_brier", entropy.alias("base_rate_log_loss"), enough(F.col("n_priced")).alias("n_priced"), enough(F.col("m")).alias("model_log_loss_priced"), enough(F.col("k")).alias("market_log_loss"), enough(F.col("m") - F.col("k")).alias("log_loss_gap"))


def closing_line_value(rows: DataFrame, keys: list[str]) -> DataFrame:
    v, known = F.col("clv"), rows.where("clv is not null")
    moved = F.count("price_movement")
    return known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean_clv"), F.percentile(v, 0.5).alias("median_clv"), F.avg((v > 0).cast("double")).alias("beat_close_rate"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("clv_standard_error"),
        F.when(moved >= 20, F.avg("price_movement")).alias("mean_price_movement"), F.when(moved >= 20, moved).alias("n_price_movement"),
    )


def clustered(rows: DataFrame, keys: list[str], value: str, cluster: str) -> DataFrame:
    """(keys, n, n_clusters, mean, se): the error of a mean whose values within a cluster aren't independent.

    Sums of each cluster are enough: a cluster's residual is its sum less its size times the mean.
    """
    v = F.when(~F.isnan(value), F.col(value))
    one = rows.where(v.isNotNull()).groupBy(*keys, cluster).agg(F.count("*").alias("c"), F.sum(v).alias("s"))
    out = one.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("n_clusters"), (F.sum("s") / F.sum("c")).alias("mean"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("c")).alias("sc"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    square = F.col("ss") - 2 * F.col("mean") * F.col("sc") + F.col("mean") * F.col("mean") * F.col("cc")
    g = F.col("n_clusters")
    return out.select(*keys, "n", "n_clusters", "mean", F.when(g >= 2, F.sqrt(g / (g - 1) * F.greatest(square, F.lit(0.0))) / F.col("n")).alias("se"))


def seasons(predictions: DataFrame, edge: float = EDGE, season: Column | None = None) -> DataFrame:
    """One row a season: what was priced, the bets' closing-line value with both errors, the losses."""
    rows = predictions.withColumn("season", season if season is not None else dates.season_start(F.col("date")))
    taken = rows.where(F.col("expected_value").isNotNull() & (F.col("expected_value") >= edge) & F.col("clv").isNotNull())
    base = rows.groupBy("season").agg(F.count_distinct("match_id").alias("matches"), F.count("*").alias("priced"))
    robust = clustered(taken, ["season"], "clv", "match_id").select("season", F.col("n").alias("bets"), F.col("mean").alias("mean_clv"), F.col("se").alias("se_clustered"))
    naive = closing_line_value(taken, ["season"]).select("season", F.col("clv_standard_error").alias("se_naive"), F.col("beat_close_rate").alias("beat_close"))
    losses = market_scores(rows, ("season",)).select("season", "model_log_loss", "market_log_loss", "log_loss_gap")
    out = base.join(robust, "season", "left").join(naive, "season", "left").join(losses, "season", "left")
    return out.withColumns({"bets": F.coalesce("bets", F.lit(0)), "z": F.when(F.col("se_clustered") > 0, F.col("mean_clv") / F.col("se_clustered"))})


def eras(predictions: DataFrame, split: int, edge: float = EDGE) -> DataFrame:
    """Mean closing-line value before a season and from it on, and the difference; no row unless both have bets."""
    rows = predictions.withColumn("after", dates.season_start(F.col("date")) >= split)
    taken = rows.where(F.col("expected_value").isNotNull() & (F.col("expected_value") >= edge) & F.col("clv").isNotNull())
    two = clustered(taken, ["after"], "clv", "match_id")
    side = lambda c, after: F.max(F.when(F.col("after") == F.lit(after), F.col(c)))
    out = two.agg(*[side(c, after).alias(f"{name}_{'after' if after else 'before'}") for after in (False, True) for c, name in (("n", "n"), ("mean", "mean_clv"), ("se", "se"))])
    d = F.col("mean_clv_after") - F.col("mean_clv_before")
    se = F.sqrt(F.col("se_before") * F.col("se_before") + F.col("se_after") * F.col("se_after"))
    return out.where("n_before > 0 and n_after > 0").withColumns({"split_season": F.lit(split), "difference": d, "difference_se": se, "difference_z": F.when(se > 0, d / se)})


def bookmakers(predictions: DataFrame, least: int = 100) -> DataFrame:
    one = predictions.select(F.explode("book_prices").alias("bookmaker", "clv"))
    return one.groupBy("bookmaker").agg(F.count("*").alias("selections"), F.avg("clv").alias("mean_clv"), F.avg((F.col("clv") > 0).cast("double")).alias("beat_close")).where(F.col("selections") >= least)


def fair_sources(predictions: DataFrame) -> DataFrame:
    """(season, fair_line_source, selections, share of the season's)."""
    rows = predictions.where("fair_line_source is not null").withColumn("season", dates.season_start(F.col("date")))
    n = rows.groupBy("season", "fair_line_source").agg(F.count("*").alias("selections"))
    return n.withColumn("share", F.col("selections") / F.sum("selections").over(Window.partitionBy("season")))


def benchmark_changes(sources: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(season, before, now) of seasons whose dominant source differs from that of the last that had one."""
    top = sources.groupBy("season").agg(F.max("share").alias("share"), F.max_by("fair_line_source", F.struct("share", "fair_line_source")).alias("now")).where(F.col("share") >= threshold)
    w = Window.partitionBy(F.lit(1)).orderBy("season")  # seasons: tens of rows
    return top.withColumn("before", F.lag("now").over(w)).where("before is not null and before <> now").select("season", "before", "now")


def calibration_slope(predictions: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """(keys, n, intercept, slope, slope_se, slope_z): outcomes by the log-odds of the probability.

    Newton steps on two coefficients. Each group is first reduced to counts at its distinct probabilities,
    rounded at the tenth decimal, so that a group of any size is a bounded list of sums. Null beside n where
    there are fewer than 30 rows or one outcome only.
    """
    p = F.least(F.greatest(F.round("model_conditional", 10), F.lit(EPSILON)), F.lit(1 - EPSILON))
    points = judged(predictions).groupBy(*keys, F.ln(p / (1 - p)).alias("x")).agg(F.count("*").alias("c"), F.sum("y").alias("s"))
    schema = points.select(*keys).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", n bigint, intercept double, slope double, slope_se double, slope_z double"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, c, s = (group[k].to_numpy(float) for k in ("x", "c", "s"))
        row = {k: group[k].iloc[0] for k in keys} | {"n": int(c.sum()), "intercept": None, "slope": None, "slope_se": None, "slope_z": None}
        if c.sum() >= 30 and 0 < s.sum() < c.sum():
            design = np.column_stack([np.ones_like(x), x])
            mean = lambda t: 1 / (1 + np.exp(-np.clip(design @ t, -700, 700)))
            value = lambda t: (c * np.logaddexp(0, design @ t) - s * (design @ t)).sum()

            def curve(t):
                mu = mean(t)
                return -design.T @ (s - c * mu), design.T @ (design * (c * mu * (1 - mu))[:, None]) + 1e-12 * np.eye(2)

            theta, _ = newton(value, curve, np.array([0.0, 1.0]), np.full(2, -50.0), np.full(2, 50.0), rounds)
            info = curve(theta)[1]
            se = float(np.sqrt(np.linalg.pinv(info)[1, 1]))
            row |= {"intercept": float(theta[0]), "slope": float(theta[1]), "slope_se": se, "slope_z": float((theta[1] - 1) / se) if se > 0 else None}
        return pd.DataFrame([row])

    return points.groupBy(*keys).applyInPandas(fit, fields)


def total_fit(totals: DataFrame, top: int = 6) -> tuple[DataFrame, DataFrame]:
    """Whether totals scatter as predicted: (dispersion and variances, buckets) of match totals (observed_total,
    total_pmf)."""
    pmf = F.col("total_pmf")
    mean = F.aggregate(F.transform(pmf, lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)
    second = F.aggregate(F.transform(pmf, lambda p, k: p * k * k), F.lit(0.0), lambda a, x: a + x)
    rows = totals.select("observed_total", "total_pmf", mean.alias("m"), (second - mean * mean).alias("v"))
    squared = F.when(F.col("v") > 0, F.pow(F.col("observed_total") - F.col("m"), 2) / F.col("v"))
    whole = rows.agg(
        F.count(squared).alias("n"), F.avg(squared).alias("dispersion"), (F.stddev_samp(squared) / F.sqrt(F.count(squared))).alias("dispersion_se"), F.avg("observed_total").alias("observed_mean"), F.avg("m").alias("predicted_mean"),
        F.var_samp("observed_total").alias("observed_variance"), F.avg("v").alias("within_match_variance"), F.var_samp("m").alias("between_match_variance"),
    )
    bucket = lambda k: F.coalesce(F.get(pmf, F.lit(k)), F.lit(0.0))
    tail = F.aggregate(F.slice(pmf, top + 2, 1000), F.lit(0.0), lambda a, x: a + x)
    entries = [F.struct(F.lit(str(k)).alias("total"), (F.col("observed_total") == k).cast("int").alias("hit"), bucket(k).alias("p")) for k in range(top + 1)]
    entries.append(F.struct(F.lit(f"{top + 1}+").alias("total"), (F.col("observed_total") > top).cast("int").alias("hit"), tail.alias("p")))
    b = rows.select(F.inline(F.array(*entries))).groupBy("total").agg(F.sum("hit").alias("observed"), F.sum("p").alias("expected"), F.sqrt(F.sum(F.col("p") * (1 - F.col("p")))).alias("se"))
    d = F.col("observed") - F.col("expected")
    return whole, b.withColumns({"difference": d, "z": F.when(F.col("se") > 0, d / F.col("se"))})


def flat_ledger(rows: DataFrame, key: str = "league") -> DataFrame:
    """Each bet of a unit stake with running profit, turnover, peak and drawdown, in order of date.

    Running sums are made within a day, and what a day begins with comes from one row a day: no task gets all the
    bets of a key.
    """
    day = Window.partitionBy(key, "date").orderBy("match_id", "market", "selection", "line").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({"_sum": F.sum("profit_at_taken").over(day), "_n": F.count("*").over(day)}).withColumn("_top", F.max("_sum").over(day))
    days = within.groupBy(key, "date").agg(F.sum("profit_at_taken").alias("_s"), F.max("_sum").alias("_t"), F.count("*").alias("_c"))
    past = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"_bank": F.coalesce(F.sum("_s").over(past), F.lit(0.0)), "_bets": F.coalesce(F.sum("_c").over(past), F.lit(0))})
    days = days.withColumn("_peak", F.max(F.col("_bank") + F.col("_t")).over(past)).select(F.col(key).alias("_key"), F.col("date").alias("_date"), "_bank", "_bets", "_peak")
    met = within.join(days, F.col(key).eqNullSafe(F.col("_key")) & F.col("date").eqNullSafe(F.col("_date")), "left")
    bank = F.when(F.col("_sum").isNotNull() | F.col("_peak").isNotNull(), F.col("_bank") + F.coalesce("_sum", F.lit(0.0)))
    out = met.select(*rows.columns, bank.alias("bankroll"), (F.col("_bets") + F.col("_n")).cast("double").alias("turnover"), F.greatest("_peak", F.col("_bank") + F.col("_top")).alias("peak"))
    return out.withColumn("drawdown", F.col("bankroll") - F.col("peak"))


def staking_summary(ledger: DataFrame, key: str = "league") -> DataFrame:
    p = F.col("profit_at_taken")
    return ledger.groupBy(key).agg(F.count("*").alias("bets"), F.sum(p).alias("profit"), F.avg(p).alias("roi"), F.avg((p > 0).cast("double")).alias("win_rate"), F.min(F.col("drawdown") / F.col("turnover")).alias("max_drawdown"), F.min("drawdown").alias("max_drawdown_units"))


def kelly_ledger(rows: DataFrame, key: str = "league", start: float = 1000.0, fraction: float = 0.25, cap: float = 0.02) -> DataFrame:
    """(key, bets, final_bankroll, peak, max_drawdown, busted): each stake is a share of what is left after the last.

    What is left depends on all bets before it, so a key's bets pass in order through one task: sorted by Spark, which
    spills, and taken batch by batch with five numbers carried along. No key is ever held whole. A bankroll beyond the
    largest double is infinite, and not a number once it then loses; as in SQL that is more than any number, no bust.
    """
    gain = F.col("model_probability") * F.col("price_taken") - 1
    share = F.when(gain > 0, F.least(F.lit(cap), fraction * gain / (F.col("price_taken") - 1))).otherwise(0.0)
    order = ("date", "match_id", "market", "selection", "line")
    staked = rows.where("price_taken > 1 and profit_at_taken is not null").select(key, *order, share.alias("share"), "profit_at_taken")
    lined = staked.repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, "share", "profit_at_taken")

    kinds = f"`{key}` {rows.schema[key].dataType.simpleString()}, bets bigint, final_bankroll double, peak double, max_drawdown double, busted boolean"
    names = [key, "bets", "final_bankroll", "peak", "max_drawdown", "busted"]

    def run(batches):
        now, (bank, peak, down, n) = None, (start, start, 0.0, 0)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now[0], n, bank, peak, down, bank <= 0), kind)], names)
        kind = [None, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            kind[0] = batch.schema.field(0).type
            for k, part, gained in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (k,):
                    if now:
                        yield row()
                    now, (bank, peak, down, n) = (k,), (start, start, 0.0, 0)
                n += part > 0 and not bank <= 0
                bank = bank + bank * part * gained
                bank = 0.0 if bank < 0 else bank
                peak = peak if bank <= peak else bank
                down = min(down, (bank - peak) / peak)
        if now:
            yield row()

    return lined.mapInArrow(run, kinds)


def bootstrap_roi(rows: DataFrame, key: str = "league", draws: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(key, n, n_days, roi, roi_low, roi_high, probability_profitable), drawing whole days with replacement.

    Days are summed first, so a key's group is one row a day. Fewer than 20 bets: n only.
    """
    days = rows.where("profit_at_taken is not null").groupBy(key, "date").agg(F.sum("profit_at_taken").alias("s"), F.count("*").alias("c"))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        s, c = group["s"].to_numpy(float), group["c"].to_numpy(float)
        row = {key: group[key].iloc[0], "n": int(c.sum()), "n_days": len(group), "roi": None, "roi_low": None, "roi_high": None, "probability_profitable": None}
        if c.sum() >= 20:
            r, out = np.random.default_rng(seed), np.empty(draws)
            for a in range(0, draws, 100):
                pick = r.integers(0, len(s), (min(100, draws - a), len(s)))
                out[a : a + len(pick)] = s[pick].sum(axis=1) / c[pick].sum(axis=1)
            tail = (1 - confidence) / 2
            row |= {"roi": float(s.sum() / c.sum()), "roi_low": float(np.quantile(out, tail)), "roi_high": float(np.quantile(out, 1 - tail)), "probability_profitable": float((out > 0).mean())}
        return pd.DataFrame([row])

    kind = days.schema[key].dataType.simpleString()
    return days.groupBy(key).applyInPandas(draw, f"`{key}` {kind}, n bigint, n_days bigint, roi double, roi_low double, roi_high double, probability_profitable double")


STATES = ("backtested", "calibration-only", "untested", "withdrawn")


def evidence(predictions: DataFrame, keys: tuple[str, ...] = ("league", "market")) -> DataFrame:
    """One row for each league and market: what is known of it and which of STATES that makes it.

    Of a market with both, the rows without a price are scored; bets say whether it was backtested.
    """
    from ..config import WITHDRAWN_MARKETS

    has = predictions.groupBy(*keys).agg(F.max(F.col("priceless").cast("int")).alias("free"))
    rows = predictions.join(has, list(keys)).where((F.col("free") == 0) | F.col("priceless")).drop("free")
    scores = market_scores(rows, keys).select(*keys, "n", F.col("model_log_loss").alias("log_loss"), "base_rate_log_loss")
    slopes = calibration_slope(rows, list(keys)).select(*keys, "slope", "slope_se")
    value = clustered(predictions.where("expected_value is not null and clv is not null"), list(keys), "clv", "match_id").select(*keys, F.col("n").alias("n_bets"), F.col("mean").alias("mean_clv"), F.col("se").alias("clv_se"))
    out = scores.join(slopes, list(keys), "left").join(value, list(keys), "left")
    state = F.when(F.col("market").isin(*WITHDRAWN_MARKETS), STATES[3]).when(F.col("n_bets") > 0, STATES[0]).when(F.col("n") > 0, STATES[1]).otherwise(STATES[2])
    return out.withColumn("state", state)
