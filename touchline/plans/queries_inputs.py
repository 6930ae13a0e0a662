"""Registered queries of sources, names, counts and staking, each beside the SQL of the same result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import config
from ..functions import dates, names, pricing
from ..operators import archive, availability, fair, fits, matrix, quality, scoring, teams
from ..sources import season_files
from ..streaming import archive as stream
from . import lens, research, walk
from .queries import _CELLS, _FAIR_LEGS, _I, _M, _O, _P, _PULLS, _TM, AS_OF, ORACLE, _bets, _matches, _round, _snapshots, _whole_walk, query

# ---- sources ----------------------------------------------------------------------------------------------

_BASE = ("goals", "goals_ht", "shots", "sot", "corners", "fouls", "yellows", "reds")


@query("derived_metrics", f"""SELECT match_id, home_goals + away_goals AS total_goals, home_goals - away_goals AS goal_difference, home_goals > 0 AND away_goals > 0 AS btts, home_goals_ht + away_goals_ht AS goals_ht,
  home_corners + away_corners AS total_corners, home_yellows + away_yellows AS total_yellows, home_reds + away_reds AS total_reds, home_shots + away_shots AS total_shots, home_sot + away_sot AS total_sot, home_fouls + away_fouls AS total_fouls,
  home_goals + away_goals > 1.5 AS over_1_5, home_goals + away_goals > 2.5 AS over_2_5, home_goals + away_goals > 3.5 AS over_3_5, home_goals + away_goals - home_goals_ht - away_goals_ht AS goals_2h,
  home_yellows + away_yellows + home_reds + away_reds AS total_cards, (home_yellows + away_yellows) * 10 + (home_reds + away_reds) * 25 AS booking_points FROM {_M} AS m""")
def derived_metrics(spark, d):
    base = [f"{side}_{c}" for c in _BASE for side in ("home", "away")]
    return _round(season_files.derived(_matches(spark, d).select("match_id", *base)).drop(*base))


def _price_text(j: int) -> str:
    return f"CASE WHEN o_orderkey % 13 = {j} THEN '' ELSE CONCAT(CAST(1 + o_orderkey * {j} % 4 AS STRING), '.', CAST(o_orderkey % 10 AS STRING)) END"


#: Wide prices as a season file has them: column, and the long row that it makes.
_WIDE = [("B365H", "bet365", "open", "1x2", "home", None), ("B365D", "bet365", "open", "1x2", "draw", None), ("B365A", "bet365", "open", "1x2", "away", None), ("PSCH", "pinnacle", "close", "1x2", "home", None), ("PSCD", "pinnacle", "close", "1x2", "draw", None)]
_WIDE += [("B365>2.5", "bet365", "open", "total_goals", "over", "2.5"), ("B365<2.5", "bet365", "open", "total_goals", "under", "2.5"), ("MaxAHH", "market_max", "open", "asian_handicap", "home", "1"), ("MaxAHA", "market_max", "open", "asian_handicap", "away", "-1")]
_LINE_TEXT = "CASE o_orderkey % 3 WHEN 0 THEN '-0.25' WHEN 1 THEN '0.5' ELSE '' END"


def _long_sql() -> str:
    parts = []
    for j, (_, book, phase, market, selection, line) in enumerate(_WIDE):
        x = {None: "CAST(NULL AS DOUBLE)", "2.5": "CAST(2.5 AS DOUBLE)"}.get(line, f"TRY_CAST({_LINE_TEXT} AS DOUBLE) * {line}")
        parts.append(f"SELECT CAST(o_orderkey AS STRING) AS match_id, '{book}' AS bookmaker, '{phase}' AS phase, '{market}' AS market, '{selection}' AS selection, {x} AS line, TRY_CAST({_price_text(j)} AS DOUBLE) AS price FROM orders")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS x WHERE price > 1"


@query("odds_long", _long_sql())
def odds_long(spark, d):
    wide = spark.read.parquet(f"{d}/orders.parquet")
    rows = wide.select(F.col("o_orderkey").cast("string").alias("key"), F.expr(_LINE_TEXT).alias("AHh"), *[F.expr(_price_text(j)).alias(c) for j, (c, *_) in enumerate(_WIDE)])
    return season_files.odds_long(rows, "key")


@query("match_dates", f"SELECT match_id, date FROM {_M} AS m")
def match_dates(spark, d):
    """Dates written in turn as each source writes them, read again."""
    k = F.col("match_id").cast("bigint") % 4
    text = F.when(k == 0, F.date_format("date", "dd/MM/yyyy")).when(k == 1, F.date_format("date", "dd/MM/yy")).when(k == 2, F.date_format("date", "yyyy-MM-dd")).otherwise(F.concat(F.lit(" "), F.date_format("date", "d.M.yyyy"), F.lit(" ")))
    return _matches(spark, d).select("match_id", dates.match_date(text).alias("date"))


@query("season_codes", f"""SELECT match_id, printf('%02d%02d', season_start_year % 100, (season_start_year + 1) % 100) AS code, league || '_' || strftime(date, '%Y%m%d') || '_' || trim(regexp_replace(lower(home_team), '[^a-z0-9]+', '_', 'g'), '_') || '_' || trim(regexp_replace(lower(away_team), '[^a-z0-9]+', '_', 'g'), '_') AS fixture_key FROM {_M} AS m""")
def season_codes(spark, d):
    return _matches(spark, d).select("match_id", dates.season_code(dates.season_start(F.col("date"))).alias("code"), archive.fixture_key(F.col("league"), F.col("date"), F.col("home_team"), F.col("away_team")).alias("fixture_key"))


@query("club_names", r"""SELECT s_suppkey, trim(regexp_replace(replace(' M.' || s_name || '.  Jr ', '.', ' '), '\s+', ' ', 'g')) AS referee, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS external_key,
  CASE s_suppkey % 5 WHEN 0 THEN 'Tottenham' WHEN 1 THEN 'Man United' WHEN 2 THEN 'FC Koln' WHEN 3 THEN 'Nott''m Forest' ELSE s_name END AS team FROM supplier""")
def club_names(spark, d):
    k = F.col("s_suppkey") % 5
    written = F.when(k == 0, "Spurs").when(k == 1, " Manchester  UNITED").when(k == 2, "Köln").when(k == 3, "Nott’m Forest").otherwise(F.concat(F.lit(" "), F.col("s_name")))
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    return rows.select("s_suppkey", names.referee(F.concat(F.lit(" M."), "s_name", F.lit(".  Jr "))).alias("referee"), names.external_key(F.concat(F.lit("FC "), "s_name", F.lit(" 1907"))).alias("external_key"), names.canonical_team(written).alias("team"))


# ---- prices -----------------------------------------------------------------------------------------------

@query("conditional_prices", f"""SELECT match_id, market, selection, line, ROUND(1 / price / 0.8, 6) AS conditional, ROUND(0.5 * price - 1, 6) AS edge FROM {_O} AS o WHERE phase = 'open' AND bookmaker = 'bet365'""")
def conditional_prices(spark, d):
    rows = lens.read(spark, d, "odds").where("phase = 'open' and bookmaker = 'bet365'")
    p = 1 / F.col("price")
    return _round(rows.select("match_id", "market", "selection", "line", pricing.conditional(p, F.lit(0.2)).alias("conditional"), pricing.edge(F.lit(0.5), p).alias("edge")))


@query("book_clv", f"""WITH {_FAIR_LEGS}, f AS (SELECT match_id, market, selection, line, 1 / price / SUM(1 / price) OVER (PARTITION BY match_id, market, group_line) AS p FROM best)
  SELECT bookmaker, COUNT(*) AS selections, ROUND(AVG(price * p - 1), 6) AS mean_clv, ROUND(AVG(CASE WHEN price * p - 1 > 0 THEN 1.0 ELSE 0.0 END), 6) AS beat_close
  FROM (SELECT * FROM {_O} AS x WHERE phase = 'open' AND price > 1) AS o JOIN f ON o.match_id = f.match_id AND o.market = f.market AND o.selection = f.selection AND o.line IS NOT DISTINCT FROM f.line GROUP BY bookmaker HAVING COUNT(*) >= 100""")
def book_clv(spark, d):
    odds = lens.read(spark, d, "odds")
    rows = fair.closing_value(fair.compared(fair.chosen_prices(odds, books=True), fair.fair_probabilities(odds, "multiplicative")))
    return _round(scoring.bookmakers(rows))


# ---- training rows and line-ups -----------------------------------------------------------------------------

@query("half_time_rows", f"SELECT match_id, home_goals_ht AS home_goals, away_goals_ht AS away_goals, ROUND(POW(0.5, GREATEST(DATE '{AS_OF}' - date, 0) / 180.0), 9) AS weight FROM {_M} AS m WHERE date < DATE '{AS_OF}' AND home_goals_ht IS NOT NULL AND away_goals_ht IS NOT NULL")
def half_time_rows(spark, d):
    rows = teams.half_time(teams.training_rows(_matches(spark, d), AS_OF, config.HALF_LIFE_DAYS))
    return _round(rows.select("match_id", "home_goals", "away_goals", "weight"), 9)


_SHARE_COLUMNS = ("missing_share", "missing_starter_share", "missing_xgchain_share", "n_missing", "n_prior")


@query("sides_by_match", f"WITH s AS ({ORACLE['availability_window']}) SELECT h.match_id, {', '.join(f'h.{c} AS {c}_home, a.{c} AS {c}_away' for c in _SHARE_COLUMNS)} FROM s AS h JOIN s AS a ON h.match_id = a.match_id AND h.is_home AND NOT a.is_home")
def sides_by_match(spark, d):
    return _round(availability.by_match(availability.features(availability.appearances(lens.read(spark, d, "lineups"), _matches(spark, d)))))


@query("lineup_coverage", f"""SELECT league, season_start_year, COUNT(DISTINCT m.match_id) AS matches, ROUND(AVG(started), 6) AS mean_started FROM {_M} AS m
  JOIN (SELECT match_id, is_home, COUNT(*) FILTER (started) AS started FROM ({lens.sql('lineups')}) AS l GROUP BY match_id, is_home) AS s ON s.match_id = m.match_id GROUP BY league, season_start_year""")
def lineup_coverage(spark, d):
    return _round(quality.lineup_coverage(_matches(spark, d), lens.read(spark, d, "lineups")))


# ---- counts -----------------------------------------------------------------------------------------------

def _side_pmf(name: str, mean: str) -> str:
    weight = "CAST(exp(lgamma(y + 8.0) - lgamma(8.0) - lgamma(y + 1.0) + 8.0 * ln(8.0 / (8.0 + mean)) + y * ln(mean / (8.0 + mean))) AS DOUBLE)"
    return f"{name} AS (SELECT match_id, y, u / SUM(u) OVER (PARTITION BY match_id) AS p FROM (SELECT match_id, y, {weight} AS u FROM (SELECT match_id, {mean} AS mean FROM ({lens.sql('rates')}) AS r) AS t CROSS JOIN (SELECT unnest(range(41)) AS y) AS k) AS n)"


_MARGINS = f"WITH {_side_pmf('hp', '2 * lam')}, {_side_pmf('ap', '2 * mu')}, d AS (SELECT match_id, hp.y - ap.y AS margin, SUM(hp.p * ap.p) AS p FROM hp JOIN ap USING (match_id) GROUP BY match_id, hp.y - ap.y)"
_CORNER_BETS = [("corner_handicap", s, x) for x in (-1.25, 0.5, 1.0) for s in ("home", "away")] + [("home_total_corners", "over", 4.0), ("away_total_corners", "under", 3.5), ("total_goals", "over", 2.5)]


def _count_means(spark, d):
    lam, mu, k = 2 * F.col("lam"), 2 * F.col("mu"), F.lit(8.0)
    return lens.read(spark, d, "rates").select("match_id", lam.alias("home_mean"), mu.alias("away_mean"), k.alias("dispersion"), k.alias("total_dispersion"))


@query("count_handicaps", _MARGINS + " " + " UNION ALL ".join(f"SELECT match_id, 'corner_handicap' AS market, '{s}' AS selection, CAST({own + 0.0} AS DOUBLE) AS line, ROUND(SUM(CASE WHEN {x} > 0 THEN p ELSE 0 END), 6) AS probability, ROUND(SUM(CASE WHEN {x} = 0 THEN p ELSE 0 END), 6) AS push_probability FROM d GROUP BY match_id" for line in (-1.5, 0.5) for s, own, x in (("home", line, f"margin + ({line})"), ("away", -line, f"-margin - ({line})"))))
def count_handicaps(spark, d):
    return _round(matrix.rated_counts(_count_means(spark, d), ["match_id"], "corners", handicaps=(-1.5, 0.5)))


def _offered_sql() -> str:
    parts = []
    for market, selection, line in _CORNER_BETS:
        head = f"match_id, '{market}' AS market, '{selection}' AS selection, CAST({line} AS DOUBLE) AS line"
        if market.endswith("handicap"):
            x = f"({'margin' if selection == 'home' else '-margin'} + ({line}))"
            legs = (-0.25, 0.25) if line * 2 != int(line * 2) else (0, 0)
            win, push = (" + ".join(f"CASE WHEN {x} + ({v}) {op} 0 THEN p ELSE 0 END" for v in legs) for op in (">", "="))
            parts.append(f"SELECT {head}, ROUND(SUM({win}) / 2, 6) AS probability, ROUND(SUM({push}) / 2, 6) AS push_probability FROM d GROUP BY match_id")
        elif market.endswith("corners"):
            op = ">" if selection == "over" else "<"
            parts.append(f"SELECT {head}, ROUND(SUM(CASE WHEN y {op} {line} THEN p ELSE 0 END), 6), ROUND(SUM(CASE WHEN y = {line} THEN p ELSE 0 END), 6) FROM {market[0]}p GROUP BY match_id")
        else:
            parts.append(f"SELECT {head}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT match_id FROM hp) AS x")
    return _MARGINS + " " + " UNION ALL ".join(parts)


@query("counts_offered", _offered_sql())
def counts_offered(spark, d):
    """Count markets at a book's own lines; what isn't a market of the count has no probability."""
    rows = _count_means(spark, d)
    offered = rows.select("match_id", F.inline(F.array(*[F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), F.lit(x).alias("line")) for m, s, x in _CORNER_BETS])))
    return _round(matrix.price_rated_counts(rows, offered, ["match_id"], "corners"))


@query("total_buckets", f"""WITH {_CELLS}, t AS (SELECT match_id, LEAST(h + a, 7) AS k, SUM(p) AS p FROM cells GROUP BY ALL), r AS (SELECT t.*, CASE WHEN LEAST(total_goals, 7) = k THEN 1 ELSE 0 END AS hit FROM t JOIN {_M} AS x ON x.match_id = t.match_id)
  SELECT total, observed, ROUND(expected, 6) AS expected, ROUND(se, 6) AS se, ROUND(observed - expected, 6) AS difference, ROUND(CASE WHEN se > 0 THEN (observed - expected) / se END, 6) AS z FROM (
    SELECT CASE WHEN k = 7 THEN '7+' ELSE CAST(k AS STRING) END AS total, CAST(SUM(hit) AS BIGINT) AS observed, SUM(p) AS expected, sqrt(SUM(p * (1 - p))) AS se FROM r GROUP BY k) AS q""")
def total_buckets(spark, d):
    pmf = matrix.totals(matrix.cells(lens.read(spark, d, "rates"), ["match_id"]), ["match_id"])
    rows = pmf.join(_matches(spark, d).select("match_id", F.col("total_goals").alias("observed_total")), "match_id")
    return _round(scoring.total_fit(rows)[1])


# ---- staking and the stream -----------------------------------------------------------------------------------

@query("kelly_staking", f"""WITH RECURSIVE b AS (SELECT league, ROW_NUMBER() OVER (PARTITION BY league ORDER BY date, match_id, market, selection, line NULLS FIRST) AS k,
    CAST(CASE WHEN model_probability * price_taken - 1 > 0 THEN LEAST(0.02, 0.25 * (model_probability * price_taken - 1) / (price_taken - 1)) ELSE 0 END AS DOUBLE) AS share,
    CAST(CASE WHEN win_fraction > 0.5 THEN price_taken - 1 WHEN push_fraction > 0 THEN (price_taken - 1) / 2 ELSE -1 END AS DOUBLE) AS profit FROM {_P} AS p WHERE expected_value >= 0.02 AND price_taken BETWEEN 1.2 AND 15),
  s AS (SELECT league, CAST(0 AS BIGINT) AS k, CAST(1000 AS DOUBLE) AS bank, CAST(1000 AS DOUBLE) AS peak, CAST(0 AS DOUBLE) AS down, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT league FROM b) AS x
    UNION ALL SELECT league, k, now, GREATEST(peak, now), LEAST(down, (now - GREATEST(peak, now)) / GREATEST(peak, now)), n + CASE WHEN share > 0 AND bank > 0 THEN 1 ELSE 0 END
    FROM (SELECT s.league, b.k, GREATEST(0.0, bank + bank * share * profit) AS now, peak, down, n, share, bank FROM s JOIN b ON b.league = s.league AND b.k = s.k + 1) AS y)
  SELECT league, n AS bets, ROUND(bank, 4) AS final_bankroll, ROUND(peak, 4) AS peak, ROUND(down, 4) AS max_drawdown, bank <= 0 AS busted FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY league ORDER BY k DESC) AS last FROM s) AS z WHERE last = 1""")
def kelly_staking(spark, d):
    return _round(scoring.kelly_ledger(_bets(spark, d)), 4)


@query("streamed_weeks", """SELECT strftime(CAST('1970-01-01' AS DATE) + CAST(7 * w AS INT), '%Y-%m-%d') AS start, fixture_key, pulls, ROUND(mean_price, 6) AS mean_price FROM (
  SELECT CAST(floor(epoch(ts) / 604800) AS BIGINT) AS w, 'f' || user_id AS fixture_key, COUNT(*) AS pulls, AVG(value) AS mean_price FROM events GROUP BY ALL) AS x""")
def streamed_weeks(spark, d):
    """The events as a stream, in weeks that begin on Thursdays in UTC, written to files batch by batch."""
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    pulls = source.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("fixture_key"), F.col("ts").alias("pulled_at"), F.col("value").alias("price"))
    out = stream.weekly_files(spark, pulls, stream.shared_folder(spark))
    return _round(out.withColumn("start", F.date_format("start", "yyyy-MM-dd")))


# ---- studies and readers ----------------------------------------------------------------------------------------

def _out_sql(doubtful: str = "") -> str:
    return f"""o AS (SELECT team, fixture_date, COUNT(DISTINCT player) AS out FROM {_I} AS i WHERE ruled_out{doubtful} GROUP BY ALL),
  j AS (SELECT t.match_id, t.is_home, arg_min(o.out, (abs(t.date - o.fixture_date), o.fixture_date)) AS out FROM {_TM} AS t JOIN o ON o.team = t.team AND abs(t.date - o.fixture_date) <= 1 GROUP BY t.match_id, t.is_home),
  b AS (SELECT m.match_id, m.league, h.out AS out_home, a.out AS out_away FROM {_M} AS m LEFT JOIN (SELECT * FROM j WHERE is_home) AS h ON h.match_id = m.match_id LEFT JOIN (SELECT * FROM j WHERE NOT is_home) AS a ON a.match_id = m.match_id)"""


@query("players_out", f"WITH {_out_sql(' OR doubtful')} SELECT match_id, out_home, out_away FROM b")
def players_out(spark, d):
    return research.players_out(_matches(spark, d), availability.out_counts(lens.read(spark, d, "injuries"), doubtful=True))


@query("injury_effects")
def injury_effects(spark, d):
    """All readings of the injury lists, with errors of 200 draws."""
    m = _matches(spark, d)
    totals = m.select("league", "match_id", F.col("home_goals").alias("observed_home"), F.col("away_goals").alias("observed_away"), F.lit(2.0).alias("lam"), F.lit(1.5).alias("mu"))
    return _round(research.injury_effects(totals, m, lens.read(spark, d, "injuries"), least=0.0), 4)


@query("pooled_slopes", f"""SELECT league, 'own' AS effect, COUNT(*) AS leagues, ROUND(SUM(mean / (se * se)) / SUM(1 / (se * se)), 6) AS estimate, ROUND(sqrt(1 / SUM(1 / (se * se))), 6) AS se, ROUND(SUM(mean / (se * se)) / SUM(1 / (se * se)) * sqrt(SUM(1 / (se * se))), 6) AS z, COUNT(*) FILTER (mean < 0) AS agreeing
  FROM ({ORACLE['evidence'].replace('ROUND(mean, 4) AS mean_clv, ROUND(se, 4) AS clv_se', 'mean, se')}) AS e WHERE se > 0 GROUP BY league""")
def pooled_slopes(spark, d):
    """The pooling of effects, on the closing-line value of each league's markets."""
    rows = scoring.evidence(lens.read(spark, d, "predictions")).select("league", F.col("mean_clv").alias("own"), F.col("clv_se").alias("own_se"), F.lit(None).cast("double").alias("opp"), F.lit(None).cast("double").alias("opp_se"))
    return _round(research.pooled_effects(rows, ["league"]))


@query("shrinkage")
def shrinkage(spark, d):
    return _round(research.shrinkage_report(_matches(spark, d), AS_OF, config.HALF_LIFE_DAYS, target="goals")[0], 4)


@query("goals_fit_pooled")
def goals_fit_pooled(spark, d):
    return _round(fits.fit_goals_pooled(teams.training_rows(_matches(spark, d), AS_OF, config.HALF_LIFE_DAYS), target="goals").drop("ratings"), 4)


@query("referees")
def referees(spark, d):
    rows = teams.training_rows(_matches(spark, d), AS_OF, config.HALF_LIFE_DAYS)
    return _round(fits.referee_table(fits.fit_counts(rows, ["league"], "cards"), ["league"]), 4)


@query("calibration_records")
def calibration_records(spark, d):
    """All markets that are checked against results, over all dates, with a fit every half-year."""
    m = _matches(spark, d)
    w = replace(_whole_walk(m), step_days=182, halves=True, counted=("corners", "cards"))
    return _round(scoring.market_scores(walk.predictions(m, None, w)), 4)


@query("settings_grid")
def settings_grid(spark, d):
    """Two half-lives and two books for the fair line, over all dates, with a fit every year."""
    m = _matches(spark, d)
    w = replace(_whole_walk(m), step_days=364, target="goals", calibrate=False)
    return _round(walk.grid(m, lens.read(spark, d, "odds"), w, [{"half_life": 180.0}, {"half_life": 720.0}, {"half_life": 720.0, "preference": ("pinnacle",), "fallback": False}]), 4)


@query("unplayed_latest", f"""SELECT content_hash, fixture_key, league FROM (SELECT content_hash, 'f' || user_id AS fixture_key, league, ROW_NUMBER() OVER (PARTITION BY fixture_key ORDER BY pulled_at DESC, content_hash DESC) AS k FROM
  (SELECT *, substr(fixture_key, 2) AS user_id FROM {_PULLS} AS p WHERE league IN ('L1', 'L3')) AS q) AS x WHERE k = 1""")
def unplayed_latest(spark, d):
    return archive.sighted(_snapshots(spark, d), ["L1", "L3"], unplayed_only=True, latest_only=True).select("content_hash", "fixture_key", "league")


@query("snapshot_prices", f"SELECT match_id AS content_hash, COUNT(*) AS prices FROM {_O} AS o WHERE match_id IN (SELECT match_id FROM {_M} AS m WHERE league = 'L2') GROUP BY match_id")
def snapshot_prices(spark, d):
    odds = lens.read(spark, d, "odds").withColumnRenamed("match_id", "content_hash")
    mine = archive.sighted(_matches(spark, d).withColumnRenamed("match_id", "content_hash"), ["L2"])
    return archive.odds_of(odds, mine).groupBy("content_hash").agg(F.count("*").alias("prices"))
