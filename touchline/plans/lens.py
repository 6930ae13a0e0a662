"""Football-shaped tables derived from the driver's star schema by whole-number arithmetic.

The SQL is valid in Spark and in the reference database of the correctness check alike, so both engines see
the same rows. Goals are not Poisson here: the lens serves parity of operators, not statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCHES = """
SELECT CAST(k AS STRING) AS match_id, CONCAT('L', CAST(cu % 5 AS STRING)) AS league, d AS date,
  YEAR(d) - CASE WHEN MONTH(d) < 8 THEN 1 ELSE 0 END AS season_start_year,
  CONCAT('L', CAST(cu % 5 AS STRING), '-T', CAST(h AS STRING)) AS home_team, CONCAT('L', CAST(cu % 5 AS STRING), '-T', CAST((h + 1 + k % 19) % 20 AS STRING)) AS away_team,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CONCAT('R', CAST(c % 17 AS STRING)) END AS referee,
  hg AS home_goals, ag AS away_goals, CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS result,
  LEAST(hg, c % 3) AS home_goals_ht, LEAST(ag, c % 2) AS away_goals_ht,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 5 + c % 13 END AS home_shots, CASE WHEN k % 7 = 0 THEN NULL ELSE 4 + c % 11 END AS away_shots,
  CASE WHEN k % 7 = 0 THEN NULL ELSE c % 7 END AS home_sot, CASE WHEN k % 7 = 0 THEN NULL ELSE c % 6 END AS away_sot,
  CASE WHEN k % 7 = 1 THEN NULL ELSE c % 11 END AS home_corners, CASE WHEN k % 7 = 1 THEN NULL ELSE c % 83 % 10 END AS away_corners,
  CASE WHEN k % 7 = 2 THEN NULL ELSE 8 + c % 9 END AS home_fouls, CASE WHEN k % 7 = 2 THEN NULL ELSE 7 + c % 8 END AS away_fouls,
  CASE WHEN k % 5 = 0 THEN NULL ELSE c % 71 % 5 END AS home_yellows, CASE WHEN k % 5 = 0 THEN NULL ELSE c % 67 % 4 END AS away_yellows,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CASE WHEN c % 61 = 0 THEN 1 ELSE 0 END END AS home_reds, CASE WHEN k % 5 = 0 THEN NULL ELSE CASE WHEN c % 59 = 0 THEN 1 ELSE 0 END END AS away_reds,
  hg + ag AS total_goals, hg - ag AS goal_difference, hg > 0 AND ag > 0 AS btts, hg + ag > 1 AS over_1_5, hg + ag > 2 AS over_2_5, hg + ag > 3 AS over_3_5,
  LEAST(hg, c % 3) + LEAST(ag, c % 2) AS goals_ht, hg + ag - LEAST(hg, c % 3) - LEAST(ag, c % 2) AS goals_2h,
  CASE WHEN k % 7 = 1 THEN NULL ELSE c % 11 + c % 83 % 10 END AS total_corners,
  CASE WHEN k % 5 = 0 THEN NULL ELSE c % 71 % 5 + c % 67 % 4 + CASE WHEN c % 61 = 0 THEN 1 ELSE 0 END + CASE WHEN c % 59 = 0 THEN 1 ELSE 0 END END AS total_cards
FROM (
  SELECT o_orderkey AS k, o_custkey AS cu, CAST(o_orderdate AS DATE) AS d, CAST(FLOOR(o_totalprice * 100) AS BIGINT) AS c, CAST(FLOOR(o_custkey / 5) AS BIGINT) % 20 AS h,
    CAST(FLOOR(o_totalprice * 100) AS BIGINT) % 97 % 5 AS hg, CAST(FLOOR(o_totalprice * 100) AS BIGINT) % 89 % 4 AS ag
  FROM {orders}
) AS numbers
"""

ODDS = """
SELECT m.match_id, b.bookmaker, b.phase, s.market, s.selection, CAST(s.line AS DOUBLE) AS line,
  FLOOR(1000000 / ((100 + b.margin) * (s.w + s.tilt * CAST(m.home_goals * 3 % 10 AS INT))) + CAST(m.match_id AS BIGINT) % 7) / 100 AS price
FROM ({matches}) AS m
CROSS JOIN (VALUES ('market_max', 'open', 2), ('bet365', 'open', 6), ('market_avg', 'open', 5), ('pinnacle', 'close', 3), ('betfair_exchange', 'close', 1), ('bet365', 'close', 6), ('market_avg', 'close', 4)) AS b(bookmaker, phase, margin)
CROSS JOIN (VALUES ('1x2', 'home', NULL, 40, 1), ('1x2', 'draw', NULL, 26, 0), ('1x2', 'away', NULL, 34, -1), ('total_goals', 'over', 2.5, 52, 0), ('total_goals', 'under', 2.5, 48, 0),
  ('asian_handicap', 'home', -0.25, 51, 0), ('asian_handicap', 'away', 0.25, 49, 0)) AS s(market, selection, line, w, tilt)
WHERE NOT (b.bookmaker = 'betfair_exchange' AND CAST(m.match_id AS BIGINT) % 3 = 0)
  AND NOT (b.phase = 'close' AND s.market = 'total_goals' AND CAST(m.match_id AS BIGINT) % 4 = 0)
"""

#: Predictions whose probabilities are ratios of whole numbers.
PREDICTIONS = """
SELECT m.match_id, m.league, m.date, s.market, s.selection, CAST(s.line AS DOUBLE) AS line, CAST(m.match_id AS BIGINT) % 2 = 0 AS priceless,
  (5 + (CAST(m.match_id AS BIGINT) * s.f) % 89) / 100 AS model_probability, (5 + (CAST(m.match_id AS BIGINT) * s.f) % 89) / 100 AS model_conditional,
  CASE WHEN CAST(m.match_id AS BIGINT) % 2 = 0 THEN NULL ELSE (8 + (CAST(m.match_id AS BIGINT) * s.f + 7 * m.home_goals) % 83) / 100 END AS market_probability,
  CASE WHEN CAST(m.match_id AS BIGINT) % 2 = 0 THEN NULL WHEN YEAR(m.date) < 1998 THEN 'pinnacle' ELSE 'betfair_exchange' END AS fair_line_source,
  CASE WHEN (m.home_goals * 7 + m.away_goals * 3 + s.f) % 5 < 2 THEN 1.0 WHEN (m.home_goals + s.f) % 7 = 0 THEN 0.5 ELSE 0.0 END AS win_fraction,
  CASE WHEN (m.home_goals * 7 + m.away_goals * 3 + s.f) % 5 >= 2 AND (m.home_goals + s.f) % 7 = 0 THEN 0.5 ELSE 0.0 END AS push_fraction,
  CASE WHEN CAST(m.match_id AS BIGINT) % 2 = 0 THEN NULL ELSE (CAST(m.match_id AS BIGINT) * s.f % 41 - 20) / 100 END AS expected_value,
  CASE WHEN CAST(m.match_id AS BIGINT) % 2 = 0 OR CAST(m.match_id AS BIGINT) % 9 = 1 THEN NULL ELSE (CAST(m.match_id AS BIGINT) * s.f % 37 - 19) / 100 END AS clv,
  CASE WHEN CAST(m.match_id AS BIGINT) % 3 = 0 THEN NULL ELSE (CAST(m.match_id AS BIGINT) % 31 - 15) / 100 END AS price_movement,
  CASE WHEN CAST(m.match_id AS BIGINT) % 2 = 0 THEN NULL ELSE (110 + CAST(m.match_id AS BIGINT) * s.f % 400) / 100 END AS price_taken
FROM ({matches}) AS m
CROSS JOIN (VALUES ('1x2', 'home', NULL, 3), ('total_goals', 'over', 2.5, 7), ('asian_handicap', 'home', -0.25, 11)) AS s(market, selection, line, f)
"""

#: Line items as appearances: the order is the match, the supplier the player.
LINEUPS = """
SELECT DISTINCT CAST(l_orderkey AS STRING) AS match_id, l_linenumber % 2 = 0 AS is_home, CAST(l_suppkey % 40 AS STRING) AS player_id,
  10 + MAX(CAST(l_quantity AS INT)) % 81 AS minutes, MAX(CAST(l_quantity AS INT)) % 3 > 0 AS started, CAST(MAX(CAST(l_quantity AS INT)) % 7 AS DOUBLE) AS xgchain
FROM {lineitem} GROUP BY l_orderkey, l_linenumber % 2 = 0, l_suppkey % 40
"""

#: Parts of orders as injury reports.
INJURIES = """
SELECT CONCAT('L', CAST(l_suppkey % 5 AS STRING), '-T', CAST(l_partkey % 20 AS STRING)) AS team, CAST(l_suppkey % 23 AS STRING) AS player,
  l_returnflag = 'R' AS ruled_out, l_returnflag = 'A' AS doubtful, CAST(l_shipdate AS DATE) AS fixture_date
FROM {lineitem}
"""

#: Events as pulled prices.
PULLS = """
SELECT CONCAT('h', CAST(user_id AS STRING), '-', CAST(CAST(FLOOR(value) AS BIGINT) % 5 AS STRING)) AS content_hash, CONCAT('f', CAST(user_id AS STRING)) AS fixture_key,
  CONCAT('L', CAST(user_id % 5 AS STRING)) AS league, CAST(ts AS DATE) AS fixture_date, ts AS pulled_at, value AS price, event_id
FROM {events}
"""

#: Rates of scoring for the score matrix, of every match.
RATES = """
SELECT CAST(o_orderkey AS STRING) AS match_id, 0.5 + (o_custkey % 20) / 10 AS lam, 0.4 + (o_orderkey % 17) / 10 AS mu, -0.05 AS rho FROM {orders}
"""

_NESTED = {"ODDS", "PREDICTIONS"}


def sql(name: str) -> str:
    """The lens as SQL over the driver's tables by their names."""
    text = globals()[name.upper()]
    if name.upper() in _NESTED:
        text = text.replace("{matches}", MATCHES)
    return text.replace("{orders}", "orders").replace("{lineitem}", "lineitem").replace("{events}", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The lens as a DataFrame over the parquet tables."""
    text = globals()[name.upper()]
    if name.upper() in _NESTED:
        text = text.replace("{matches}", MATCHES)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "events") if "{" + t + "}" in text}
    out = spark.sql(text, **tables)
    for c, kind in out.dtypes:  # decimals of literals are doubles in both engines' results
        if kind.startswith("decimal"):
            out = out.withColumn(c, out[c].cast("double"))
    return out
