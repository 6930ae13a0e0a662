"""Registered queries over the lens, each beside the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import dates, names, pricing, settlement
from ..operators import archive, availability, fair, fits, matrix, profile, quality, scoring, teams
from . import lens, predict, research, scan, walk

AS_OF, SEASON = "1999-03-01", 1998
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_M, _O, _P = f"({lens.sql('matches')})", f"({lens.sql('odds')})", f"({lens.sql('predictions')})"
_SIDES = ("goals", "goals_ht", "shots", "sot", "corners", "fouls", "yellows", "reds")
_ONE = ("match_id", "league", "season_start_year", "date", "referee", "total_goals", "btts", "over_1_5", "over_2_5", "over_3_5", "goals_ht", "goals_2h", "total_corners", "total_cards")


def _side(us: str, them: str) -> str:
    cols = ", ".join([*_ONE, f"{us}_team AS team", f"{them}_team AS opponent", f"{'TRUE' if us == 'home' else 'FALSE'} AS is_home", *[f"{us}_{c} AS {c}_for, {them}_{c} AS {c}_against" for c in _SIDES]])
    return f"SELECT {cols} FROM {_M}"


_TM = f"""(SELECT *, CASE WHEN goals_for > goals_against THEN 'W' WHEN goals_for < goals_against THEN 'L' ELSE 'D' END AS outcome,
  CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for < goals_against THEN 0 ELSE 1 END AS points, yellows_for + reds_for AS cards_for,
  goals_against = 0 AS clean_sheet, goals_for = 0 AS failed_to_score FROM ({_side('home', 'away')} UNION ALL {_side('away', 'home')}) AS s)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at so many decimals, zero without a sign, whole numbers as long."""
    out = {}
    for c, kind in df.dtypes:
        if kind == "double":
            out[c] = F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            out[c] = F.col(f"`{c}`").cast("bigint")
    return df.withColumns(out) if out else df


def _matches(spark, d) -> DataFrame:
    return lens.read(spark, d, "matches")


def _whole_walk(matches: DataFrame) -> walk.Walk:
    """A walk from the first to the last date of matches; without any, over no date."""
    first, last = matches.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    return walk.Walk(first or "0001-01-01", last or "0001-01-01")


def _metric_sql(source: str, keys: str, scopes: dict[str, str]) -> str:
    parts = []
    for scope, within in scopes.items():
        for m in profile.METRICS:
            x = f"CASE WHEN {within} THEN CAST({'CAST(' + m + ' AS INT)' if m in profile.RATES else m} AS DOUBLE) END"
            parts.append(f"SELECT {keys}, '{scope}' AS scope, '{m}' AS metric, ROUND(AVG({x}), 6) AS value, COUNT({x}) AS n FROM rows GROUP BY {keys}")
    return f"WITH rows AS ({source}) " + " UNION ALL ".join(parts)


@query("team_metrics_asof", _metric_sql(f"SELECT * FROM {_TM} AS t WHERE date < DATE '{AS_OF}'", "league, team", {"all": "TRUE"}))
def team_metrics_asof(spark, d):
    return _round(profile.metrics(teams.before(teams.team_matches(_matches(spark, d)), AS_OF), ["league", "team"]))


@query("team_matches", f"SELECT match_id, league, date, team, opponent, is_home, goals_for, goals_against, outcome, CAST(points AS BIGINT) AS points, cards_for, clean_sheet, failed_to_score FROM {_TM} AS t")
def team_matches(spark, d):
    return _round(teams.team_matches(_matches(spark, d)).select("match_id", "league", "date", "team", "opponent", "is_home", "goals_for", "goals_against", "outcome", "points", "cards_for", "clean_sheet", "failed_to_score"))


@query("league_table", f"""SELECT league, team, COUNT(*) AS played, COUNT(*) FILTER (outcome = 'W') AS won, COUNT(*) FILTER (outcome = 'D') AS drawn, COUNT(*) FILTER (outcome = 'L') AS lost,
  CAST(SUM(goals_for) AS BIGINT) AS goals_for, CAST(SUM(goals_against) AS BIGINT) AS goals_against, CAST(SUM(points) AS BIGINT) AS points FROM {_TM} AS t WHERE date < DATE '{AS_OF}' AND season_start_year = {SEASON} GROUP BY league, team""")
def league_table(spark, d):
    return _round(profile.league_table(teams.team_matches(_matches(spark, d)), AS_OF, SEASON))


@query("scoped_stats", _metric_sql(f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC) AS k, ROW_NUMBER() OVER (PARTITION BY team, is_home ORDER BY date DESC, match_id DESC) AS kv
  FROM {_TM} AS t WHERE date < DATE '{AS_OF}'""", "team", {"season": f"season_start_year = {SEASON}", "season_venue": f"season_start_year = {SEASON} AND is_home", "last6": "k <= 6", "last6_venue": "is_home AND kv <= 6"}))
def scoped_stats(spark, d):
    return _round(profile.scoped(teams.team_matches(_matches(spark, d)), AS_OF, SEASON, True))


@query("league_baseline", _metric_sql(f"SELECT * FROM {_TM} AS t WHERE date < DATE '{AS_OF}'", "league, season_start_year", {"all": "TRUE"}))
def league_baseline(spark, d):
    return _round(profile.metrics(teams.before(teams.team_matches(_matches(spark, d)), AS_OF), ["league", "season_start_year"]))


@query("rolling_form", f"""SELECT match_id, team, is_home, COUNT(points) OVER w AS form_n, ROUND(AVG(points) OVER w, 6) AS form_points, ROUND(AVG(goals_for) OVER w, 6) AS form_goals_for, ROUND(AVG(goals_against) OVER w, 6) AS form_goals_against
  FROM {_TM} AS t WINDOW w AS (PARTITION BY team ORDER BY date, match_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def rolling_form(spark, d):
    rows = teams.team_matches(_matches(spark, d)).select("match_id", "team", "is_home", "date", "points", "goals_for", "goals_against")
    return _round(profile.rolling_form(rows).select("match_id", "team", "is_home", "form_n", "form_points", "form_goals_for", "form_goals_against"))


@query("form_last6", f"""SELECT team, STRING_AGG(CAST(date AS STRING) || ':' || opponent || ':' || venue || ':' || score || ':' || outcome, ',' ORDER BY k) AS form FROM (
  SELECT team, date, opponent, CASE WHEN is_home THEN 'H' ELSE 'A' END AS venue, CAST(goals_for AS STRING) || '-' || CAST(goals_against AS STRING) AS score, outcome,
  ROW_NUMBER() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC) AS k FROM {_TM} AS t WHERE date < DATE '{AS_OF}') AS r WHERE k <= 6 GROUP BY team""")
def form_last6(spark, d):
    form = profile.form_lines(teams.team_matches(_matches(spark, d)), AS_OF)
    return form.select("team", F.array_join(F.transform("form", lambda x: F.concat_ws(":", x["date"].cast("string"), x["opponent"], x["venue"], x["score"], x["outcome"])), ",").alias("form"))


@query("rest_days", f"SELECT team, DATE '{AS_OF}' - MAX(date) AS rest_days, COUNT(*) FILTER (date > DATE '{AS_OF}' - 14) AS matches_last_14_days FROM {_TM} AS t WHERE date < DATE '{AS_OF}' GROUP BY team")
def rest_days(spark, d):
    return _round(profile.rest(teams.team_matches(_matches(spark, d)), AS_OF))


@query("head_to_head", f"""WITH r AS (SELECT *, LEAST(home_team, away_team) AS first, GREATEST(home_team, away_team) AS second FROM {_M} AS m WHERE date < DATE '{AS_OF}'),
  k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY first, second ORDER BY date DESC, match_id DESC) AS k, CASE WHEN home_team = first THEN home_goals - away_goals ELSE away_goals - home_goals END AS margin FROM r)
  SELECT first, second, COUNT(*) AS n, COUNT(*) FILTER (margin > 0) AS first_wins, COUNT(*) FILTER (margin = 0) AS draws, COUNT(*) FILTER (margin < 0) AS second_wins,
  ROUND(AVG(total_goals), 6) AS avg_total_goals, ROUND(AVG(CAST(btts AS INT)), 6) AS btts_rate FROM k WHERE k <= 10 GROUP BY first, second""")
def head_to_head(spark, d):
    return _round(profile.meetings(_matches(spark, d), AS_OF))


@query("infer_league", f"SELECT MAX_BY(league, date || '|' || LPAD(match_id, 12, '0')) AS league FROM {_M} AS m WHERE date < DATE '{AS_OF}' AND (home_team IN ('L1-T3', 'L1-T4') OR away_team IN ('L1-T3', 'L1-T4'))")
def infer_league(spark, d):
    return teams.latest_league(_matches(spark, d), ["L1-T3", "L1-T4"], AS_OF)


@query("known_teams", f"SELECT DISTINCT team FROM {_TM} AS t WHERE league = 'L2' AND season_start_year = {SEASON}")
def known_teams(spark, d):
    return teams.known_teams(_matches(spark, d), "L2", SEASON)


@query("contents", f"SELECT league, season_start_year, COUNT(*) AS matches, MIN(date) AS first_date, MAX(date) AS last_date FROM {_M} AS m GROUP BY league, season_start_year")
def contents(spark, d):
    return _round(quality.contents(_matches(spark, d)))


_COVERED = [c for c in quality.COVERED if c != "attendance"]


@query("coverage", f"SELECT league, season_start_year, COUNT(*) AS matches, {', '.join(f'ROUND(100 * COUNT({c}) / NULLIF(COUNT(*), 0), 1) AS {c}_pct' for c in _COVERED)} FROM {_M} AS m GROUP BY league, season_start_year")
def coverage(spark, d):
    return _round(quality.coverage(_matches(spark, d)))


@query("odds_coverage", f"SELECT bookmaker, phase, market, COUNT(DISTINCT o.match_id) AS matches, MIN(season_start_year) AS first_season, MAX(season_start_year) AS last_season FROM {_O} AS o JOIN {_M} AS m ON o.match_id = m.match_id GROUP BY bookmaker, phase, market")
def odds_coverage(spark, d):
    return _round(quality.odds_coverage(lens.read(spark, d, "odds"), _matches(spark, d)))


@query("integrity", f"""WITH m AS {_M}, o AS {_O}
  SELECT 'self_play' AS "check", COUNT(*) FILTER (home_team = away_team) AS failures FROM m
  UNION ALL SELECT 'negative_count', COUNT(*) FILTER (home_goals < 0 OR away_goals < 0 OR home_shots < 0 OR away_shots < 0 OR home_corners < 0 OR away_corners < 0 OR home_yellows < 0 OR away_yellows < 0 OR home_reds < 0 OR away_reds < 0) FROM m
  UNION ALL SELECT 'implausible_goals', COUNT(*) FILTER (home_goals > 15 OR away_goals > 15) FROM m
  UNION ALL SELECT 'implausible_corners', COUNT(*) FILTER (home_corners > 30 OR away_corners > 30) FROM m
  UNION ALL SELECT 'half_over_full', COUNT(*) FILTER (home_goals_ht > home_goals OR away_goals_ht > away_goals) FROM m
  UNION ALL SELECT 'result_not_score', COUNT(*) FILTER (result <> CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END) FROM m
  UNION ALL SELECT 'future_match', COUNT(*) FILTER (date > DATE '2001-01-01') FROM m
  UNION ALL SELECT 'duplicate_id', COUNT(*) FROM (SELECT match_id FROM m GROUP BY match_id HAVING COUNT(*) > 1) AS x
  UNION ALL SELECT 'duplicate_fixture', COUNT(*) FROM (SELECT 1 FROM m GROUP BY league, date, home_team, away_team HAVING COUNT(*) > 1) AS x
  UNION ALL SELECT 'price_not_over_one', COUNT(*) FILTER (price <= 1) FROM o
  UNION ALL SELECT 'orphan_odds', COUNT(*) FROM o WHERE match_id NOT IN (SELECT match_id FROM m)""")
def integrity(spark, d):
    return quality.integrity(_matches(spark, d), lens.read(spark, d, "odds"), "2001-01-01")


_OVER = f"SELECT match_id, bookmaker, phase, SUM(1 / price) AS overround FROM {_O} AS o WHERE market = '1x2' GROUP BY match_id, bookmaker, phase HAVING COUNT(*) = 3"


@query("overround", f"SELECT match_id, bookmaker, phase, ROUND(overround, 6) AS overround FROM ({_OVER}) AS x")
def overround(spark, d):
    return _round(quality.overrounds(lens.read(spark, d, "odds")))


@query("overround_sample", f"SELECT match_id, bookmaker, phase, ROUND(overround, 6) AS overround FROM ({_OVER}) AS x ORDER BY md5(match_id || '|' || bookmaker || '|' || phase) LIMIT 5")
def overround_sample(spark, d):
    return _round(quality.overround_sample(lens.read(spark, d, "odds")))


@query("market_margins", f"SELECT bookmaker, phase, COUNT(*) AS markets, ROUND(AVG(overround), 6) AS mean_overround FROM ({_OVER}) AS x GROUP BY bookmaker, phase HAVING COUNT(*) >= 50")
def market_margins(spark, d):
    return _round(quality.market_margins(lens.read(spark, d, "odds")))


@query("card_conditions", f"""SELECT *, ROUND(with_referee / matches, 6) AS referee_share, ROUND(with_cards / matches, 6) AS card_share,
  CASE WHEN with_cards = 0 THEN 'no cards recorded' WHEN with_referee / matches < 0.5 THEN 'referees mostly unknown' WHEN with_cards / matches < 0.9 THEN 'cards partly unknown' END AS note
  FROM (SELECT league, COUNT(*) AS matches, COUNT(referee) AS with_referee, COUNT(home_yellows) AS with_cards FROM {_M} AS m GROUP BY league) AS x""")
def card_conditions(spark, d):
    return _round(quality.card_conditions(_matches(spark, d)))


@query("referee_groups", f"SELECT match_id, COALESCE(CASE WHEN COUNT(*) OVER (PARTITION BY referee) >= 900 THEN referee END, '(other)') AS referee_group FROM {_M} AS m")
def referee_groups(spark, d):
    return quality.referees(_matches(spark, d), 900)


@query("fingerprint", f"SELECT league, COUNT(*) AS matches, MAX(date) AS last_date FROM {_M} AS m GROUP BY league")
def fingerprint(spark, d):
    return quality.fingerprint(_matches(spark, d))


@query("training_weights", f"""SELECT match_id, ROUND(POW(0.5, GREATEST(DATE '{AS_OF}' - date, 0) / 180.0), 9) AS weight, CASE WHEN home_yellows IS NOT NULL THEN home_yellows + COALESCE(home_reds, 0) END AS home_cards
  FROM {_M} AS m WHERE date < DATE '{AS_OF}'""")
def training_weights(spark, d):
    rows = teams.training_rows(_matches(spark, d), AS_OF, config.HALF_LIFE_DAYS)
    return _round(rows.select("match_id", "weight", "home_cards"), 9)


@query("team_counts", f"SELECT team, COUNT(*) AS matches, ROUND(SUM(POW(0.5, GREATEST(DATE '{AS_OF}' - date, 0) / 180.0)), 6) AS effective FROM {_TM} AS t WHERE date < DATE '{AS_OF}' GROUP BY team")
def team_counts(spark, d):
    return _round(teams.counts(teams.training_rows(_matches(spark, d), AS_OF, config.HALF_LIFE_DAYS)))


@query("match_ids", f"""WITH s AS (SELECT match_id AS source_id, league || '_' || strftime(date, '%Y%m%d') || '_' || trim(regexp_replace(lower(home_team), '[^a-z0-9]+', '_', 'g'), '_') || '_' || trim(regexp_replace(lower(away_team), '[^a-z0-9]+', '_', 'g'), '_') AS stem FROM {_M} AS m)
  SELECT source_id, stem || '_' || substr(md5(stem), 1, 6) AS match_id FROM s""")
def match_ids(spark, d):
    return _matches(spark, d).select(F.col("match_id").alias("source_id"), names.match_id(F.col("league"), F.col("date"), F.col("home_team"), F.col("away_team")).alias("match_id"))


@query("collection_windows", f"""SELECT match_id, CASE WHEN w IN (4, 5, 6, 0) THEN 'weekend' ELSE 'midweek' END AS window_name, CAST(date - CAST(CASE WHEN w IN (4, 5, 6, 0) THEN (w + 3) % 7 ELSE w - 1 END AS INT) AS DATE) AS collected_on
  FROM (SELECT match_id, date, (isodow(date) - 1) AS w FROM {_M} AS m) AS x""")
def collection_windows(spark, d):
    w = dates.collection_window(F.col("date"))
    return _matches(spark, d).select("match_id", w["window"].alias("window_name"), F.to_date(F.from_utc_timestamp(w["collected_at"], "Europe/London")).alias("collected_on"))


@query("seasons_of_dates", f"SELECT match_id, season_start_year AS start_year, season_start_year || '/' || LPAD(CAST((season_start_year + 1) % 100 AS STRING), 2, '0') AS label FROM {_M} AS m")
def seasons_of_dates(spark, d):
    y = dates.season_start(F.col("date"))
    return _matches(spark, d).select("match_id", y.cast("bigint").alias("start_year"), dates.season_label(y).alias("label"))


@query("entity_names", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, trim(regexp_replace(translate(lower(s_name), '''.', ''), '\\s+', ' ', 'g')) AS alias_key FROM supplier")
def entity_names(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", names.slug(F.col("s_name")).alias("slug"), names.alias_key(F.col("s_name")).alias("alias_key"))


# ---- odds -------------------------------------------------------------------------------------------------

_FAIR_LEGS = f"""legs AS (
  SELECT match_id, market, CASE WHEN market = 'asian_handicap' AND selection = 'away' THEN -line ELSE line END AS group_line, phase, bookmaker, selection, line, price FROM {_O} AS o),
books AS (SELECT match_id, market, group_line, phase, bookmaker FROM legs GROUP BY ALL HAVING COUNT(*) = CASE WHEN market = '1x2' THEN 3 ELSE 2 END),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, market, group_line ORDER BY CASE WHEN phase = 'close' THEN 0 ELSE 1 END,
  CASE bookmaker WHEN 'betfair_exchange' THEN 1 WHEN 'pinnacle' THEN 2 WHEN 'market_avg' THEN 3 WHEN 'market_max' THEN 4 WHEN 'bet365' THEN 5 ELSE 6 END, bookmaker) AS k FROM books),
best AS (SELECT l.match_id, l.market, l.selection, l.line, l.price, l.bookmaker, l.group_line FROM legs l JOIN ranked r ON r.k = 1 AND l.match_id = r.match_id AND l.market = r.market AND l.group_line IS NOT DISTINCT FROM r.group_line AND l.phase = r.phase AND l.bookmaker = r.bookmaker)"""


@query("fair_mult", f"WITH {_FAIR_LEGS} SELECT match_id, market, selection, line, ROUND(1 / price / SUM(1 / price) OVER (PARTITION BY match_id, market, group_line), 6) AS market_probability, bookmaker AS fair_line_source FROM best")
def fair_mult(spark, d):
    return _round(fair.fair_probabilities(lens.read(spark, d, "odds"), "multiplicative").select("match_id", "market", "selection", "line", "market_probability", "fair_line_source"))


@query("fair_additive", f"""WITH {_FAIR_LEGS}, a AS (SELECT *, 1 / price - (SUM(1 / price) OVER w - 1) / COUNT(*) OVER w AS p, 1 / price / SUM(1 / price) OVER w AS m FROM best WINDOW w AS (PARTITION BY match_id, market, group_line))
  SELECT match_id, market, selection, line, ROUND(CASE WHEN MIN(p) OVER (PARTITION BY match_id, market, group_line) <= 0 THEN m ELSE p END, 6) AS market_probability, bookmaker AS fair_line_source FROM a""")
def fair_additive(spark, d):
    return _round(fair.fair_probabilities(lens.read(spark, d, "odds"), "additive").select("match_id", "market", "selection", "line", "market_probability", "fair_line_source"))


@query("fair_shin", f"""WITH RECURSIVE {_FAIR_LEGS},
  vectors AS (SELECT match_id, market, group_line, list(price ORDER BY selection) AS v FROM best GROUP BY ALL), each AS (SELECT DISTINCT v FROM vectors),
  q AS (SELECT v, list_transform(v, lambda p: 1 / p) AS q, list_sum(list_transform(v, lambda p: 1 / p)) AS s FROM each),
  solve AS (SELECT v, q, s, 0 AS k, CAST(1e-12 AS DOUBLE) AS low, CAST(0.4 AS DOUBLE) AS high FROM q
    UNION ALL SELECT v, q, s, k + 1, CASE WHEN over THEN mid ELSE low END, CASE WHEN over THEN high ELSE mid END FROM (
      SELECT *, (low + high) / 2 AS mid, list_sum(list_transform(q, lambda x: (sqrt(((low + high) / 2) * ((low + high) / 2) + 4 * (1 - (low + high) / 2) * x * x / s) - (low + high) / 2) / (2 * (1 - (low + high) / 2)))) > 1 AS over FROM solve WHERE k < 60) AS t),
  z AS (SELECT v, q, s, (low + high) / 2 AS z FROM solve WHERE k = 60),
  raw AS (SELECT v, list_transform(q, lambda x: CASE WHEN s <= 1 THEN x ELSE (sqrt(z * z + 4 * (1 - z) * x * x / s) - z) / (2 * (1 - z)) END) AS r FROM z)
  SELECT b.match_id, b.market, b.selection, b.line, ROUND(raw.r[list_position(vv.sel, b.selection)] / list_sum(raw.r), 6) AS market_probability, b.bookmaker AS fair_line_source
  FROM best b JOIN (SELECT match_id, market, group_line, list(price ORDER BY selection) AS v, list(selection ORDER BY selection) AS sel FROM best GROUP BY ALL) AS vv
    ON b.match_id = vv.match_id AND b.market = vv.market AND b.group_line IS NOT DISTINCT FROM vv.group_line JOIN raw ON raw.v = vv.v""")
def fair_shin(spark, d):
    return _round(fair.fair_probabilities(lens.read(spark, d, "odds"), "shin").select("match_id", "market", "selection", "line", "market_probability", "fair_line_source"))


_CHOSEN = f"""SELECT match_id, market, selection, line,
  arg_min(price, CASE bookmaker WHEN 'market_max' THEN 1 WHEN 'bet365' THEN 2 WHEN 'market_avg' THEN 3 END) FILTER (phase = 'open') AS price_taken,
  arg_min(bookmaker, CASE bookmaker WHEN 'market_max' THEN 1 WHEN 'bet365' THEN 2 WHEN 'market_avg' THEN 3 END) FILTER (phase = 'open') AS price_source,
  arg_min(price, CASE bookmaker WHEN 'betfair_exchange' THEN 1 WHEN 'pinnacle' THEN 2 WHEN 'market_avg' THEN 3 WHEN 'market_max' THEN 4 END) FILTER (phase = 'close') AS price_close,
  arg_min(bookmaker, CASE bookmaker WHEN 'betfair_exchange' THEN 1 WHEN 'pinnacle' THEN 2 WHEN 'market_avg' THEN 3 WHEN 'market_max' THEN 4 END) FILTER (phase = 'close') AS closing_source,
  MAX(price) FILTER (phase = 'close' AND bookmaker = 'market_max') AS same_book_close FROM {_O} AS o GROUP BY match_id, market, selection, line"""


@query("chosen_prices", _CHOSEN)
def chosen_prices(spark, d):
    return fair.chosen_prices(lens.read(spark, d, "odds"))


@query("closing_value", f"""WITH {_FAIR_LEGS}, f AS (SELECT match_id, market, selection, line, 1 / price / SUM(1 / price) OVER (PARTITION BY match_id, market, group_line) AS p FROM best), c AS ({_CHOSEN})
  SELECT c.match_id, c.market, c.selection, c.line, ROUND(price_taken * p - 1, 6) AS clv, ROUND(CASE WHEN same_book_close > 0 THEN price_taken / same_book_close - 1 END, 6) AS price_movement
  FROM c LEFT JOIN f ON c.match_id = f.match_id AND c.market = f.market AND c.selection = f.selection AND c.line IS NOT DISTINCT FROM f.line""")
def closing_value(spark, d):
    odds = lens.read(spark, d, "odds")
    rows = fair.closing_value(fair.compared(fair.chosen_prices(odds), fair.fair_probabilities(odds, "multiplicative")))
    return _round(rows.select("match_id", "market", "selection", "line", "clv", "price_movement"))


@query("scalar_prices", f"""SELECT match_id, market, selection, line, ROUND(CASE WHEN price > 1 THEN 1 / price END, 6) AS implied, ROUND(0.4 * price + 0.1 - 1, 6) AS expected_value, ROUND((1 - 0.1) / 0.4, 6) AS fair_price,
  ROUND(CASE WHEN 0.5 * price - 1 > 0 AND price > 1 THEN LEAST(0.02, 0.25 * (0.5 * price - 1) / (price - 1)) ELSE 0 END, 6) AS kelly FROM {_O} AS o WHERE phase = 'open' AND bookmaker = 'bet365'""")
def scalar_prices(spark, d):
    p = F.col("price")
    rows = lens.read(spark, d, "odds").where("phase = 'open' and bookmaker = 'bet365'")
    return _round(rows.select("match_id", "market", "selection", "line", pricing.implied(p).alias("implied"), pricing.expected_value(F.lit(0.4), p, F.lit(0.1)).alias("expected_value"), pricing.fair_price(F.lit(0.4), F.lit(0.1)).alias("fair_price"), pricing.kelly(F.lit(0.5), p).alias("kelly")))


# ---- settlement -------------------------------------------------------------------------------------------

_BETS = [("1x2", s, None) for s in ("home", "draw", "away")] + [("double_chance", s, None) for s in ("home_or_draw", "home_or_away", "draw_or_away")] + [("draw_no_bet", s, None) for s in ("home", "away")]
_BETS += [("winning_margin", s, None) for s in ("draw", "home_1", "home_2", "home_3_plus", "away_1", "away_2", "away_3_plus")] + [("btts", "yes", None), ("btts", "no", None), ("correct_score", "1-1", None), ("1x2_ht", "draw", None)]
_BETS += [(m, s, x) for m, lines in (("total_goals", (2.0, 2.5)), ("home_goals", (1.0, 1.5)), ("away_goals", (0.5,)), ("total_goals_ht", (1.5,)), ("total_corners", (9.5, 10.0)), ("home_total_corners", (4.5,)), ("away_total_corners", (4.0,)), ("total_cards", (3.5,)), ("home_total_cards", (1.5,)), ("away_total_cards", (1.0,))) for x in lines for s in ("over", "under")]
_BETS += [(m, s, x) for m, lines in (("asian_handicap", (-1.25, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0)), ("corner_handicap", (-1.25, -1.0, 0.5)), ("card_handicap", (-0.75, 1.0))) for x in lines for s in ("home", "away")]
_BET_SQL = "(VALUES " + ", ".join(f"('{m}', '{s}', {'NULL' if x is None else f'CAST({x} AS DOUBLE)'})" for m, s, x in _BETS) + ") AS b(market, selection, line)"


def _leg(x: str) -> str:
    return f"CASE WHEN {x} > 1e-9 THEN 1.0 ELSE 0.0 END", f"CASE WHEN abs({x}) <= 1e-9 THEN 1.0 ELSE 0.0 END"


_SETTLE = """WITH r AS (SELECT m.match_id, b.market, b.selection, b.line, m.* EXCLUDE (match_id) FROM {m} AS m CROSS JOIN {b}),
x AS (SELECT *, CASE WHEN home_goals > away_goals THEN 'home' WHEN home_goals < away_goals THEN 'away' ELSE 'draw' END AS res, CASE WHEN home_goals_ht > away_goals_ht THEN 'home' WHEN home_goals_ht < away_goals_ht THEN 'away' ELSE 'draw' END AS res_ht,
  CASE market WHEN 'total_goals' THEN home_goals + away_goals WHEN 'home_goals' THEN home_goals WHEN 'away_goals' THEN away_goals WHEN 'total_goals_ht' THEN home_goals_ht + away_goals_ht WHEN 'total_corners' THEN total_corners
    WHEN 'home_total_corners' THEN CASE WHEN away_corners IS NOT NULL THEN home_corners END WHEN 'away_total_corners' THEN CASE WHEN home_corners IS NOT NULL THEN away_corners END WHEN 'total_cards' THEN total_cards WHEN 'home_total_cards' THEN home_yellows + home_reds WHEN 'away_total_cards' THEN away_yellows + away_reds END AS cnt,
  CASE WHEN market = 'asian_handicap' THEN CASE WHEN selection = 'home' THEN home_goals - away_goals ELSE away_goals - home_goals END + line WHEN market = 'corner_handicap' THEN CASE WHEN selection = 'home' THEN home_corners - away_corners ELSE away_corners - home_corners END + line WHEN market = 'card_handicap' THEN CASE WHEN selection = 'home' THEN home_yellows + home_reds - away_yellows - away_reds ELSE away_yellows + away_reds - home_yellows - home_reds END + line END AS mg,
  line * 2 <> floor(line * 2) AS quarter FROM r),
y AS (SELECT *, CASE WHEN market LIKE '%_handicap' OR market = 'asian_handicap' THEN CASE WHEN mg IS NULL THEN NULL WHEN quarter THEN (({lw}) + ({hw})) / 2 ELSE ({w}) END
    WHEN cnt IS NOT NULL THEN CASE WHEN (selection = 'over' AND cnt > line) OR (selection = 'under' AND cnt < line) THEN 1 ELSE 0 END
    WHEN market IN ('total_corners', 'home_total_corners', 'away_total_corners', 'total_cards', 'home_total_cards', 'away_total_cards') THEN NULL
    WHEN market = '1x2' THEN CASE WHEN selection = res THEN 1 ELSE 0 END WHEN market = '1x2_ht' THEN CASE WHEN selection = res_ht THEN 1 ELSE 0 END
    WHEN market = 'double_chance' THEN CASE WHEN split_part(selection, '_or_', 1) = res OR split_part(selection, '_or_', 2) = res THEN 1 ELSE 0 END
    WHEN market = 'draw_no_bet' THEN CASE WHEN selection = res THEN 1 ELSE 0 END
    WHEN market = 'winning_margin' THEN CASE WHEN selection = CASE WHEN res = 'draw' THEN 'draw' ELSE res || '_' || CASE WHEN abs(home_goals - away_goals) >= 3 THEN '3_plus' ELSE CAST(abs(home_goals - away_goals) AS STRING) END END THEN 1 ELSE 0 END
    WHEN market = 'btts' THEN CASE WHEN (selection = 'yes') = (home_goals > 0 AND away_goals > 0) THEN 1 ELSE 0 END
    WHEN market = 'correct_score' THEN CASE WHEN selection = home_goals || '-' || away_goals THEN 1 ELSE 0 END END AS win,
  CASE WHEN market LIKE '%_handicap' OR market = 'asian_handicap' THEN CASE WHEN mg IS NULL THEN NULL WHEN quarter THEN (({lp}) + ({hp})) / 2 ELSE ({p}) END
    WHEN cnt IS NOT NULL THEN CASE WHEN cnt = line THEN 1 ELSE 0 END WHEN market IN ('total_corners', 'home_total_corners', 'away_total_corners', 'total_cards', 'home_total_cards', 'away_total_cards') THEN NULL
    WHEN market = 'draw_no_bet' AND res = 'draw' THEN 1 ELSE 0 END AS push FROM x)
SELECT match_id, market, selection, line, CAST(win AS DOUBLE) AS win, CAST(push AS DOUBLE) AS push, ROUND(CAST(win * (1.9 - 1) - (1 - win - push) AS DOUBLE), 6) AS profit FROM y"""
_SETTLE = _SETTLE.replace("{m}", _M).replace("{b}", _BET_SQL)
for _name, _x in (("w", "mg"), ("lw", "mg - 0.25"), ("hw", "mg + 0.25")):
    _SETTLE = _SETTLE.replace("{" + _name + "}", _leg(_x)[0]).replace("{" + _name.replace("w", "p") + "}", _leg(_x)[1])


@query("settle_all", _SETTLE)
def settle_all(spark, d):
    bets = [F.struct(F.lit(m).alias("market"), F.lit(s).alias("selection"), F.lit(x).cast("double").alias("line")) for m, s, x in _BETS]
    rows = _matches(spark, d).withColumns({f"{side}_cards": F.col(f"{side}_yellows") + F.coalesce(F.col(f"{side}_reds"), F.lit(0)) for side in ("home", "away")}).select("*", F.inline(F.array(*bets)))
    out = rows.withColumn("o", settlement.settle(F.col("market"), F.col("selection"), F.col("line")))
    return _round(out.select("match_id", "market", "selection", "line", F.col("o.win").alias("win"), F.col("o.push").alias("push"), settlement.profit(F.col("o"), F.lit(1.9)).alias("profit")))


# ---- the matrix and its markets ---------------------------------------------------------------------------

_CELLS = f"""pois AS (SELECT match_id, lam, mu, rho, i.k AS h, j.k AS a, exp(i.k * ln(lam) - lam) / CAST(factorial(CAST(i.k AS INT)) AS DOUBLE) * exp(j.k * ln(mu) - mu) / CAST(factorial(CAST(j.k AS INT)) AS DOUBLE)
    * CASE WHEN i.k = 0 AND j.k = 0 THEN 1 - lam * mu * rho WHEN i.k = 0 AND j.k = 1 THEN 1 + lam * rho WHEN i.k = 1 AND j.k = 0 THEN 1 + mu * rho WHEN i.k = 1 AND j.k = 1 THEN 1 - rho ELSE 1 END AS u
  FROM ({lens.sql('rates')}) AS r CROSS JOIN (SELECT unnest(range(13)) AS k) AS i CROSS JOIN (SELECT unnest(range(13)) AS k) AS j),
cells AS (SELECT match_id, h, a, u / SUM(u) OVER (PARTITION BY match_id) AS p FROM pois)"""
_HANDICAPS = (-1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5)


def _market_sql() -> str:
    out = [("1x2", s, None, f"h {op} a", None) for s, op in (("home", ">"), ("draw", "="), ("away", "<"))]
    out += [("double_chance", s, None, f"h {op} a", None) for s, op in (("home_or_draw", ">="), ("home_or_away", "<>"), ("draw_or_away", "<="))]
    out += [("draw_no_bet", s, None, f"h {op} a", "h = a") for s, op in (("home", ">"), ("away", "<"))]
    out += [("winning_margin", "draw", None, "h = a", None)] + [("winning_margin", f"{s}_{n}", None, f"{x} {t}", None) for s, x in (("home", "h - a"), ("away", "a - h")) for n, t in (("1", "= 1"), ("2", "= 2"), ("3_plus", ">= 3"))]
    out += [("btts", "yes", None, "h > 0 AND a > 0", None), ("btts", "no", None, "NOT (h > 0 AND a > 0)", None)]
    for market, x, lines in (("total_goals", "h + a", config.GOAL_LINES), ("home_goals", "h", config.TEAM_GOAL_LINES), ("away_goals", "a", config.TEAM_GOAL_LINES)):
        out += [(market, s, line, f"{x} {op} {line}", f"{x} = {line}") for line in lines for s, op in (("over", ">"), ("under", "<"))]
    parts = [f"SELECT match_id, '{m}' AS market, '{s}' AS selection, CAST({'NULL' if x is None else x} AS DOUBLE) AS line, ROUND(SUM(p) FILTER ({w}), 6) AS probability, ROUND(COALESCE({'SUM(p) FILTER (' + q + ')' if q else '0.0'}, 0), 6) AS push_probability FROM cells GROUP BY match_id" for m, s, x, w, q in out]
    for line in _HANDICAPS:
        legs = (line - 0.25, line + 0.25) if line * 2 != int(line * 2) else (line, line)
        for s, x, own in (("home", "h - a + {}", line), ("away", "a - h - {}", -line + 0.0)):
            win = " + ".join(f"SUM(CASE WHEN {x.format(f'({v})')} > 0 THEN p ELSE 0 END)" for v in legs)
            push = " + ".join(f"SUM(CASE WHEN {x.format(f'({v})')} = 0 THEN p ELSE 0 END)" for v in legs)
            parts.append(f"SELECT match_id, 'asian_handicap', '{s}', CAST({own} AS DOUBLE), ROUND(({win}) / 2, 6), ROUND(({push}) / 2, 6) FROM cells GROUP BY match_id")
    return f"WITH {_CELLS} " + " UNION ALL ".join(parts)


@query("goal_markets", _market_sql())
def goal_markets(spark, d):
    return _round(matrix.goal_markets(matrix.cells(lens.read(spark, d, "rates"), ["match_id"]), ["match_id"], handicaps=_HANDICAPS))


@query("correct_scores", f"""WITH {_CELLS}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY ROUND(p, 12) DESC, h, a) AS k FROM cells)
  SELECT match_id, 'correct_score' AS market, h || '-' || a AS selection, CAST(NULL AS DOUBLE) AS line, ROUND(p, 6) AS probability, CAST(0 AS DOUBLE) AS push_probability FROM k WHERE k <= 3""")
def correct_scores(spark, d):
    return _round(matrix.rated_scores(lens.read(spark, d, "rates"), ["match_id"], 3))


@query("total_distribution", f"WITH {_CELLS} SELECT match_id, h + a AS total, ROUND(SUM(p), 6) AS p, ROUND(SUM(SUM(p * (h + a))) OVER (PARTITION BY match_id), 6) AS expected_total FROM cells GROUP BY match_id, h + a")
def total_distribution(spark, d):
    rows = matrix.totals(matrix.cells(lens.read(spark, d, "rates"), ["match_id"]), ["match_id"])
    return _round(rows.select("match_id", "expected_total", F.posexplode("total_pmf").alias("total", "p")))


@query("price_offered", f"""WITH {_CELLS}, o AS (SELECT DISTINCT match_id, market, selection, line FROM {_O} AS x),
  g AS (SELECT o.*, h, a, p, CASE WHEN selection = 'home' THEN h - a ELSE a - h END + line AS mg FROM o JOIN cells USING (match_id))
  SELECT match_id, market, selection, line, ROUND(SUM(p * CASE WHEN market = '1x2' THEN CASE WHEN (selection = 'home' AND h > a) OR (selection = 'draw' AND h = a) OR (selection = 'away' AND h < a) THEN 1 ELSE 0 END
    WHEN market = 'total_goals' THEN CASE WHEN (selection = 'over' AND h + a > line) OR (selection = 'under' AND h + a < line) THEN 1 ELSE 0 END
    ELSE (CASE WHEN mg - 0.25 > 1e-9 THEN 1 ELSE 0 END + CASE WHEN mg + 0.25 > 1e-9 THEN 1 ELSE 0 END) / 2 END), 6) AS probability,
  ROUND(SUM(p * CASE WHEN market = 'asian_handicap' THEN (CASE WHEN abs(mg - 0.25) <= 1e-9 THEN 1 ELSE 0 END + CASE WHEN abs(mg + 0.25) <= 1e-9 THEN 1 ELSE 0 END) / 2 ELSE 0 END), 6) AS push_probability FROM g GROUP BY match_id, market, selection, line""")
def price_offered(spark, d):
    offered = lens.read(spark, d, "odds").select("match_id", "market", "selection", "line").distinct()
    return _round(matrix.price_offered(lens.read(spark, d, "rates"), offered, ["match_id"]))


_NB = f"""nb AS (SELECT match_id, y, CAST(exp(lgamma(y + 8.0) - lgamma(8.0) - lgamma(y + 1.0) + 8.0 * ln(8.0 / (8.0 + mean)) + y * ln(mean / (8.0 + mean))) AS DOUBLE) AS u FROM (SELECT match_id, 3 * lam AS mean FROM ({lens.sql('rates')}) AS r) AS t CROSS JOIN (SELECT unnest(range(41)) AS y) AS k),
pmf AS (SELECT match_id, y, u / SUM(u) OVER (PARTITION BY match_id) AS p FROM nb)"""


@query("count_totals", f"WITH {_NB} " + " UNION ALL ".join(f"SELECT match_id, 'total_corners' AS market, '{s}' AS selection, CAST({x} AS DOUBLE) AS line, ROUND(SUM(CASE WHEN y {op} {x} THEN p ELSE 0 END), 6) AS probability, ROUND(SUM(CASE WHEN y = {x} THEN p ELSE 0 END), 6) AS push_probability FROM pmf GROUP BY match_id" for x in (*config.CORNER_LINES, 10.0) for s, op in (("over", ">"), ("under", "<"))))
def count_totals(spark, d):
    rows = lens.read(spark, d, "rates").select("match_id", matrix.count_pmf(3 * F.col("lam"), F.lit(8.0)).alias("pmf"))
    return _round(matrix.count_over_under(rows, ["match_id"], "pmf", "total_corners", (*config.CORNER_LINES, 10.0)))


@query("day_picks", f"""WITH {_CELLS}, s AS (SELECT match_id, CASE WHEN h > a THEN 'home' WHEN h < a THEN 'away' ELSE 'draw' END AS pick, SUM(p) AS c FROM cells GROUP BY ALL)
  SELECT match_id, pick, ROUND(c, 6) AS confidence FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY ROUND(c, 12) DESC, pick) AS k FROM s) AS x WHERE k = 1""")
def day_picks(spark, d):
    return _round(matrix.day_picks(matrix.goal_markets(matrix.cells(lens.read(spark, d, "rates"), ["match_id"]), ["match_id"]), ["match_id"]))


# ---- scoring ----------------------------------------------------------------------------------------------

_J = f"(SELECT *, CASE WHEN win_fraction > 0.5 THEN 1.0 ELSE 0.0 END AS y FROM {_P} AS p WHERE push_fraction < 0.5 AND model_conditional IS NOT NULL)"
_BAND = "CASE " + " ".join(f"WHEN model_conditional >= CAST('{scoring.edges()[k]!r}' AS DOUBLE) AND model_conditional < CAST('{scoring.edges()[k + 1]!r}' AS DOUBLE) THEN {k}" for k in range(scoring.BANDS)) + " END"
_LL = "-(y * ln({p}) + (1 - y) * ln(1 - {p}))"


def _predictions(spark, d):
    return lens.read(spark, d, "predictions")


@query("market_scores", f"""SELECT market, n, model_log_loss, model_brier, ROUND(-(base * ln(base) + (1 - base) * ln(1 - base)), 6) AS base_rate_log_loss, n_priced, model_log_loss_priced, market_log_loss, log_loss_gap FROM (
  SELECT market, COUNT(*) AS n, ROUND(AVG({_LL.format(p='model_conditional')}), 6) AS model_log_loss, ROUND(AVG((model_conditional - y) * (model_conditional - y)), 6) AS model_brier, CAST(AVG(y) AS DOUBLE) AS base, COUNT(market_probability) AS n_priced,
  ROUND(AVG({_LL.format(p='model_conditional')}) FILTER (market_probability IS NOT NULL), 6) AS model_log_loss_priced, ROUND(AVG({_LL.format(p='market_probability')}) FILTER (market_probability IS NOT NULL), 6) AS market_log_loss,
  ROUND(AVG({_LL.format(p='model_conditional')}) FILTER (market_probability IS NOT NULL) - AVG({_LL.format(p='market_probability')}) FILTER (market_probability IS NOT NULL), 6) AS log_loss_gap FROM {_J} AS j GROUP BY market) AS x""")
def market_scores(spark, d):
    return _round(scoring.market_scores(_predictions(spark, d)))


@query("calibration", f"""SELECT market, printf('%.2f-%.2f', k / 10, (k + 1) / 10) AS band, n, ROUND(predicted, 6) AS predicted, ROUND(observed, 6) AS observed, ROUND(observed - predicted, 6) AS gap FROM (
  SELECT market, k, COUNT(*) AS n, AVG(model_conditional) AS predicted, CAST(AVG(y) AS DOUBLE) AS observed FROM (SELECT *, {_BAND} AS k FROM {_J} AS j) AS q GROUP BY market, k HAVING COUNT(*) >= 10) AS x""")
def calibration(spark, d):
    return _round(scoring.calibration(_predictions(spark, d), ["market"]))


@query("calibration_by_line", f"""SELECT line, printf('%.2f-%.2f', k / 10, (k + 1) / 10) AS band, n, ROUND(predicted, 6) AS predicted, ROUND(observed, 6) AS observed, ROUND(observed - predicted, 6) AS gap, ROUND(se, 6) AS se, ROUND((observed - predicted) / se, 4) AS z FROM (
  SELECT line, k, COUNT(*) AS n, AVG(model_conditional) AS predicted, CAST(AVG(y) AS DOUBLE) AS observed, sqrt(SUM(model_conditional * (1 - model_conditional))) / COUNT(*) AS se
  FROM (SELECT *, {_BAND} AS k FROM {_J} AS j WHERE market = 'total_goals' AND selection = 'over') AS q GROUP BY line, k HAVING COUNT(*) >= 25) AS x""")
def calibration_by_line(spark, d):
    return _round(scoring.calibration_by_line(_predictions(spark, d), "total_goals", "over")).withColumn("z", F.round("z", 4))


@query("closing_line_value", f"""SELECT market, COUNT(*) AS n, ROUND(AVG(clv), 6) AS mean_clv, ROUND(quantile_cont(clv, 0.5), 6) AS median_clv, ROUND(AVG(CASE WHEN clv > 0 THEN 1.0 ELSE 0.0 END), 6) AS beat_close_rate, ROUND(stddev_samp(clv) / sqrt(COUNT(*)), 6) AS clv_standard_error,
  CASE WHEN COUNT(price_movement) >= 20 THEN ROUND(AVG(price_movement), 6) END AS mean_price_movement, CASE WHEN COUNT(price_movement) >= 20 THEN COUNT(price_movement) END AS n_price_movement FROM {_P} AS p WHERE clv IS NOT NULL GROUP BY market""")
def closing_line_value(spark, d):
    return _round(scoring.closing_line_value(_predictions(spark, d), ["market"]))


def _clustered_sql(source: str, keys: str, cluster: str = "match_id") -> str:
    return f"""SELECT {keys}, n, n_clusters, mean, CASE WHEN n_clusters >= 2 THEN sqrt(n_clusters / (n_clusters - 1) * ss) / n END AS se FROM (
  SELECT {keys}, CAST(SUM(c) AS BIGINT) AS n, COUNT(*) AS n_clusters, ANY_VALUE(mean) AS mean, SUM((s - c * mean) * (s - c * mean)) AS ss FROM (
    SELECT {keys}, {cluster}, COUNT(*) AS c, SUM(clv) AS s, SUM(SUM(clv)) OVER (PARTITION BY {keys}) / SUM(COUNT(*)) OVER (PARTITION BY {keys}) AS mean FROM {source} AS src WHERE clv IS NOT NULL GROUP BY {keys}, {cluster}) AS g GROUP BY {keys}) AS h"""


@query("clustered_clv", f"SELECT market, n, n_clusters, ROUND(mean, 6) AS mean, ROUND(se, 6) AS se FROM ({_clustered_sql(_P, 'market', 'date')}) AS z")
def clustered_clv(spark, d):
    return _round(scoring.clustered(_predictions(spark, d), ["market"], "clv", "date"))


_SEASON = "YEAR(date) - CASE WHEN MONTH(date) < 8 THEN 1 ELSE 0 END"


@query("season_breakdown", f"""WITH r AS (SELECT *, {_SEASON} AS season FROM {_P} AS p), b AS (SELECT * FROM r WHERE expected_value >= 0.02 AND clv IS NOT NULL),
  base AS (SELECT season, COUNT(DISTINCT match_id) AS matches, COUNT(*) AS priced FROM r GROUP BY season), c AS ({_clustered_sql('b', 'season')}),
  n AS (SELECT season, stddev_samp(clv) / sqrt(COUNT(*)) AS se_naive, AVG(CASE WHEN clv > 0 THEN 1.0 ELSE 0.0 END) AS beat_close FROM b GROUP BY season),
  l AS (SELECT season, AVG({_LL.format(p='model_conditional')}) AS model_log_loss, CASE WHEN COUNT(market_probability) >= 30 THEN AVG({_LL.format(p='market_probability')}) FILTER (market_probability IS NOT NULL) END AS market_log_loss,
    CASE WHEN COUNT(market_probability) >= 30 THEN AVG({_LL.format(p='model_conditional')}) FILTER (market_probability IS NOT NULL) - AVG({_LL.format(p='market_probability')}) FILTER (market_probability IS NOT NULL) END AS log_loss_gap FROM (SELECT *, {_SEASON} AS season FROM {_J} AS j) AS q GROUP BY season)
  SELECT season, matches, priced, COALESCE(c.n, 0) AS bets, ROUND(mean, 6) AS mean_clv, ROUND(se, 6) AS se_clustered, ROUND(se_naive, 6) AS se_naive, ROUND(beat_close, 6) AS beat_close, ROUND(model_log_loss, 6) AS model_log_loss, ROUND(market_log_loss, 6) AS market_log_loss, ROUND(log_loss_gap, 6) AS log_loss_gap,
  ROUND(CASE WHEN se > 0 THEN mean / se END, 4) AS z FROM base LEFT JOIN c USING (season) LEFT JOIN n USING (season) LEFT JOIN l USING (season)""")
def season_breakdown(spark, d):
    return _round(scoring.seasons(_predictions(spark, d))).withColumn("z", F.round("z", 4))


@query("fair_sources", f"SELECT season, fair_line_source, selections, ROUND(selections / SUM(selections) OVER (PARTITION BY season), 6) AS share FROM (SELECT {_SEASON} AS season, fair_line_source, COUNT(*) AS selections FROM {_P} AS p WHERE fair_line_source IS NOT NULL GROUP BY ALL) AS x")
def fair_sources(spark, d):
    return _round(scoring.fair_sources(_predictions(spark, d)))


@query("benchmark_changes", f"""WITH s AS (SELECT {_SEASON} AS season, fair_line_source, COUNT(*) AS n FROM {_P} AS p WHERE fair_line_source IS NOT NULL GROUP BY ALL), h AS (SELECT season, fair_line_source, n / SUM(n) OVER (PARTITION BY season) AS share FROM s),
  t AS (SELECT season, MAX(share) AS share, arg_max(fair_line_source, share) AS now FROM h GROUP BY season), g AS (SELECT season, now, LAG(now) OVER (ORDER BY season) AS before FROM t WHERE share >= 0.5)
  SELECT CAST(season AS BIGINT) AS season, before, now FROM g WHERE before <> now""")
def benchmark_changes(spark, d):
    return _round(scoring.benchmark_changes(scoring.fair_sources(_predictions(spark, d))))


@query("flat_ledger", f"""WITH b AS (SELECT *, CASE WHEN win_fraction > 0.5 THEN price_taken - 1 WHEN push_fraction > 0 THEN (price_taken - 1) / 2 ELSE -1 END AS profit FROM {_P} AS p WHERE expected_value >= 0.02 AND price_taken BETWEEN 1.2 AND 15)
  , l AS (SELECT *, SUM(profit) OVER w AS bankroll, COUNT(*) OVER w AS turnover FROM b WINDOW w AS (PARTITION BY league ORDER BY date, match_id, market, selection, line NULLS FIRST ROWS UNBOUNDED PRECEDING))
  , q AS (SELECT *, bankroll - MAX(bankroll) OVER (PARTITION BY league ORDER BY date, match_id, market, selection, line NULLS FIRST ROWS UNBOUNDED PRECEDING) AS drawdown FROM l)
  SELECT league, COUNT(*) AS bets, ROUND(SUM(profit), 4) AS profit, ROUND(AVG(profit), 6) AS roi, ROUND(AVG(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, ROUND(MIN(drawdown / turnover), 6) AS max_drawdown, ROUND(MIN(drawdown), 4) AS max_drawdown_units FROM q GROUP BY league""")
def flat_ledger(spark, d):
    out = scoring.staking_summary(scoring.flat_ledger(_bets(spark, d)))
    return _round(out).withColumns({c: F.round(c, 4) for c in ("profit", "max_drawdown_units")})


def _bets(spark, d):
    p = F.col("price_taken")
    profit = F.when(F.col("win_fraction") > 0.5, p - 1).when(F.col("push_fraction") > 0, (p - 1) / 2).otherwise(F.lit(-1.0))
    return scoring.bets(_predictions(spark, d)).withColumn("profit_at_taken", profit)


@query("bootstrap_roi")
def bootstrap_roi(spark, d):
    return _round(scoring.bootstrap_roi(_bets(spark, d)), 4)


def _slopes_sql(keys: str, judged: str = _J) -> str:
    """Newton's steps on sums at the distinct probabilities, as many as let every group come to rest."""
    on = " AND ".join(f"p.{k} = i.{k}" for k in keys.split(", "))
    mine = ", ".join(f"i.{k}" for k in keys.split(", "))
    sums = "SUM(s - c * m) AS g, SUM(x * (s - c * m)) AS gx, SUM(c * m * (1 - m)) AS h, SUM(c * m * (1 - m) * x) AS hx, SUM(c * m * (1 - m) * x * x) AS hxx"
    return f"""WITH RECURSIVE q AS (SELECT {keys}, LEAST(GREATEST(ROUND(model_conditional, 10), 1e-12), 1 - 1e-12) AS pr, CAST(y AS DOUBLE) AS y FROM {judged} AS j),
  points AS (SELECT {keys}, ln(pr / (1 - pr)) AS x, CAST(COUNT(*) AS DOUBLE) AS c, SUM(y) AS s FROM q GROUP BY {keys}, ln(pr / (1 - pr))),
  size AS (SELECT {keys}, CAST(SUM(c) AS BIGINT) AS n, SUM(c) >= 30 AND SUM(s) > 0 AND SUM(s) < SUM(c) AS fits FROM points GROUP BY {keys}),
  steps AS (SELECT {keys}, 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS v FROM size WHERE fits
    UNION ALL SELECT {keys}, k + 1, a + (hxx * g - hx * gx) / (h * hxx - hx * hx), b + (h * gx - hx * g) / (h * hxx - hx * hx), h / (h * hxx - hx * hx)
    FROM (SELECT {keys}, k, a, b, {sums} FROM (SELECT {mine}, i.k, i.a, i.b, p.x, p.c, p.s, 1 / (1 + exp(-(i.a + i.b * p.x))) AS m FROM steps AS i JOIN points AS p ON {on} WHERE i.k < 30) AS e GROUP BY {keys}, k, a, b) AS f)
  SELECT {keys}, n, a AS intercept, b AS slope, sqrt(v) AS slope_se, (b - 1) / sqrt(v) AS slope_z FROM size LEFT JOIN (SELECT * FROM steps WHERE k = 30) AS l USING ({keys})"""


@query("calibration_slope", f"SELECT market, n, ROUND(intercept, 4) AS intercept, ROUND(slope, 4) AS slope, ROUND(slope_se, 4) AS slope_se, ROUND(slope_z, 4) AS slope_z FROM ({_slopes_sql('market')}) AS z")
def calibration_slope(spark, d):
    return _round(scoring.calibration_slope(_predictions(spark, d), ["market"]), 4)


@query("era_comparison", f"""WITH b AS (SELECT *, {_SEASON} >= 1998 AS aft FROM {_P} AS p WHERE expected_value >= 0.02 AND clv IS NOT NULL), c AS ({_clustered_sql('b', 'aft')})
  SELECT ROUND(x.mean, 6) AS mean_clv_before, ROUND(x.se, 6) AS se_before, x.n AS n_before, y.n AS n_after, ROUND(y.mean, 6) AS mean_clv_after, ROUND(y.se, 6) AS se_after, CAST(1998 AS BIGINT) AS split_season,
  ROUND(y.mean - x.mean, 6) AS difference, ROUND(sqrt(x.se * x.se + y.se * y.se), 6) AS difference_se, ROUND((y.mean - x.mean) / sqrt(x.se * x.se + y.se * y.se), 4) AS difference_z FROM c AS x JOIN c AS y ON NOT x.aft AND y.aft""")
def era_comparison(spark, d):
    return _round(scoring.eras(_predictions(spark, d), 1998)).withColumn("difference_z", F.round("difference_z", 4))


_SCORED = f"(SELECT j.* FROM {_J} AS j JOIN (SELECT league, market, BOOL_OR(priceless) AS free FROM {_P} AS p GROUP BY league, market) AS h ON h.league = j.league AND h.market = j.market WHERE priceless OR NOT free)"


@query("evidence", f"""SELECT s.league, s.market, n, ROUND(log_loss, 4) AS log_loss, ROUND(-(base * ln(base) + (1 - base) * ln(1 - base)), 4) AS base_rate_log_loss, ROUND(slope, 4) AS slope, ROUND(slope_se, 4) AS slope_se, n_bets, ROUND(mean, 4) AS mean_clv, ROUND(se, 4) AS clv_se, CASE WHEN n_bets > 0 THEN 'backtested' ELSE 'calibration-only' END AS state
  FROM (SELECT league, market, COUNT(*) AS n, AVG({_LL.format(p='model_conditional')}) AS log_loss, LEAST(GREATEST(AVG(y), 1e-12), 1 - 1e-12) AS base FROM {_SCORED} AS a GROUP BY league, market) AS s
  LEFT JOIN (SELECT league, market, slope, slope_se FROM ({_slopes_sql('league, market', _SCORED)}) AS b) AS l ON l.league = s.league AND l.market = s.market
  LEFT JOIN (SELECT league, market, n AS n_bets, mean, se FROM ({_clustered_sql(f'(SELECT * FROM {_P} AS v WHERE expected_value IS NOT NULL)', 'league, market')}) AS c) AS v ON v.league = s.league AND v.market = s.market""")
def evidence(spark, d):
    return _round(scoring.evidence(_predictions(spark, d)), 4)


@query("total_fit", f"""WITH {_CELLS}, t AS (SELECT match_id, h + a AS k, SUM(p) AS p FROM cells GROUP BY ALL), m AS (SELECT match_id, SUM(p * k) AS mean, SUM(p * k * k) - SUM(p * k) * SUM(p * k) AS v FROM t GROUP BY match_id),
  r AS (SELECT m.*, total_goals AS g, (total_goals - mean) * (total_goals - mean) / v AS s FROM m JOIN {_M} AS x ON x.match_id = m.match_id)
  SELECT COUNT(s) AS n, ROUND(AVG(s), 6) AS dispersion, ROUND(stddev_samp(s) / sqrt(COUNT(s)), 6) AS dispersion_se, ROUND(AVG(g), 6) AS observed_mean, ROUND(AVG(mean), 6) AS predicted_mean, ROUND(var_samp(g), 6) AS observed_variance, ROUND(AVG(v), 6) AS within_match_variance, ROUND(var_samp(mean), 6) AS between_match_variance FROM r""")
def total_fit(spark, d):
    pmf = matrix.totals(matrix.cells(lens.read(spark, d, "rates"), ["match_id"]), ["match_id"])
    rows = pmf.join(_matches(spark, d).select("match_id", F.col("total_goals").alias("observed_total")), "match_id")
    return _round(scoring.total_fit(rows)[0])


# ---- archive ----------------------------------------------------------------------------------------------

_PULLS = f"({lens.sql('pulls')})"


def _snapshots(spark, d):
    p = lens.read(spark, d, "pulls")
    at = F.col("pulled_at").cast("timestamp")
    nothing = F.lit(None).cast("string")
    rows = p.select("content_hash", "fixture_key", "league", "fixture_date", nothing.alias("kickoff_time"), F.concat(F.lit("H"), "fixture_key").alias("home_team"), F.concat(F.lit("A"), "fixture_key").alias("away_team"), nothing.alias("referee"), nothing.alias("collection_window"), at.alias("nominal_collected_at"), at.alias("first_pulled_at_utc"), at.alias("last_pulled_at_utc"), nothing.alias("match_id"), F.lit(1).alias("parser_version"), "event_id")
    return rows


@query("snapshot_merge", f"SELECT content_hash, ANY_VALUE(fixture_key) AS fixture_key, CAST(CAST(MIN(pulled_at) AS TIMESTAMP) AS STRING) AS first_pull, CAST(CAST(MAX(pulled_at) AS TIMESTAMP) AS STRING) AS last_pull FROM {_PULLS} AS p GROUP BY content_hash")
def snapshot_merge(spark, d):
    rows = _snapshots(spark, d)
    old, new = rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id")
    out = archive.merged(archive.merged(old.limit(0), old), new)
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"(\.\d*?)0+$", r"$1")
    return out.select("content_hash", "fixture_key", text("first_pulled_at_utc").alias("first_pull"), text("last_pulled_at_utc").alias("last_pull"))


@query("latest_snapshot", f"SELECT fixture_key, content_hash FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fixture_key ORDER BY m DESC, content_hash DESC) AS k FROM (SELECT fixture_key, content_hash, MAX(pulled_at) AS m FROM {_PULLS} AS p GROUP BY ALL) AS g) AS x WHERE k = 1")
def latest_snapshot(spark, d):
    rows = _snapshots(spark, d).drop("event_id")
    return archive.latest(archive.merged(rows.limit(0), rows)).select("fixture_key", "content_hash")


@query("archive_coverage", f"""SELECT league, COUNT(*) AS snapshots, COUNT(DISTINCT fixture_key) AS fixtures, CAST(NULL AS BIGINT) AS reconciled, CAST(SUM(CASE WHEN fixture_date < DATE '2024-01-16' THEN 1 END) AS BIGINT) AS unmatched_past, CAST(SUM(CASE WHEN fixture_date >= DATE '2024-01-16' THEN 1 END) AS BIGINT) AS awaiting_kickoff
  FROM {_PULLS} AS p GROUP BY league""")
def archive_coverage(spark, d):
    return _round(archive.coverage(_snapshots(spark, d), "2024-01-16").drop("first_pull", "last_pull"))


_SHIFTED = f"SELECT 's' || match_id AS content_hash, league, home_team, away_team, CAST(date + CAST(CAST(match_id AS BIGINT) % 5 - 2 AS INT) AS DATE) AS fixture_date FROM {_M} AS m"


@query("reconcile_band_join", f"""WITH s AS ({_SHIFTED}), m AS {_M}, j AS (SELECT content_hash, match_id, ROW_NUMBER() OVER (PARTITION BY content_hash ORDER BY abs(fixture_date - date), date, match_id) AS k FROM s JOIN m USING (league, home_team, away_team) WHERE abs(fixture_date - date) <= 1)
  SELECT s.content_hash, j.match_id FROM s LEFT JOIN j ON j.k = 1 AND s.content_hash = j.content_hash""")
def reconcile_band_join(spark, d):
    m = _matches(spark, d)
    shift = (F.col("match_id").cast("bigint") % 5 - 2).cast("int")
    snaps = m.select(F.concat(F.lit("s"), "match_id").alias("content_hash"), "league", "home_team", "away_team", F.date_add("date", shift).alias("fixture_date"), F.lit(None).cast("string").alias("match_id"))
    return archive.reconciled(snaps, m).select("content_hash", "match_id")


@query("content_hashes", f"""WITH o AS (SELECT match_id, STRING_AGG(t, chr(10) ORDER BY t) AS lines FROM (SELECT match_id, bookmaker || '|' || phase || '|' || market || '|' || selection || '|' || COALESCE(printf('%.3f', line), '') || '|' || printf('%.3f', price) AS t FROM {_O} AS x) AS y GROUP BY match_id)
  SELECT m.match_id, substr(sha256('away_team=' || away_team || chr(10) || 'fixture_date=' || CAST(date AS STRING) || chr(10) || 'home_team=' || home_team || chr(10) || 'kickoff_time=None' || chr(10) || 'league=' || league || chr(10) || 'referee=' || COALESCE(referee, 'None') || chr(10) || o.lines), 1, 32) AS content_hash
  FROM {_M} AS m JOIN o ON o.match_id = m.match_id""")
def content_hashes(spark, d):
    odds = lens.read(spark, d, "odds").groupBy("match_id").agg(F.collect_list(F.struct("bookmaker", "phase", "market", "selection", "line", "price")).alias("odds"))
    rows = _matches(spark, d).withColumns({"fixture_date": F.col("date"), "kickoff_time": F.lit(None).cast("string")}).join(odds, "match_id")
    return rows.select("match_id", archive.content_hash(F.col("odds")).alias("content_hash"))


@query("scan_withheld", f"""SELECT match_id, market, concat_ws('; and ', CASE WHEN k < 5 THEN 'one side has ' || k || ' match' || CASE WHEN k = 1 THEN '' ELSE 'es' END || ' of history, under the 5 required' END,
  CASE WHEN expected_value > 0.18 THEN 'expected value +' || CAST(round(expected_value * 100) AS INT) || '% is over the +18% that is trusted' END) AS withheld FROM (SELECT *, LEAST(CAST(match_id AS BIGINT) % 13, CAST(match_id AS BIGINT) % 17) AS k FROM {_P} AS p WHERE expected_value IS NOT NULL) AS x""")
def scan_withheld(spark, d):
    rows = _predictions(spark, d).where("expected_value is not null")
    k = F.col("match_id").cast("bigint")
    return rows.select("match_id", "market", scan.reasons((k % 13).cast("int"), (k % 17).cast("int"), F.col("expected_value"), 5, 0.18).alias("withheld"))


# ---- line-ups and injuries --------------------------------------------------------------------------------

_A = f"""(SELECT l.*, m.date, CASE WHEN l.is_home THEN home_team ELSE away_team END AS team FROM ({lens.sql('lineups')}) AS l JOIN {_M} AS m ON l.match_id = m.match_id)"""


@query("availability_window", f"""WITH a AS {_A}, g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY date, match_id, is_home) - 1 AS pos FROM (SELECT DISTINCT team, date, match_id, is_home FROM a) AS x), p AS (SELECT a.*, g.pos FROM a JOIN g USING (team, date, match_id, is_home)),
  s AS (SELECT g.team, g.pos, p.player_id, SUM(CASE WHEN p.pos < g.pos - 1 THEN minutes END) AS minutes, SUM(CASE WHEN p.pos < g.pos - 1 THEN xgchain END) AS chain, COUNT(*) FILTER (p.pos < g.pos - 1 AND started) AS starts, MAX(CASE WHEN p.pos = g.pos - 1 THEN 1 ELSE 0 END) AS recent
    FROM g JOIN p ON p.team = g.team AND p.pos BETWEEN g.pos - 11 AND g.pos - 1 GROUP BY ALL),
  t AS (SELECT team, pos, SUM(minutes) FILTER (recent = 0) AS m, SUM(minutes) FILTER (recent = 0 AND starts * 2 > LEAST(pos - 1, 10)) AS r, SUM(chain) FILTER (recent = 0 AND minutes IS NOT NULL) AS c, SUM(chain) AS chain, COUNT(*) FILTER (recent = 0 AND minutes IS NOT NULL) AS n FROM s GROUP BY ALL)
  SELECT match_id, is_home, g.team, ROUND(CASE WHEN g.pos >= 6 THEN COALESCE(m, 0) / (LEAST(g.pos - 1, 10) * 990) END, 6) AS missing_share, ROUND(CASE WHEN g.pos >= 6 THEN COALESCE(r, 0) / (LEAST(g.pos - 1, 10) * 990) END, 6) AS missing_starter_share,
    ROUND(CASE WHEN g.pos >= 6 AND chain > 0 THEN COALESCE(c, 0) / chain END, 6) AS missing_xgchain_share, CASE WHEN g.pos >= 6 THEN CAST(n AS DOUBLE) END AS n_missing, g.pos AS n_prior FROM g LEFT JOIN t ON t.team = g.team AND t.pos = g.pos""")
def availability_window(spark, d):
    return _round(availability.features(availability.appearances(lens.read(spark, d, "lineups"), _matches(spark, d))))


_I = f"({lens.sql('injuries')})"


@query("out_counts", f"SELECT team, fixture_date, COUNT(DISTINCT player) AS out FROM {_I} AS i WHERE ruled_out OR doubtful GROUP BY team, fixture_date")
def out_counts(spark, d):
    return availability.out_counts(lens.read(spark, d, "injuries"), doubtful=True)


@query("newly_out", f"""WITH s AS (SELECT team, fixture_date, list_distinct(list(player)) AS players FROM {_I} AS i WHERE ruled_out GROUP BY ALL), l AS (SELECT *, LAG(players) OVER (PARTITION BY team ORDER BY fixture_date) AS before FROM s)
  SELECT team, fixture_date, CAST(len(list_filter(players, lambda x: before IS NULL OR NOT list_contains(before, x))) AS BIGINT) AS out FROM l""")
def newly_out(spark, d):
    return _round(availability.newly_out(lens.read(spark, d, "injuries")))


@query("asof_nearest", f"""WITH o AS (SELECT team, fixture_date, COUNT(DISTINCT player) AS out FROM {_I} AS i WHERE ruled_out GROUP BY ALL), j AS (SELECT match_id, m.team, o.fixture_date, o.out, ROW_NUMBER() OVER (PARTITION BY match_id, m.team ORDER BY abs(m.date - o.fixture_date), o.fixture_date) AS k
    FROM {_TM} AS m JOIN o ON m.team = o.team AND abs(m.date - o.fixture_date) <= 1)
  SELECT t.match_id, t.team, j.fixture_date, j.out FROM {_TM} AS t LEFT JOIN j ON j.k = 1 AND j.match_id = t.match_id AND j.team = t.team""")
def asof_nearest(spark, d):
    left = teams.team_matches(_matches(spark, d)).select("match_id", "team", "date")
    right = availability.out_counts(lens.read(spark, d, "injuries"))
    return availability.nearest(left, right, "team", "date", "fixture_date").select("match_id", "team", "fixture_date", "out")


@query("weekly_buckets", f"""SELECT match_id, league, b AS bucket, MIN(date) OVER (PARTITION BY league, b) AS as_of FROM (SELECT *, CAST(floor((date - MIN(date) OVER ()) / 7) AS BIGINT) AS b FROM {_M} AS m) AS x""")
def weekly_buckets(spark, d):
    m = _matches(spark, d)
    return walk.bucketed(m, _whole_walk(m)).select("match_id", "league", "bucket", "as_of")


# ---- fits and what builds on them -------------------------------------------------------------------------

@query("goals_fit")
def goals_fit(spark, d):
    rows = teams.training_rows(_matches(spark, d), AS_OF, config.HALF_LIFE_DAYS).repartition("league")
    return _round(fits.ratings(fits.fit_goals(rows, ["league"]), ["league"]), 4)


@query("counts_fit")
def counts_fit(spark, d):
    rows = teams.training_rows(_matches(spark, d), AS_OF, config.HALF_LIFE_DAYS)
    return _round(fits.fit_counts(rows, ["league"], "corners").drop("ratings", "referees"), 4)


@query("fixture_markets")
def fixture_markets(spark, d):
    m = _matches(spark, d)
    models = predict.models(m, AS_OF)
    upcoming = m.where(F.col("date").between(AS_OF, "1999-03-07")).select(F.col("match_id").alias("fixture_id"), "league", "home_team", "away_team", "referee")
    return _round(predict.priced(upcoming, models), 4)


@query("walk_forward")
def walk_forward(spark, d):
    m = _matches(spark, d)
    rows = walk.predictions(m, lens.read(spark, d, "odds"), _whole_walk(m))
    return _round(scoring.market_scores(rows), 4)


@query("availability_effect")
def availability_effect(spark, d):
    m = _matches(spark, d)
    shares = availability.by_match(availability.features(availability.appearances(lens.read(spark, d, "lineups"), m)))
    totals = m.select("league", "match_id", F.col("home_goals").alias("observed_home"), F.col("away_goals").alias("observed_away"), F.lit(2.0).alias("lam"), F.lit(1.5).alias("mu"))
    rows = research.sides(totals, shares, "missing_share_home", "missing_share_away")
    return _round(research.offset_poisson(rows, ["league"]), 4)


from . import queries_inputs  # noqa: E402, F401  registers its queries with the helpers above
