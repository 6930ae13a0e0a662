"""Schemas of the stored tables."""

from __future__ import annotations

#: Integers that a season file reports for a match.
COUNTS = (
    "home_goals", "away_goals", "home_goals_ht", "away_goals_ht", "home_shots", "away_shots", "home_sot", "away_sot", "home_corners", "away_corners",
    "home_fouls", "away_fouls", "home_offsides", "away_offsides", "home_yellows", "away_yellows", "home_reds", "away_reds", "home_woodwork", "away_woodwork", "attendance",
)

MATCHES = (
    "match_id string, league string, league_name string, country string, season_start_year int, season string, date date, kickoff_time string, "
    "home_team string, away_team string, referee string, attendance int, home_goals int, away_goals int, result string, home_goals_ht int, "
    "away_goals_ht int, result_ht string, home_shots int, away_shots int, home_sot int, away_sot int, home_corners int, away_corners int, "
    "home_fouls int, away_fouls int, home_offsides int, away_offsides int, home_woodwork int, away_woodwork int, home_yellows int, away_yellows int, "
    "home_reds int, away_reds int, total_goals int, goal_difference int, btts boolean, over_1_5 boolean, over_2_5 boolean, over_3_5 boolean, "
    "goals_ht int, goals_2h int, total_corners int, total_cards int, total_yellows int, total_reds int, booking_points int, total_shots int, total_sot int, total_fouls int"
)
ODDS = "match_id string, bookmaker string, phase string, market string, selection string, line double, price double"
INGEST_LOG = "league string, season_start_year int, matches bigint, odds bigint, loaded_at timestamp"
MATCH_XG = "match_id string, feed_id string, home_xg double, away_xg double"
LINEUPS = "match_id string, is_home boolean, player_id string, player string, position string, minutes int, started boolean, xg double, xa double, xgchain double"
FIXTURES = "feed_id string, league string, season_start_year int, kickoff_utc timestamp, home_team string, away_team string, played boolean, home_goals int, away_goals int, home_xg double, away_xg double"
CALENDAR = "source string, league string, season_start_year int, kickoff_utc timestamp, round string, home_team string, away_team string, played boolean, home_goals int, away_goals int"
INJURIES = "league string, season_start_year int, team string, player_id string, player string, status string, reason string, ruled_out boolean, doubtful boolean, fixture_date date, fetched_at timestamp"
SNAPSHOTS = (
    "content_hash string, fixture_key string, league string, fixture_date date, kickoff_time string, home_team string, away_team string, referee string, "
    "collection_window string, nominal_collected_at timestamp, first_pulled_at_utc timestamp, last_pulled_at_utc timestamp, match_id string, parser_version int"
)
SNAPSHOT_ODDS = "content_hash string, bookmaker string, phase string, market string, selection string, line double, price double"
EVIDENCE = "league string, market string, state string, n bigint, log_loss double, base_rate_log_loss double, slope double, slope_se double, mean_clv double, clv_se double, computed_at timestamp"
