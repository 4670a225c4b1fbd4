"""Explicit schemas of every source; nothing is inferred at read time."""
from __future__ import annotations

from pyspark.sql import types as T

_T = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BooleanType(), "t": T.DateType()}


def struct(**cols: str) -> T.StructType:
    return T.StructType([T.StructField(n.replace("__", " "), _T[t]) for n, t in cols.items()])


def texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names of the files users of these tables already have.
GAMES = struct(game_id="s", season="i", game_type="s", week="i", gameday="s", weekday="s", gametime="s", away_team="s", away_score="d",
               home_team="s", home_score="d", location="s", result="d", total="d", overtime="d", old_game_id="s", gsis="s", nfl_detail_id="s",
               pfr="s", pff="s", espn="s", ftn="s", away_rest="d", home_rest="d", away_moneyline="d", home_moneyline="d", spread_line="d",
               away_spread_odds="d", home_spread_odds="d", total_line="d", under_odds="d", over_odds="d", div_game="d", roof="s", surface="s",
               temp="d", wind="d", away_qb_id="s", home_qb_id="s", away_qb_name="s", home_qb_name="s", away_coach="s", home_coach="s",
               referee="s", stadium_id="s", stadium="s")
PLAYS = struct(game_id="s", season="i", week="i", posteam="s", defteam="s", play_type="s", epa="d", success="d", wp="d", qb_dropback="d",
               passer_player_id="s", passer_player_name="s", qtr="d", drive="d", game_seconds_remaining="d", half_seconds_remaining="d", score_differential="d")
INJURIES = struct(season="i", team="s", week="i", gsis_id="s", full_name="s", position="s", report_status="s", practice_status="s",
                  report_primary_injury="s", practice_primary_injury="s")
SNAPS = struct(game_id="s", season="i", week="i", team="s", pfr_player_id="s", position="s", offense_snaps="d", offense_pct="d", defense_pct="d")
PLAYERS = struct(gsis_id="s", pfr_id="s")
MANUAL_QUOTES = ("game_id", "kickoff_utc", "book", "market", "side", "point", "price", "odds_time_utc")
STARTERS = ("game_id", "kickoff_utc", "team", "qb_name", "source", "confirmed_utc")
WEATHER = ("game_id", "kickoff_utc", "wind_mph", "temp_f", "source", "forecast_utc", "retrieved_utc", "valid_for_utc")
QUOTES = struct(game_id="s", book="s", market="s", side="s", point="d", price="d", source="s", odds_time="s")

FORECAST = struct(game_id="s", kickoff_utc="s", season="i", week="i", away_team="s", home_team="s", market="s", side="s", team="s", book="s",
                  point="d", price="d", price_source="s", odds_time="s", reference="s", reference_live="b", reference_books="s", reference_excluded="s",
                  reference_oldest_utc="s", reference_provenance="s", p_win="d", p_push="d", model_prob="d", implied="d", market_prob="d", ev="d")
FORECAST = T.StructType(FORECAST.fields + [T.StructField(n, _T[k]) for n, k in (
    ("ev[fair 0.5 worse]", "d"), ("ev[market only]", "d"), ("min_price", "d"), ("decision", "s"), ("stake_units", "d"), ("reasons", "s"), ("is_best_side", "b"))])
FORECAST_FIELDS = list(FORECAST.names)
# with run columns and columns of older records (permissive superset)
FORECAST_DATA = T.StructType(FORECAST.fields + struct(tier="s", run_id="s", run_utc="s", prediction_completed_utc="s", model_version="s", legacy="b").fields)


def log_record(data: T.StructType) -> T.StructType:
    """One line of a hash-chained log."""
    return (T.StructType().add("seq", "long").add("recorded_utc", "string").add("kind", "string").add("data", data)
            .add("prev", "string").add("hash", "string"))
