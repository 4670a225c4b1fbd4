"""Domain tables derived from the star-schema tables, as SQL text.

Every view reads whole tables; nothing is filtered away to keep a check cheap.  The same text runs on
Spark and on DuckDB: the few functions the two engines spell differently go through :class:`Dialect`.

Calendar arithmetic (all by key, so the number of games and leagues grows with ``orders``):
one game = 8 consecutive order keys, 16 teams in two halves play 8 games a week for 12 weeks, a season has 96 games,
a league has 16 seasons (2010-2025) = 1536 games.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF_EPOCH = 1706788800          # 2024-02-01T12:00:00Z, the decision time of the slate queries
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Dialect:
    """Spellings that differ between the engines."""

    def __init__(self, name: str):
        self.name = name

    def iso(self, epoch: str) -> str:
        if self.name == "spark":
            return f"date_format(timestamp_seconds({epoch}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        return f"strftime(make_timestamp(CAST({epoch} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


SPARK, DUCK = Dialect("spark"), Dialect("duck")

# Current team codes in schedule order of the synthetic league.
TEAM_CODES = "LV,LAC,LA,JAX,WAS,BUF,MIA,NE,NYJ,KC,DEN,GB,CHI,MIN,DET,SEA"
# Codes used before a relocation or a rename, same order (unchanged teams repeat).
OLD_CODES = "OAK,SD,STL,JAC,WSH,BUF,MIA,NE,NYJ,KC,DEN,GB,CHI,MIN,DET,SEA"
# Full names, same order.
FULL_NAMES = ("Las Vegas Raiders,Los Angeles Chargers,Los Angeles Rams,Jacksonville Jaguars,"
              "Washington Commanders,Buffalo Bills,Miami Dolphins,New England Patriots,New York Jets,"
              "Kansas City Chiefs,Denver Broncos,Green Bay Packers,Chicago Bears,Minnesota Vikings,"
              "Detroit Lions,Seattle Seahawks")


def _div(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}e0) AS BIGINT)"


def _calendar(source: str) -> str:
    """``source`` (with game_id) plus league, season, week, home_no, away_no, by arithmetic alone.

    One small step per subquery: each intermediate is used several times, so it is computed once
    instead of being expanded into every expression above it.
    """
    steps = [
        f"{_div('game_id', 1536)} AS league, game_id % 1536 AS nth",
        "nth / 96e0 AS yr, nth % 96 AS in_season",
        f"CAST(2010 + floor(yr) AS INT) AS season, {_div('in_season', 8)} AS wk, in_season % 8 AS slot",
        "CAST(wk + 1 AS INT) AS week, 8 + (slot + wk) % 8 AS other, (wk + season) % 2 AS flip",
        "CAST(CASE WHEN flip = 0 THEN slot ELSE other END AS INT) AS home_no, CAST(CASE WHEN flip = 0 THEN other ELSE slot END AS INT) AS away_no"]
    for n, step in enumerate(steps):
        source = f"(SELECT *, {step} FROM {source} cal{n})"
    return source


def _code(no: str, names: str = TEAM_CODES) -> str:
    return f"split_part('{names}', ',', CAST({no} + 1 AS INT))"


def _raw_code(no: str) -> str:
    return f"CASE WHEN season < 2017 THEN {_code(no, OLD_CODES)} ELSE {_code(no)} END"


# game key of a quote-like event: 250 events per slate game, slate games are a league's last season
_SLATE_NO = "CAST(floor(event_id / 250e0) AS BIGINT)"
_SLATE_GAME = f"(CAST(floor({_SLATE_NO} / 96e0) AS BIGINT) * 1536 + 1440 + ({_SLATE_NO} % 96))"
_KICK = f"(CASE WHEN game_id % 17 = 3 THEN NULL ELSE {AS_OF_EPOCH} + (game_id % 7) * 2700 - 900 END)"


def view_sql(name: str, d: Dialect) -> str:
    return _VIEWS[name](d)


def _game_keys(d):
    return f"""SELECT {_div('o_orderkey', 8)} AS game_id,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents,
       CAST(sum(o_custkey) AS BIGINT) AS cust,
       sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS pending
FROM orders GROUP BY {_div('o_orderkey', 8)}"""


def _games(d):
    return f"""SELECT game_id, league, season, week, gameday,
  CASE WHEN game_id % 97 = 5 THEN NULL WHEN game_id % 3 = 0 THEN '13:00' WHEN game_id % 3 = 1 THEN '16:25' ELSE '20:20' END AS gametime,
  {_raw_code('home_no')} AS home_raw, {_raw_code('away_no')} AS away_raw,
  {_code('home_no')} AS home_team, {_code('away_no')} AS away_team,
  CASE WHEN pending < 6 THEN home_pts END AS home_score,
  CASE WHEN pending < 6 THEN away_pts END AS away_score,
  CASE WHEN pending < 6 THEN home_pts - away_pts END AS result,
  CASE WHEN pending < 6 THEN home_pts + away_pts END AS total,
  spread_line, total_line,
  CASE WHEN cust % 11 = 0 THEN NULL ELSE -115e0 + 5e0 * (cust % 3) END AS home_spread_odds,
  CASE WHEN cust % 11 = 0 THEN NULL ELSE -105e0 - 5e0 * (cust % 3) END AS away_spread_odds,
  CASE WHEN cents % 13 = 0 THEN NULL ELSE -115e0 + 5e0 * (cents % 3) END AS over_odds,
  CASE WHEN cents % 13 = 0 THEN NULL ELSE -105e0 - 5e0 * (cents % 3) END AS under_odds,
  CASE WHEN cents % 31 = 0 THEN NULL WHEN lean >= 1 THEN -floor(108 + 22 * lean)
       WHEN lean <= -1 THEN floor(100 - 18 * lean) ELSE -110e0 END AS home_moneyline,
  CASE WHEN cents % 31 = 0 THEN NULL WHEN lean >= 1 THEN floor(100 + 18 * lean)
       WHEN lean <= -1 THEN -floor(108 - 22 * lean) ELSE -110e0 END AS away_moneyline,
  CAST(7 + (cust % 5) - 2 AS DOUBLE) AS home_rest, CAST(7 + (cents % 9) - 4 AS DOUBLE) AS away_rest,
  CASE WHEN cust % 41 = 0 THEN NULL ELSE CAST((home_no + away_no) % 4 AS DOUBLE) END AS div_raw,
  CASE WHEN (home_no + away_no) % 4 = 0 THEN 1e0 ELSE 0e0 END AS div_game,
  CASE WHEN home_no % 5 = 0 THEN 'dome' WHEN home_no % 5 = 1 AND cents % 2 = 0 THEN 'closed'
       WHEN home_no % 7 = 3 THEN NULL ELSE 'outdoors' END AS roof,
  CASE WHEN cents % 8 = 0 THEN NULL ELSE CAST(cents % 25 AS DOUBLE) END AS wind,
  CASE WHEN game_id % 61 = 0 THEN 'Neutral' ELSE 'Home' END AS location,
  CASE WHEN game_id % 89 = 1 THEN NULL ELSE concat({_code('home_no')}, '-q', CAST(CASE WHEN cents % 6 = 0 THEN 1 ELSE 0 END AS STRING)) END AS home_qb_id,
  CASE WHEN game_id % 83 = 1 THEN NULL ELSE concat({_code('away_no')}, '-q', CAST(CASE WHEN cust % 6 = 0 THEN 1 ELSE 0 END AS STRING)) END AS away_qb_id,
  concat('Starter ', {_code('home_no')}) AS home_qb_name, concat('Starter ', {_code('away_no')}) AS away_qb_name
FROM (
  SELECT *, CASE WHEN cust % 53 = 0 THEN NULL ELSE floor(2 * (lean + ((cust % 13) - 6) * 0.3e0) + 0.5e0) / 2 END AS spread_line,
    CASE WHEN cust % 59 = 0 THEN NULL ELSE floor(2 * (40 + (cents % 53) * 0.16e0) + 0.5e0) / 2 END AS total_line,
    greatest(0e0, floor((tot + mar) / 2 + 0.5e0)) AS home_pts, greatest(0e0, floor((tot - mar) / 2 + 0.5e0)) AS away_pts
  FROM (
    SELECT *, lean + 78e0 * (((cents % 997) + ({_div('cents', 997)} % 991) + ((cust * 31 + cents) % 983)) / 2971e0 - 0.5e0) AS mar,
      38e0 + (cents % 53) * 0.16e0 + (cust % 47) * 0.17e0 AS tot
    FROM (
      SELECT *, 2e0 + 0.9e0 * (((home_no * 5) % 16) + ((home_no + season) % 3) - ((away_no * 5) % 16) - ((away_no + season) % 3)) AS lean,
        DATE '2010-09-05' + CAST((season - 2010) * 364 + (week - 1) * 7 + (game_id % 3) AS INT) AS gameday
      FROM {_calendar('game_keys')} k0) k1) k2) k3"""


def _plays(d):
    rows = f"""(SELECT *, {_div('l_orderkey', 8)} AS game_id, l_suppkey % 2 = 0 AS at_home,
      concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
        CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS play_id
    FROM lineitem)"""
    return f"""SELECT game_id, league, season, week, play_id,
  CASE WHEN at_home THEN home_raw ELSE away_raw END AS posteam,
  CASE WHEN at_home THEN away_raw ELSE home_raw END AS defteam,
  CASE WHEN l_returnflag = 'A' THEN 'pass' WHEN l_returnflag = 'N' THEN 'run' WHEN l_partkey % 3 = 0 THEN 'pass' ELSE 'punt' END AS play_type,
  CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE
    ((CAST(round(l_extendedprice * 100) AS BIGINT) % 2001) - 1000) / 700e0
    + 0.01e0 * (CASE WHEN at_home THEN (home_no * 5) % 16 ELSE (away_no * 5) % 16 END) END AS epa,
  CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END AS success,
  l_discount * 10 AS wp,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS qb_dropback,
  CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE
    concat(CASE WHEN at_home THEN {_code('home_no')} ELSE {_code('away_no')} END, '-q', CAST(CASE WHEN l_partkey % 6 = 0 THEN 1 ELSE 0 END AS STRING)) END AS passer_player_id,
  concat('Passer ', CAST(l_partkey % 6 AS STRING)) AS passer_player_name,
  CAST(4 - floor((clock - 1) / 900e0) AS INT) AS qtr, l_linenumber % 3 AS drive,
  CAST(clock AS DOUBLE) AS game_seconds_remaining, CAST(clock % 1800 AS DOUBLE) AS half_seconds_remaining,
  (CAST(l_quantity AS BIGINT) % 21) - 10e0 AS score_differential
FROM (SELECT *, {_raw_code('home_no')} AS home_raw, {_raw_code('away_no')} AS away_raw,
        1 + (3599 - (l_partkey * 7 + l_suppkey * 13 + l_linenumber * 411) % 3600) AS clock
  FROM {_calendar(rows)} p1) p2"""


def _quote_parts(d):
    """Quote attributes of an event, before formatting."""
    return f"""SELECT event_id, {_SLATE_GAME} AS game_id, event_type AS book, value,
  CASE event_id % 3 WHEN 0 THEN 'spread' WHEN 1 THEN 'ml' ELSE 'total' END AS market,
  {_div('event_id', 3)} % 2 AS side_no,
  {AS_OF_EPOCH} - (event_id * 7919) % 2400 + (CASE WHEN event_id % 101 = 7 THEN 900 ELSE 0 END) AS quoted_at,
  {_div('event_id', 6)} % 2 AS alt
FROM events"""


def _offers(d):
    return f"""SELECT event_id, game_id, book, CASE WHEN event_id % 211 = 9 THEN 'prop' ELSE market END AS market,
  CASE WHEN market = 'total' THEN (CASE WHEN side_no = 0 THEN 'over' ELSE 'under' END)
       ELSE (CASE WHEN side_no = 0 THEN 'home' ELSE 'away' END) END AS side,
  CASE market WHEN 'ml' THEN NULL
    WHEN 'total' THEN 40 + (game_id % 17) * 0.5e0 + alt * 0.5e0 + (CASE WHEN event_id % 223 = 4 THEN 0.25e0 ELSE 0e0 END)
    ELSE (CASE WHEN side_no = 0 THEN 1e0 ELSE -1e0 END) * ((game_id % 29) * 0.5e0 - 7 + alt * 0.5e0) END AS point,
  CASE WHEN event_id % 97 = 0 THEN 50e0
       WHEN market = 'ml' THEN (CASE WHEN (side_no = 0) = (game_id % 2 = 0) THEN -1e0 ELSE 1e0 END) * (110 + game_id % 90)
            + (CAST(round(value * 100) AS BIGINT) % 7)
       ELSE -118e0 + (CAST(round(value * 100) AS BIGINT) % 15) END AS price,
  CASE WHEN event_id % 5 = 0 THEN 'manual' ELSE 'odds_api' END AS source,
  CASE WHEN event_id % 131 = 2 THEN NULL WHEN event_id % 137 = 2 THEN 'soon' ELSE {d.iso('quoted_at')} END AS odds_time
FROM quote_parts"""


def _slate(d):
    return f"""SELECT game_id, {_KICK} AS kickoff_epoch, {d.iso(_KICK)} AS kickoff_utc
FROM (SELECT DISTINCT {_SLATE_GAME} AS game_id FROM events) s0"""


def _forecasts(d):
    return f"""SELECT game_id, {d.iso('kick')} AS kickoff_utc, market,
  CASE WHEN market = 'total' THEN (CASE WHEN side_no = 0 THEN 'over' ELSE 'under' END)
       ELSE (CASE WHEN side_no = 0 THEN 'home' ELSE 'away' END) END AS side, book,
  CASE market WHEN 'ml' THEN NULL WHEN 'total' THEN 40 + (game_id % 17) * 0.5e0
    ELSE (CASE WHEN side_no = 0 THEN 1e0 ELSE -1e0 END) * ((game_id % 29) * 0.5e0 - 7) END AS point,
  CASE WHEN event_id % 2 = 0 THEN -110e0 ELSE 105e0 END AS price,
  CASE event_id % 4 WHEN 0 THEN 'BET' WHEN 1 THEN 'BET IF CONFIRMED' WHEN 2 THEN 'BET IF PRICE AVAILABLE' ELSE 'NO BET' END AS decision,
  CASE event_id % 4 WHEN 0 THEN 'executable' WHEN 3 THEN 'pass' ELSE 'conditional' END AS tier,
  0.3e0 + (CAST(round(value * 100) AS BIGINT) % 401) / 1013e0 AS model_prob,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE 0.35e0 + ((event_id * 31) % 301) / 1019e0 END AS market_prob,
  ((event_id * 7919) % 1009) / 10000e0 - 0.05e0 AS ev,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE concat('v', CAST(event_id % 2 AS STRING)) END AS model_version,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 8 < 4 END AS is_best_side,
  CASE WHEN game_id % 11 = 5 THEN NULL ELSE concat('run-', CAST(run_no AS STRING)) END AS run_id,
  CASE WHEN game_id % 11 = 5 THEN NULL ELSE {d.iso('kick - lead * 60 - 30')} END AS prediction_completed_utc,
  {d.iso('kick - lead * 60')} AS recorded_utc,
  sha256_hex AS hash
FROM (SELECT *, CAST(floor(lead0 / 15e0) AS BIGINT) AS run_no,
        lead0 + (CASE WHEN game_id % 4 = 1 THEN 23 WHEN game_id % 13 = 2 THEN -120 ELSE 0 END) AS lead
  FROM (SELECT *, (event_id * 7919) % 180 AS lead0,
      {AS_OF_EPOCH} + (game_id % 7) * 2700 - 10000 AS kick,
      {"sha2(CAST(event_id AS STRING), 256)" if d.name == "spark" else "sha256(CAST(event_id AS STRING))"} AS sha256_hex
    FROM quote_parts) f0) f1"""


def _wagers(d):
    """Actual wagers, one per line item."""
    return f"""SELECT play_id AS bet_id, game_id, market, side,
  CASE market WHEN 'ml' THEN NULL WHEN 'total' THEN 38 + (no % 25) * 0.5e0
    ELSE (no % 29) * 0.5e0 - 7 END AS point,
  CASE WHEN no % 2 = 0 THEN -110e0 ELSE 100e0 + (no % 40) END AS price, stake_units, placed_day,
  CASE WHEN no % 43 = 0 THEN 'operator error' END AS voided
FROM (SELECT *, CASE no % 3 WHEN 0 THEN 'spread' WHEN 1 THEN 'ml' ELSE 'total' END AS market,
    CASE WHEN no % 3 = 2 THEN (CASE WHEN l_suppkey % 2 = 0 THEN 'over' ELSE 'under' END)
         ELSE (CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END) END AS side
  FROM (SELECT {_div('l_orderkey', 8)} AS game_id, l_partkey AS no, l_suppkey, l_quantity / 10 AS stake_units,
      CAST(l_shipdate AS DATE) AS placed_day,
      concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
        CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS play_id
    FROM lineitem) w0) w1"""


def _snaps(d):
    rows = f"(SELECT *, {_div('l_orderkey', 8)} AS game_id FROM lineitem)"
    return f"""SELECT league, season, game_id, week, team, pfr_player_id, position,
  sum(l_quantity) AS offense_snaps, least(1e0, sum(l_quantity) / 100) AS offense_pct, least(1e0, sum(l_tax * 100) / 16) AS defense_pct
FROM (SELECT *, {_code('team_no')} AS team, concat({_code('team_no')}, '-p', CAST(l_partkey % 9 AS STRING)) AS pfr_player_id,
    split_part('T,G,C,OT,OG,WR,CB,OL,QB', ',', CAST(l_partkey % 9 + 1 AS INT)) AS position
  FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN home_no ELSE away_no END AS team_no
    FROM {_calendar(rows)} n1) n2) n3
GROUP BY league, season, game_id, week, team, pfr_player_id, position"""


def _injuries(d):
    rows = f"(SELECT *, {_div('o_orderkey', 8)} AS game_id FROM orders)"
    return f"""SELECT o_orderkey AS row_no, league, season,
  CASE WHEN (week + team_no) % 7 = 0 THEN week - 1 ELSE week END AS week, {_code('team_no')} AS team,
  concat({_code('team_no')}, '-g', CAST(o_custkey % 9 AS STRING)) AS gsis_id,
  concat('Player ', CAST(o_custkey AS STRING)) AS full_name,
  split_part('T,G,C,OT,OG,WR,CB,OL,QB', ',', CAST(o_custkey % 9 + 1 AS INT)) AS position,
  CASE WHEN (week + team_no) % 5 = 0 THEN NULL ELSE
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Out' WHEN '2-HIGH' THEN 'Doubtful' WHEN '3-MEDIUM' THEN 'Questionable' END END AS report_status,
  CASE WHEN o_orderstatus = 'P' THEN 'Did Not Participate In Practice' WHEN o_orderstatus = 'F' THEN 'Full Participation in Practice' END AS practice_status,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'Knee' END AS report_primary_injury,
  CASE WHEN o_custkey % 4 = 1 THEN NULL ELSE 'Ankle' END AS practice_primary_injury
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN home_no ELSE away_no END AS team_no
  FROM {_calendar(rows)} j1) j2"""


def _crosswalk(d):
    """Player ids of the injury feed -> ids of the snap feed; later rows win, some ids are missing."""
    return f"""SELECT row_no, gsis_id, CASE WHEN row_no % 10 = 9 THEN NULL ELSE replace(gsis_id, '-g', '-p') END AS pfr_id
FROM injuries"""


def _starter_inputs(d):
    """User-supplied starter confirmations (all text, blanks possible)."""
    k = f"({AS_OF_EPOCH} + (game_id % 7) * 2700 - 900)"
    return f"""SELECT event_id AS row_no, CASE WHEN event_id % 47 = 3 THEN -1 ELSE game_id END AS game_id,
  CASE WHEN event_id % 41 = 0 THEN 'noon' ELSE {d.iso(f"({k} + (event_id % 13) * 60)")} END AS kickoff_utc,
  {_code('(CASE WHEN event_id % 37 = 0 THEN 15 - home_no WHEN side_no = 0 THEN home_no ELSE away_no END)')} AS team,
  CASE WHEN event_id % 29 = 0 THEN ' ' ELSE concat('Starter ', book) END AS qb_name,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE book END AS source,
  {d.iso(f"({AS_OF_EPOCH} - (event_id * 613) % 200000 + (CASE WHEN event_id % 53 = 0 THEN 100000 ELSE 300 END))")} AS confirmed_utc
FROM {_calendar('quote_parts')} u0"""


def _weather_inputs(d):
    k = f"({AS_OF_EPOCH} + (game_id % 7) * 2700 - 900)"
    return f"""SELECT event_id AS row_no, CASE WHEN event_id % 47 = 3 THEN -1 ELSE game_id END AS game_id,
  CASE WHEN event_id % 41 = 0 THEN 'noon' ELSE {d.iso(f"({k} + (event_id % 13) * 60)")} END AS kickoff_utc,
  CASE event_id % 23 WHEN 0 THEN 'calm' WHEN 1 THEN '-3' WHEN 2 THEN '250' WHEN 3 THEN 'NaN' ELSE CAST(event_id % 40 AS STRING) END AS wind_mph,
  CASE event_id % 19 WHEN 0 THEN '400' WHEN 1 THEN 'warm' ELSE CAST(event_id % 90 AS STRING) END AS temp_f,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE book END AS source,
  {d.iso(f"({AS_OF_EPOCH} - 600 - (event_id * 613) % 50000)")} AS forecast_utc,
  {d.iso(f"({AS_OF_EPOCH} - 300 - (event_id * 917) % 9000)")} AS retrieved_utc,
  {d.iso(f"({k} + (event_id * 7) % 14000 - 1000)")} AS valid_for_utc
FROM quote_parts"""


def _feed(d):
    """One feed message per event row: nested JSON text, one bookmaker with two markets."""
    k = f"({AS_OF_EPOCH} + (game_id % 7) * 2700 - 900)"
    home, away = _code("home_no", FULL_NAMES), _code("away_no", FULL_NAMES)
    return f"""SELECT event_id, league, concat('{{"home_team":"', {home}, '","away_team":"', {away},
  '","commence_time":"', CASE WHEN event_id % 61 = 0 THEN 'tbd' ELSE {d.iso(f"({k} + (event_id * 911) % 30000)")} END,
  '","bookmakers":[{{"key":"', book, '","last_update":"', {d.iso('quoted_at')},
  '","markets":[{{"key":"h2h","last_update":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE concat('"', {d.iso('quoted_at + 5')}, '"') END,
  ',"outcomes":[{{"name":"', {home}, '","price":', CAST(100 + event_id % 60 AS STRING), '}},{{"name":"', {away}, '","price":-', CAST(110 + event_id % 60 AS STRING),
  '}}]}},{{"key":"', CASE event_id % 4 WHEN 0 THEN 'spreads' WHEN 1 THEN 'totals' WHEN 2 THEN 'totals' ELSE 'outrights' END,
  '","outcomes":[{{"name":"', CASE event_id % 4 WHEN 0 THEN {home} ELSE 'Over' END, '","price":-110,"point":', CAST(event_id % 9 AS STRING),
  '.5}},{{"name":"', CASE event_id % 4 WHEN 0 THEN {away} ELSE 'Under' END, '","price":-108,"point":', CASE event_id % 4 WHEN 0 THEN '-' ELSE '' END, CAST(event_id % 9 AS STRING), '.5}}]}}]}}]}}') AS payload
FROM {_calendar('quote_parts')} e0"""


def _scored(d):
    """Probabilities and outcomes over labelled documents."""
    return """SELECT d.doc_id, d.source AS cluster, d.lang AS grp, ((n_chars * 37) % 1001) / 1000e0 AS p_model,
  CASE WHEN n_chars % 23 = 0 THEN NULL ELSE ((n_chars * 17 + d.doc_id) % 1001) / 1000e0 END AS p_market,
  CAST(quality AS DOUBLE) AS y
FROM documents d JOIN labels b ON d.doc_id = b.doc_id"""


def _preds(d):
    """Stand-in predictions per game for the metric queries."""
    def prob(a, b):
        return f"(200 + (game_id * {a} + {b}) % 601) / 1013e0"
    return f"""SELECT game_id, league, season, week, gameday, result, total, spread_line, total_line, home_score, away_score,
  {prob(37, 5)} AS p_model, CASE WHEN home_moneyline IS NOT NULL THEN {prob(53, 11)} END AS p_market,
  {prob(71, 3)} AS p_ratings_only, 0.55e0 AS p_home_rate,
  CASE WHEN spread_line IS NOT NULL THEN {prob(91, 17)} END AS p_cover, CASE WHEN home_spread_odds IS NOT NULL THEN {prob(29, 1)} END AS p_cover_mkt,
  CASE WHEN total_line IS NOT NULL THEN {prob(83, 9)} END AS p_over, CASE WHEN over_odds IS NOT NULL THEN {prob(67, 2)} END AS p_over_mkt,
  coalesce(spread_line, 0e0) + ((game_id * 7) % 21 - 10) * 0.37e0 AS model_margin,
  coalesce(spread_line, 0e0) + ((game_id * 7) % 21 - 10) * 0.09e0 AS fair_margin,
  coalesce(total_line, 44e0) + ((game_id * 5) % 19 - 9) * 0.4e0 AS model_total
FROM games"""


_VIEWS = {"game_keys": _game_keys, "games": _games, "plays": _plays, "quote_parts": _quote_parts,
          "offers": _offers, "slate": _slate, "forecasts": _forecasts, "wagers": _wagers, "snaps": _snaps,
          "injuries": _injuries, "crosswalk": _crosswalk, "starter_inputs": _starter_inputs,
          "weather_inputs": _weather_inputs, "feed": _feed, "scored": _scored, "preds": _preds}
_DEPS = {"games": ["game_keys"], "offers": ["quote_parts"], "forecasts": ["quote_parts"],
         "starter_inputs": ["quote_parts"], "weather_inputs": ["quote_parts"], "feed": ["quote_parts"],
         "crosswalk": ["injuries"], "preds": ["games"]}


def with_clause(names: list[str], d: Dialect = DUCK) -> str:
    """``WITH ...`` prefix that defines the named views and what they need."""
    order: list[str] = []

    def add(n):
        for dep in _DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{view_sql(n, d)}\n)" for n in order)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame over the parquet files of ``sf_dir``."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = f"{with_clause([name], SPARK)}\nSELECT * FROM {name}"
    used = [t for t in BASE_TABLES if re.search(rf"\bFROM {t}\b|\bJOIN {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)
