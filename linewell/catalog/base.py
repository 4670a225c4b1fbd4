"""Shared pieces of the query catalogue: domain frames, rounding, oracle fragments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewell.config import Settings
from linewell.functions.joins import bounded_tasks, configure
from linewell.sources import views

SETTINGS = Settings()
NOW_EPOCH = views.AS_OF_EPOCH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_tasks(configure(spark))
    return views.frame(spark, sf_dir, name)


def now() -> Column:
    return F.timestamp_seconds(F.lit(NOW_EPOCH))


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def kickoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "slate").select("game_id", F.timestamp_seconds("kickoff_epoch").alias("kickoff"))


def slate_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slate games with their teams and decision-time kickoffs."""
    g = table(spark, sf_dir, "games").select("game_id", "league", "season", "week", "home_team", "away_team")
    return kickoffs(spark, sf_dir).join(g, "game_id")


def checked_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewell.operators import validity
    return validity.check_quotes(table(spark, sf_dir, "offers"), kickoffs(spark, sf_dir), now(), SETTINGS)


def valid_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linewell.operators import validity
    return validity.valid_quotes(checked_quotes(spark, sf_dir))


def oracle(names: list[str], body: str, ctes: str = "") -> str:
    """An oracle query: domain views, further CTEs, then the body."""
    head = views.with_clause(names)
    return head + (",\n" + ctes.strip().rstrip(",") if ctes else "") + "\n" + body


def epoch(text: str) -> str:
    """DuckDB: epoch seconds of Z-suffixed ISO text, null if unusable."""
    return f"CAST(epoch(try_strptime({text}, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT)"


def duck_iso(e: str) -> str:
    return views.DUCK.iso(e)


def duck_implied(p: str) -> str:
    return f"(CASE WHEN {p} < 0 THEN -{p} / (100 - {p}) ELSE 100 / ({p} + 100) END)"


def duck_decimal(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN 1 + {p} / 100 WHEN {p} < 0 THEN 1 + 100 / abs({p}) END)"


def duck_cdf(x: str) -> str:
    """The normal distribution with the error function's fixed approximation."""
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    poly = f"(((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(0.5 * (1 + sign({x}) * (1 - {poly} * exp(-({x}) * ({x}) / 2))))"


CHECKED = f"""checked AS (
  SELECT *, CASE WHEN k IS NULL THEN 'game not in slate or kickoff unknown'
    WHEN NOT ((market IN ('spread', 'ml') AND side IN ('home', 'away')) OR (market = 'total' AND side IN ('over', 'under')))
      THEN concat('invalid market/side ', market, '/', side)
    WHEN abs(price) < 100 THEN concat('invalid price ', CAST(price AS VARCHAR))
    WHEN market <> 'ml' AND NOT (abs(point * 2 - round_even(point * 2, 0)) <= 1e-9 AND CASE WHEN market = 'total' THEN point > 0 ELSE abs(point) < 60 END)
      THEN concat('invalid point ', CAST(point AS VARCHAR))
    WHEN odds_time IS NULL THEN 'odds timestamp: missing timestamp'
    WHEN t IS NULL THEN concat('odds timestamp: unusable timestamp ', odds_time)
    WHEN t > {NOW_EPOCH} + 120 THEN concat('odds timestamp ', odds_time, ' is in the future')
    WHEN {NOW_EPOCH} - t > 1800 THEN concat('stale: quoted ', odds_time, ', older than 30 min')
    WHEN t >= k OR {NOW_EPOCH} >= k THEN concat('at/after kickoff ', {duck_iso('k')})
    ELSE '' END AS reject_reason
  FROM (SELECT o.*, s.kickoff_epoch AS k, {epoch('odds_time')} AS t FROM offers o LEFT JOIN slate s ON o.game_id = s.game_id) c0),
valid AS (SELECT * FROM checked WHERE reject_reason = ''),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, book, market, side, point ORDER BY t DESC, price DESC, event_id DESC) AS rn FROM valid) l0 WHERE rn = 1),
pairs AS (
  SELECT a.game_id, a.market, a.book, CASE a.market WHEN 'ml' THEN NULL WHEN 'spread' THEN 0 - a.point ELSE a.point END AS line,
    {duck_implied('a.price')} / ({duck_implied('a.price')} + {duck_implied('b.price')}) AS p,
    {duck_implied('a.price')} + {duck_implied('b.price')} - 1 AS overround, greatest(a.t, b.t) AS newest, least(a.t, b.t) AS oldest,
    a.price AS first_price, b.price AS second_price, a.t AS first_time, b.t AS second_time
  FROM latest a JOIN latest b ON a.game_id = b.game_id AND a.book = b.book AND a.market = b.market
    AND a.side IN ('home', 'over') AND b.side IN ('away', 'under')
    AND (a.market = 'ml' OR (a.market = 'spread' AND b.point = -a.point) OR (a.market = 'total' AND b.point = a.point))
  WHERE abs(a.t - b.t) <= 300)"""
QUOTE_VIEWS = ["offers", "slate"]
