"""Structured Streaming operators, run over all available input."""
from __future__ import annotations

from pyspark.sql import functions as F

from linewell.catalog import base as b
from linewell.catalog import rating_oracle as ro
from linewell.catalog.quotes import C, Q, iso
from linewell.functions import prices, times
from linewell.operators import plays
from linewell.streaming import quotes as sq
from linewell.streaming import stateful
from linewell.streaming.sinks import drain, new_folder, replay, split_late

S = b.SETTINGS


def _checked(spark, sf):
    k = b.kickoffs(spark, sf)
    return sq.validate(sq.event_stream(spark, sf), k, b.now(), S)


def _valid(spark, sf):
    return _checked(spark, sf).filter("reject_reason = ''")


def stream_validate(spark, sf):
    good, bad = sq.split_sinks(_checked(spark, sf))
    return (good.select("event_id", F.lit("").alias("reason")).unionByName(bad.select("event_id", F.col("reject_reason").alias("reason"))))


def _replayed(spark, sf, ahead_minutes=None):
    """Valid quotes in four micro-batches by arrival, then the clock ``ahead_minutes`` after now."""
    clock = None if ahead_minutes is None else ("odds_time_utc", F.timestamp_millis(F.lit((b.NOW_EPOCH + ahead_minutes * 60) * 1000 + 500)))
    return replay(b.valid_quotes(spark, sf), F.col("event_id").asc(), 4, "arrivals", clock)


def stream_pairs(spark, sf):
    """Matches while quotes come in; the clock moves on until sides without a match have come out too."""
    p = sq.current_pairs(drain(sq.pair_matches(_replayed(spark, sf, 60)), "pairs"))
    return p.select("game_id", "market", "book", "line", b.r6(prices.no_vig(F.col("first_price"), F.col("second_price"))).alias("p"),
                    times.iso(F.greatest("first_time", "second_time")).alias("newest_utc"))


def _windows(spark, sf, kind):
    w = drain(sq.quote_windows(_valid(spark, sf), kind), f"windows-{kind}", "complete")
    return w.select(times.iso(F.col("start")).alias("start_utc"), times.iso(F.col("end")).alias("end_utc"), "market", "quotes", "books", "low", "high")


def stream_windows(spark, sf):
    return _windows(spark, sf, "tumbling")


def stream_sliding_windows(spark, sf):
    return _windows(spark, sf, "sliding")


def stream_sessions(spark, sf):
    return _windows(spark, sf, "session")


def stream_dedup(spark, sf):
    """Every forecast arrives twice; the archive keeps it once."""
    b.table(spark, sf, "slate")
    f = sq.event_stream(spark, sf, "forecasts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    f = sq.with_event_time(f, "recorded_utc")
    return drain(sq.archive_once(f, ["hash"], "event_time"), "archive").select("hash", "game_id", "recorded_utc")


def stream_state(spark, sf):
    """Latest live quote per key from keyed state."""
    u = drain(stateful.latest_with_expiry(_valid(spark, sf), S.max_odds_age_minutes), "latest", "update")
    return stateful.standing(u).filter("live").select("game_id", "book", "market", "side", "event_id", "price")


def stream_expiry(spark, sf):
    """Live and withdrawn quotes once the clock has moved 40 minutes on: the watermark, 32 minutes behind it, fires the timers of quotes older than 30 minutes."""
    u = drain(stateful.latest_with_expiry(_replayed(spark, sf, 40), S.max_odds_age_minutes), "expiry", "update")
    return stateful.standing(u).select("game_id", "book", "market", "side", "event_id", "price", "live")


def stream_late_rows(spark, sf):
    """Quotes that arrive more than ten minutes behind the newest of the batches ahead of theirs, beside those in time."""
    good, late = split_late(_replayed(spark, sf), "odds_time_utc", 10)
    good = good.select("event_id", F.lit(False).alias("late"), F.lit(None).cast("string").alias("watermark_utc"))
    return good.unionByName(late.select("event_id", F.lit(True).alias("late"), times.iso(F.col("watermark")).alias("watermark_utc")))


def stream_ratings(spark, sf):
    p = b.table(spark, sf, "plays")
    d = stateful.rating_rows(b.table(spark, sf, "games"), plays.team_games(p), plays.passer_games(p))
    s = stateful.file_stream(spark, d, new_folder(spark, "rating-input"))
    return drain(stateful.rating_updates(s), "rating-updates").select("game_id", *[F.round(F.col(n) + 1e-9, 6).alias(n) for n in ("f_mrtg", "f_epa", "f_pass", "f_qb", "t_pts")])


QUERIES = {f.__name__: f for f in (stream_validate, stream_pairs, stream_windows, stream_sliding_windows, stream_sessions, stream_dedup, stream_state, stream_expiry, stream_late_rows, stream_ratings)}


def _stream_ratings_sql():
    return ro.recursive(b.oracle(["games", "plays"], """SELECT g.game_id, round(f_mrtg + 1e-9, 6) AS f_mrtg, round(f_epa + 1e-9, 6) AS f_epa, round(f_pass + 1e-9, 6) AS f_pass, round(coalesce(f_qb, 0) + 1e-9, 6) AS f_qb, round(t_pts + 1e-9, 6) AS t_pts
FROM games g JOIN ftr ON ftr.game_id = g.game_id LEFT JOIN dl ON dl.game_id = g.game_id""", ro.TEAMS + ",\n" + ro.PASSERS))


def _win(width, shift_count):
    return f"""SELECT {iso('s')} AS start_utc, {iso(f's + {width}')} AS end_utc, market, count(*) AS quotes, count(DISTINCT book) AS books, min(price) AS low, max(price) AS high
FROM (SELECT *, CAST(floor(t / 300e0) AS BIGINT) * 300 - 300 * o AS s FROM valid, (SELECT unnest(range({shift_count})) AS o) r) z GROUP BY s, market"""


ORACLES = {
    "stream_ratings": _stream_ratings_sql(),
    "stream_validate": b.oracle(Q, "SELECT event_id, reject_reason AS reason FROM checked", C),
    "stream_pairs": b.oracle(Q, f"SELECT game_id, market, book, line, round(p, 6) AS p, {iso('newest')} AS newest_utc FROM pairs", C),
    "stream_windows": b.oracle(Q, _win(300, 1), C),
    "stream_sliding_windows": b.oracle(Q, _win(600, 2), C),
    "stream_sessions": b.oracle(Q, f"""SELECT {iso('min(t)')} AS start_utc, {iso('max(t) + 5')} AS end_utc, market, count(*) AS quotes, count(DISTINCT book) AS books, min(price) AS low, max(price) AS high
FROM (SELECT *, sum(brk) OVER (PARTITION BY market ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY market ORDER BY t, event_id) < 5 THEN 0 ELSE 1 END AS brk FROM valid) x) z GROUP BY market, sid""", C),
    "stream_dedup": b.oracle(["forecasts"], "SELECT hash, game_id, recorded_utc FROM forecasts"),
    "stream_state": b.oracle(Q, "SELECT game_id, book, market, side, event_id, price FROM latest", C),
    "stream_expiry": b.oracle(Q, f"SELECT game_id, book, market, side, event_id, price, t + 1800 >= {b.NOW_EPOCH} + 2400.5 - 1920 AS live FROM latest", C),
    "stream_late_rows": b.oracle(Q, f"""SELECT event_id, coalesce(t < mark, false) AS late, CASE WHEN t < mark THEN {iso('mark')} END AS watermark_utc
FROM (SELECT a.event_id, a.t, CAST((SELECT max(z.t) FROM arr z WHERE z.part < a.part) - 600 AS BIGINT) AS mark FROM arr a) y""",
                                 C + ",\narr AS (SELECT event_id, t, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) * 4 / (SELECT count(*) FROM valid)) AS INTEGER) AS part FROM valid)"),
}
