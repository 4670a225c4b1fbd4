"""Quotes: validity, latest, pairs, references, feed parsing, inputs."""
from __future__ import annotations

from pyspark.sql import functions as F

from linewell.catalog import base as b
from linewell.functions import times
from linewell.functions.joins import materialise
from linewell.operators import quotes, references, validity
from linewell.sources import feed

S = b.SETTINGS
LATER_MINUTES = 8      # completion time of the repricing queries: minutes after collection


def quotes_valid(spark, sf):
    v = b.valid_quotes(spark, sf)
    return v.select("event_id", "game_id", "book", "market", "side", "point", "price", "source", times.iso(F.col("odds_time_utc")).alias("quoted_utc"))


def quotes_rejected(spark, sf):
    return validity.rejected_quotes(b.checked_quotes(spark, sf)).select("event_id", "game_id", "reject_reason")


def quotes_reject_reasons(spark, sf):
    return validity.reject_counts(b.checked_quotes(spark, sf))


def quotes_latest(spark, sf):
    return quotes.latest_quotes(b.valid_quotes(spark, sf)).select(
        "game_id", "book", "market", "side", "point", "price", times.iso(F.col("odds_time_utc")).alias("quoted_utc"))


def quotes_pairs_novig(spark, sf):
    p = quotes.quote_pairs(b.valid_quotes(spark, sf))
    return p.select("game_id", "market", "book", "line", b.r6("p").alias("p"), b.r6("overround").alias("overround"),
                    times.iso(F.col("newest")).alias("newest_utc"), times.iso(F.col("oldest")).alias("oldest_utc"),
                    "first_price", "second_price")


def _references(spark, sf, markets):
    cells = materialise(quotes.quote_cells(b.valid_quotes(spark, sf).filter(F.col("market").isin(*markets))), "cells")
    return references.build_references(quotes.pairs_of(cells), S.min_reference_books, quoted=cells)


def reference_ml_loo(spark, sf):
    r = _references(spark, sf, ["ml"])
    return r.select("game_id", F.coalesce("excluded", F.lit("-")).alias("excluded"), "n_books", "books", b.r6("p").alias("p"),
                    b.r6("spread_of_books").alias("spread_of_books"), times.iso(F.col("oldest")).alias("oldest_utc"), times.iso(F.col("newest")).alias("newest_utc"))


def reference_lines_loo(spark, sf):
    r = _references(spark, sf, ["spread", "total"])
    return r.select("game_id", "market", F.coalesce("excluded", F.lit("-")).alias("excluded"), "n_books", "books", "line",
                    times.iso(F.col("oldest")).alias("oldest_utc"), times.iso(F.col("newest")).alias("newest_utc"))


def reference_mu(spark, sf):
    cells = materialise(quotes.quote_cells(b.valid_quotes(spark, sf)), "cells")
    pairs = references.with_implied_mean(references.flat_distributions(quotes.pairs_of(cells)))
    refs = references.build_references(pairs.drop("sd", "weights"), S.min_reference_books, quoted=cells)
    refs = references.with_line_probability(references.flat_distributions(refs))
    return refs.select("game_id", "market", F.coalesce("excluded", F.lit("-")).alias("excluded"), "n_books", "line",
                       b.r6("mu").alias("mu"), b.r6("p").alias("p"), b.r6("spread_of_books").alias("spread_of_books"))


def reference_provenance(spark, sf):
    p = quotes.quote_pairs(b.valid_quotes(spark, sf))
    ex = references.exclusions(p).filter(F.col("n_books") >= S.min_reference_books)
    return references.provenance(p, ex).select("game_id", "market", F.coalesce("excluded", F.lit("-")).alias("excluded"), "provenance")


def reference_per_offer(spark, sf):
    """Each latest quote with its own leave-one-book-out line; the schedule line where there is none."""
    v = b.valid_quotes(spark, sf)
    cells = materialise(quotes.quote_cells(v), "cells")
    refs = references.build_references(quotes.pairs_of(cells), S.min_reference_books, quoted=cells)
    games = b.table(spark, sf, "games").select("game_id", "spread_line", "total_line")
    o = references.attach_reference(quotes.latest_quotes(v), refs)
    o = o.join(games, "game_id")
    fallback = F.when(F.col("market") == "spread", F.col("spread_line")).when(F.col("market") == "total", F.col("total_line"))
    return o.select("game_id", "book", "market", "side", "point", F.coalesce("ref_line", fallback).alias("line"),
                    F.col("ref_n_books").isNotNull().alias("live"))


def live_over_schedule_lines(spark, sf):
    v = b.valid_quotes(spark, sf)
    refs = references.build_references(quotes.quote_pairs(v), S.min_reference_books)
    g = b.table(spark, sf, "games").select("game_id", "spread_line", "total_line")
    return references.live_lines(g, refs).select("game_id", "spread_line", "total_line", "reference_kind")


def feed_readiness(spark, sf):
    return quotes.reference_ready(b.valid_quotes(spark, sf), S.min_reference_books)


def feed_statistics(spark, sf):
    f = quotes.feed_summary(b.checked_quotes(spark, sf), b.now())
    return f.select("valid_quotes", "rejected_quotes", "books", "games_with_quotes",
                    *[b.r6(c).alias(c) for c in ("age_min", "age_median", "age_max")])


def _later(spark, sf):
    return validity.valid_quotes(validity.check_quotes(
        b.table(spark, sf, "offers"), b.kickoffs(spark, sf), F.timestamp_seconds(F.lit(b.NOW_EPOCH + LATER_MINUTES * 60)), S))


def expired_quotes(spark, sf):
    return quotes.expired_quotes(b.valid_quotes(spark, sf), _later(spark, sf))


def collection_run(spark, sf):
    return quotes.collection_summary(b.checked_quotes(spark, sf), b.slate_games(spark, sf), b.table(spark, sf, "injuries"))


def feed_flatten(spark, sf):
    f = feed.flatten_feed(feed.parse_feed(b.table(spark, sf, "feed")))
    return f.select("event_id", "home_team", "away_team", times.iso(F.col("commence")).alias("commence_utc"),
                    "book", "market", "side", "point", "price", "odds_time")


def feed_match_kickoff(spark, sf):
    g = b.slate_games(spark, sf).filter(F.col("kickoff").isNotNull())
    m = feed.flatten_feed(feed.match_games(feed.parse_feed(b.table(spark, sf, "feed")), g)).withColumn("source", F.lit("odds_api"))
    return m.select("event_id", "game_id", "book", "market", "side", "point", "price", "source", "odds_time")


def key_check(spark, sf):
    rows = b.table(spark, sf, "starter_inputs").select("row_no", "game_id", "kickoff_utc")
    return validity.check_game_keys(rows, b.kickoffs(spark, sf), S.kickoff_match_minutes).select("row_no", "game_id", "reason")


def _starters(spark, sf):
    return validity.check_starter_inputs(b.table(spark, sf, "starter_inputs"), b.slate_games(spark, sf), b.now(), S)


def _weather(spark, sf):
    return validity.check_weather_inputs(b.table(spark, sf, "weather_inputs"), b.kickoffs(spark, sf), b.now(), S)


def starter_inputs_validated(spark, sf):
    return _starters(spark, sf).select("row_no", "game_id", "team", "reason")


def forecast_inputs_validated(spark, sf):
    return _weather(spark, sf).select("row_no", "game_id", b.r6("wind").alias("wind"), "reason")


def inputs_rejected(spark, sf):
    r = validity.rejected_inputs(("starters", _starters(spark, sf)), ("weather", _weather(spark, sf)))
    return r.groupBy("file", F.substring_index("reason", " ", 2).alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    quotes_valid, quotes_rejected, quotes_reject_reasons, quotes_latest, quotes_pairs_novig, reference_ml_loo,
    reference_lines_loo, reference_mu, reference_provenance, reference_per_offer, live_over_schedule_lines,
    feed_readiness, feed_statistics, expired_quotes, collection_run, feed_flatten, feed_match_kickoff, key_check,
    starter_inputs_validated, forecast_inputs_validated, inputs_rejected)}

# ---------------------------------------------------------------- oracles

Q, C, iso = b.QUOTE_VIEWS, b.CHECKED, b.duck_iso
LOO = """excl AS (
  SELECT DISTINCT game_id, market, book AS excluded FROM valid
  UNION ALL SELECT DISTINCT game_id, market, NULL FROM pairs),
kept AS (
  SELECT e.game_id, e.market, e.excluded, p.book, p.line, p.p, p.newest, p.oldest, p.first_time
  FROM excl e JOIN pairs p ON e.game_id = p.game_id AND e.market = p.market AND (e.excluded IS NULL OR p.book <> e.excluded)),
meds AS (SELECT game_id, market, excluded, quantile_cont(line, 0.5) AS med FROM kept GROUP BY ALL HAVING count(DISTINCT book) >= 2),
chosen AS (
  SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.game_id, k.market, k.excluded, k.book ORDER BY abs(k.line - m.med), k.first_time, k.line) AS rn
    FROM kept k JOIN meds m ON k.game_id = m.game_id AND k.market = m.market AND k.excluded IS NOT DISTINCT FROM m.excluded) c1 WHERE rn = 1)"""
REFS = f"""refs AS (
  SELECT game_id, market, excluded, count(*) AS n_books, string_agg(book, ',' ORDER BY book) AS books,
    CASE WHEN market <> 'ml' THEN round_even(quantile_cont(line, 0.5) * 2, 0) / 2 END AS line,
    CASE WHEN market = 'ml' THEN 1 / (1 + exp(-quantile_cont(ln(p / (1 - p)), 0.5))) END AS p,
    max(p) - min(p) AS spread_of_books, min(oldest) AS oldest, max(newest) AS newest
  FROM chosen GROUP BY game_id, market, excluded)"""



def _over(mu: str, line: str) -> str:
    """P(above the line | not on it) of a normal on the integers: sums over outcomes telescope to four values of its distribution."""
    def upto(edge: str) -> str:
        return b.duck_cdf(f"(({edge} - {mu}) / sd)")
    above, below = f"({upto('hi + 0.5')} - {upto(f'floor({line}) + 0.5')})", f"({upto(f'ceil({line}) - 0.5')} - {upto('lo - 0.5')})"
    return f"({above} / ({above} + {below}))"


MEANS = f"""shape(market, lo, hi, sd, a, b) AS (VALUES ('spread', -80, 80, 13e0, -60e0, 60e0), ('total', 0, 130, 13.5e0, 5e0, 125e0)),
halved AS (SELECT c.market, c.line, c.p, 0 AS step, s.a, s.b FROM (SELECT DISTINCT market, line, p FROM chosen WHERE market <> 'ml') c JOIN shape s ON s.market = c.market
  UNION ALL SELECT market, line, p, step + 1, CASE WHEN low THEN mid ELSE a END, CASE WHEN low THEN b ELSE mid END
  FROM (SELECT h.market, line, p, step, h.a, h.b, (h.a + h.b) / 2 AS mid, {_over('((h.a + h.b) / 2)', 'line')} < least(greatest(p, 1e-4), 1 - 1e-4) AS low FROM halved h JOIN shape s ON s.market = h.market WHERE step < 50) z),
means AS (SELECT c.game_id, c.market, c.excluded, quantile_cont((h.a + h.b) / 2, 0.5) AS mu, max((h.a + h.b) / 2) - min((h.a + h.b) / 2) AS apart
  FROM chosen c JOIN halved h ON h.market = c.market AND h.line = c.line AND h.p = c.p AND h.step = 50 GROUP BY c.game_id, c.market, c.excluded)"""


def _side(point: str, price: str, names: tuple[str, str], time: str) -> str:
    name = f"CASE c.market WHEN 'total' THEN '{names[1]}' ELSE '{names[0]}' END"
    return f"""concat('{{', CASE WHEN c.line IS NOT NULL THEN concat('"point":', {point}, ',') ELSE '' END, '"price":', {price}, ',"side":"', {name}, '","time_utc":"', {iso(time)}, '"}}')"""


PROVENANCE = f"""SELECT c.game_id, c.market, coalesce(c.excluded, '-') AS excluded, concat('{{"books":["', string_agg(c.book, '","' ORDER BY c.book), '"]', CASE WHEN c.excluded IS NOT NULL THEN concat(',"excluded_book":"', c.excluded, '"') ELSE '' END,
  ',"market":"', c.market, '","quotes":[', string_agg(concat('{{"book":"', c.book, '"', CASE WHEN c.line IS NOT NULL THEN concat(',"line":', c.line) ELSE '' END, ',"sides":[',
    {_side("CASE c.market WHEN 'spread' THEN -c.line ELSE c.line END", 'p.first_price', ('home', 'over'), 'p.first_time')}, ',', {_side('c.line', 'p.second_price', ('away', 'under'), 'p.second_time')}, ']}}'), ',' ORDER BY c.book), ']}}') AS provenance
FROM chosen c JOIN pairs p ON p.game_id = c.game_id AND p.market = c.market AND p.book = c.book AND p.line IS NOT DISTINCT FROM c.line
WHERE c.excluded IS NULL OR EXISTS (SELECT 1 FROM pairs x WHERE x.game_id = c.game_id AND x.market = c.market AND x.book = c.excluded) GROUP BY c.game_id, c.market, c.excluded"""

# feed: names to codes as a value list
from linewell.sources.views import FULL_NAMES, TEAM_CODES  # noqa: E402

_NAMES = ", ".join(f"('{n}', '{c}')" for n, c in zip(FULL_NAMES.split(","), TEAM_CODES.split(",")))
FLAT = f"""names(full_name, code) AS (VALUES {_NAMES}),
parsed AS (SELECT event_id, league, from_json(payload, '{{"home_team":"VARCHAR","away_team":"VARCHAR","commence_time":"VARCHAR","bookmakers":[{{"key":"VARCHAR","last_update":"VARCHAR","markets":[{{"key":"VARCHAR","last_update":"VARCHAR","outcomes":[{{"name":"VARCHAR","price":"DOUBLE","point":"DOUBLE"}}]}}]}}]}}') AS j FROM feed),
books AS (SELECT event_id, league, j.home_team AS home_full, j.away_team AS away_full, {b.epoch('j.commence_time')} AS commence, unnest(j.bookmakers) AS bk FROM parsed),
mks AS (SELECT *, unnest(bk.markets) AS mk FROM books),
ocs AS (SELECT *, unnest(mk.outcomes) AS oc FROM mks WHERE mk.key IN ('h2h', 'spreads', 'totals')),
flat AS (SELECT event_id, league, h.code AS home_team, a.code AS away_team, commence, bk.key AS book,
    CASE mk.key WHEN 'h2h' THEN 'ml' WHEN 'spreads' THEN 'spread' ELSE 'total' END AS market,
    CASE WHEN mk.key = 'totals' THEN lower(oc.name) WHEN oc.name = home_full THEN 'home' ELSE 'away' END AS side,
    oc.point AS point, oc.price AS price, coalesce(mk.last_update, bk.last_update) AS odds_time
  FROM ocs LEFT JOIN names h ON h.full_name = home_full LEFT JOIN names a ON a.full_name = away_full WHERE commence IS NOT NULL)"""

SLATE_GAMES = """slate_games AS (SELECT s.game_id, s.kickoff_epoch AS k, g.league, g.season, g.week, g.home_team, g.away_team
  FROM slate s JOIN games g ON s.game_id = g.game_id)"""


def _key_reason(given="given", k="k"):
    return f"""WHEN {k} IS NULL THEN 'unknown game_id (not in this slate)' WHEN {given} IS NULL THEN 'kickoff_utc: unusable timestamp'
      WHEN abs({given} - {k}) > 600 THEN concat('kickoff_utc ', {iso(given)}, ' does not match schedule ', {iso(k)})"""


def _time_reason(label, t, max_age):
    s = f"""WHEN {t} IS NULL THEN '{label}: unusable timestamp' WHEN {t} > {b.NOW_EPOCH} + 120 THEN concat('{label} ', {iso(t)}, ' is after the decision time')
      WHEN {t} >= k THEN concat('{label} ', {iso(t)}, ' is at/after kickoff')"""
    if max_age:
        s += f" WHEN {b.NOW_EPOCH} - {t} > {max_age * 60} THEN concat('{label} ', {iso(t)}, ' is stale: older than {max_age} min')"
    return s


STARTERS = f"""starters0 AS (
  SELECT i.*, g.k, g.home_team, g.away_team, {b.epoch('i.kickoff_utc')} AS given, {b.epoch('i.confirmed_utc')} AS ct
  FROM starter_inputs i LEFT JOIN slate_games g ON i.game_id = g.game_id),
starters1 AS (SELECT *, CASE {_key_reason()}
      WHEN NOT (team IN (home_team, away_team)) THEN concat('team ', team, ' is not in this game')
      WHEN trim(coalesce(qb_name, '')) = '' THEN 'qb_name is blank' WHEN trim(coalesce(source, '')) = '' THEN 'source is blank'
      {_time_reason('confirmed_utc', 'ct', 2880)} ELSE '' END AS reason0 FROM starters0),
starters AS (SELECT row_no, game_id, team, CASE WHEN reason0 = '' AND row_number() OVER (PARTITION BY game_id, team, reason0 ORDER BY row_no) > 1
      THEN 'duplicate override for this game and team' ELSE reason0 END AS reason FROM starters1)"""
WEATHER = f"""weather0 AS (
  SELECT i.*, s.kickoff_epoch AS k, {b.epoch('i.kickoff_utc')} AS given, {b.epoch('i.forecast_utc')} AS ft, {b.epoch('i.retrieved_utc')} AS rt,
    {b.epoch('i.valid_for_utc')} AS vt, try_cast(wind_mph AS DOUBLE) AS wind, try_cast(temp_f AS DOUBLE) AS temp
  FROM weather_inputs i LEFT JOIN slate s ON i.game_id = s.game_id),
weather1 AS (SELECT *, CASE {_key_reason()} WHEN source IS NULL THEN 'source is blank'
      WHEN wind IS NULL OR temp IS NULL THEN 'wind_mph/temp_f not numeric'
      WHEN isnan(wind) OR wind NOT BETWEEN 0 AND 100 THEN 'wind_mph out of range' WHEN isnan(temp) OR temp NOT BETWEEN -60 AND 130 THEN 'temp_f out of range'
      {_time_reason('forecast_utc', 'ft', 720)} {_time_reason('retrieved_utc', 'rt', None)}
      WHEN rt < ft THEN 'retrieved_utc is before forecast_utc' WHEN vt IS NULL THEN 'valid_for_utc: unusable timestamp'
      WHEN abs(vt - k) > 10800 THEN 'valid_for_utc is too far from kickoff' ELSE '' END AS reason0 FROM weather0),
weather AS (SELECT row_no, game_id, round(wind, 6) AS wind, CASE WHEN reason0 = '' AND row_number() OVER (PARTITION BY game_id, reason0 ORDER BY row_no) > 1
      THEN 'duplicate forecast for this game' ELSE reason0 END AS reason FROM weather1)"""
INPUT_VIEWS = ["games", "slate", "starter_inputs", "weather_inputs"]

_NOW = b.NOW_EPOCH
_AFTER = (C.replace(str(_NOW), str(_NOW + LATER_MINUTES * 60)).replace("checked AS", "checked2 AS").replace("FROM checked ", "FROM checked2 ")
          .replace("valid AS", "valid2 AS").split("latest AS")[0])
_KEYS = "game_id, book, market, side, point, price, odds_time"

ORACLES = {
    "quotes_valid": b.oracle(Q, f"SELECT event_id, game_id, book, market, side, point, price, source, {iso('t')} AS quoted_utc FROM valid", C),
    "quotes_rejected": b.oracle(Q, "SELECT event_id, game_id, reject_reason FROM checked WHERE reject_reason <> ''", C),
    "quotes_reject_reasons": b.oracle(Q, "SELECT split_part(reject_reason, ':', 1) AS reason, count(*) AS quotes FROM checked WHERE reject_reason <> '' GROUP BY 1", C),
    "quotes_latest": b.oracle(Q, f"SELECT game_id, book, market, side, point, price, {iso('t')} AS quoted_utc FROM latest", C),
    "quotes_pairs_novig": b.oracle(Q, f"""SELECT game_id, market, book, line, round(p, 6) AS p, round(overround, 6) AS overround,
  {iso('newest')} AS newest_utc, {iso('oldest')} AS oldest_utc, first_price, second_price FROM pairs""", C),
    "reference_ml_loo": b.oracle(Q, f"""SELECT game_id, coalesce(excluded, '-') AS excluded, n_books, books, round(p, 6) AS p, round(spread_of_books, 6) AS spread_of_books,
  {iso('oldest')} AS oldest_utc, {iso('newest')} AS newest_utc FROM refs WHERE market = 'ml'""", ",\n".join((C, LOO, REFS))),
    "reference_lines_loo": b.oracle(Q, f"""SELECT game_id, market, coalesce(excluded, '-') AS excluded, n_books, books, line,
  {iso('oldest')} AS oldest_utc, {iso('newest')} AS newest_utc FROM refs WHERE market <> 'ml'""", ",\n".join((C, LOO, REFS))),
    "reference_mu": b.oracle(Q, f"""SELECT r.game_id, r.market, coalesce(r.excluded, '-') AS excluded, n_books, line, round(mu, 6) AS mu,
  round(CASE WHEN r.market = 'ml' THEN p ELSE {_over('mu', 'line')} END, 6) AS p, round(CASE WHEN r.market = 'ml' THEN spread_of_books ELSE apart END, 6) AS spread_of_books
FROM refs r LEFT JOIN means m ON m.game_id = r.game_id AND m.market = r.market AND m.excluded IS NOT DISTINCT FROM r.excluded LEFT JOIN shape s ON s.market = r.market""",
                             ",\n".join((C, LOO, REFS, MEANS))).replace("WITH ", "WITH RECURSIVE ", 1),
    "reference_provenance": b.oracle(Q, PROVENANCE, C + ",\n" + LOO),
    "reference_per_offer": b.oracle([*Q, "games"], """SELECT o.game_id, o.book, o.market, o.side, o.point,
  coalesce(r.line, CASE o.market WHEN 'spread' THEN g.spread_line WHEN 'total' THEN g.total_line END) AS line, r.n_books IS NOT NULL AS live
FROM latest o JOIN games g ON o.game_id = g.game_id LEFT JOIN refs r ON r.game_id = o.game_id AND r.market = o.market AND r.excluded = o.book""",
                                    ",\n".join((C, LOO, REFS))),
    "live_over_schedule_lines": b.oracle([*Q, "games"], """SELECT g.game_id, coalesce(s.line, g.spread_line) AS spread_line, coalesce(t.line, g.total_line) AS total_line,
  CASE WHEN EXISTS (SELECT 1 FROM refs r WHERE r.excluded IS NULL AND r.game_id = g.game_id) THEN 'live bookmaker quotes' ELSE 'schedule consensus (untimed)' END AS reference_kind
FROM games g LEFT JOIN refs s ON s.game_id = g.game_id AND s.market = 'spread' AND s.excluded IS NULL
  LEFT JOIN refs t ON t.game_id = g.game_id AND t.market = 'total' AND t.excluded IS NULL""", ",\n".join((C, LOO, REFS))),
    "feed_readiness": b.oracle(Q, """SELECT m.market, count(x.game_id) AS games FROM (VALUES ('spread'), ('ml'), ('total')) m(market)
LEFT JOIN (SELECT market, game_id FROM pairs GROUP BY ALL HAVING count(DISTINCT book) >= 3) x ON x.market = m.market GROUP BY 1""", C),
    "feed_statistics": b.oracle(Q, f"""SELECT (SELECT count(*) FROM valid) AS valid_quotes, (SELECT count(*) FROM checked WHERE reject_reason <> '') AS rejected_quotes,
  count(DISTINCT book) AS books, count(DISTINCT game_id) AS games_with_quotes, round(min({_NOW} - t) / 60, 6) AS age_min,
  round(quantile_cont(({_NOW} - t) / 60, 0.5), 6) AS age_median, round(max({_NOW} - t) / 60, 6) AS age_max FROM valid""", C),
    "expired_quotes": b.oracle(Q, f"SELECT {_KEYS} FROM valid EXCEPT SELECT {_KEYS} FROM valid2", C + ",\n" + _AFTER),
    "collection_run": b.oracle([*Q, "games", "injuries"], """SELECT g.game_id, coalesce(q.v, 0) AS valid_quotes, coalesce(q.r, 0) AS rejected_quotes, q.newest_quote,
  (SELECT count(*) FROM injuries i WHERE i.league = g.league AND i.season = g.season AND i.week = g.week AND i.team IN (g.home_team, g.away_team)) AS injury_rows
FROM slate_games g LEFT JOIN (SELECT game_id, count(*) FILTER (reject_reason = '') AS v, count(*) FILTER (reject_reason <> '') AS r,
  max(odds_time) FILTER (reject_reason = '') AS newest_quote FROM checked GROUP BY 1) q ON q.game_id = g.game_id""", C + ",\n" + SLATE_GAMES),
    "feed_flatten": b.oracle(["feed"], f"SELECT event_id, home_team, away_team, {iso('commence')} AS commence_utc, book, market, side, point, price, odds_time FROM flat", FLAT),
    "feed_match_kickoff": b.oracle(["feed", "slate", "games"], """SELECT event_id, game_id, book, market, side, point, price, 'odds_api' AS source, odds_time FROM (
  SELECT f.*, m.game_id FROM flat f JOIN (SELECT f2.event_id, max_by(g.game_id, g.game_id) AS game_id FROM (SELECT DISTINCT event_id, league, home_team, away_team, commence FROM flat) f2
    JOIN slate_games g ON g.league = f2.league AND g.home_team = f2.home_team AND g.away_team = f2.away_team AND abs(f2.commence - g.k) <= 21600 GROUP BY 1) m ON m.event_id = f.event_id) z""",
                                   FLAT + ",\n" + SLATE_GAMES),
    "key_check": b.oracle(["starter_inputs", "slate"], f"""SELECT row_no, game_id, CASE {_key_reason()} ELSE '' END AS reason
FROM (SELECT i.row_no, i.game_id, s.kickoff_epoch AS k, {b.epoch('i.kickoff_utc')} AS given FROM starter_inputs i LEFT JOIN slate s ON s.game_id = i.game_id) z"""),
    "starter_inputs_validated": b.oracle(INPUT_VIEWS, "SELECT row_no, game_id, team, reason FROM starters", SLATE_GAMES + ",\n" + STARTERS),
    "forecast_inputs_validated": b.oracle(INPUT_VIEWS, "SELECT row_no, game_id, wind, reason FROM weather", SLATE_GAMES + ",\n" + WEATHER),
    "inputs_rejected": b.oracle(INPUT_VIEWS, """SELECT file, array_to_string(string_split(reason, ' ')[1:2], ' ') AS kind, count(*) AS n
FROM (SELECT 'starters' AS file, reason FROM starters UNION ALL SELECT 'weather', reason FROM weather) z WHERE reason <> '' GROUP BY 1, 2""",
                                ",\n".join((SLATE_GAMES, STARTERS, WEATHER))),
}
