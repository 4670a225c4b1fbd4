"""Plays, availability, injuries, prices, schedule."""
from __future__ import annotations

from pyspark.sql import functions as F

from linewell.catalog import base as b
from linewell.functions import prices, times
from linewell.operators import availability, plays, schedule
from linewell.sources import feed

S = b.SETTINGS
FIXED_OVERROUND = 0.0476


def _r(*names):
    return [b.r6(n).alias(n) for n in names]


def team_games(spark, sf):
    return plays.team_games(b.table(spark, sf, "plays")).select(
        "game_id", "season", "week", "team", "opp", *_r("epa", "sr", "pass_epa", "rush_epa", "neutral_spp"), "plays", "neutral_n")


def qb_games(spark, sf):
    return plays.passer_games(b.table(spark, sf, "plays")).select("game_id", "season", "week", "team", "qb_id", "dropbacks", b.r6("epa").alias("epa"), "name")


def neutral_pace(spark, sf):
    return plays.neutral_pace(b.table(spark, sf, "plays")).select("game_id", "team", "opp", b.r6("neutral_spp").alias("neutral_spp"), "neutral_n")


def team_name_fix(spark, sf):
    g = b.table(spark, sf, "games")
    return g.select("game_id", plays.current_code(F.col("home_raw")).alias("home"), plays.current_code(F.col("away_raw")).alias("away"))


def snap_expected_share(spark, sf):
    return availability.expected_shares(b.table(spark, sf, "snaps")).select("league", "game_id", "team", "pfr_player_id", *_r("exp_off", "exp_def"))


def line_continuity(spark, sf):
    return availability.line_continuity(b.table(spark, sf, "snaps")).select("league", "game_id", "team", b.r6("olc").alias("olc"))


def _avail(spark, sf):
    return availability.team_game_availability(b.table(spark, sf, "snaps"), b.table(spark, sf, "injuries"), b.table(spark, sf, "crosswalk"))


def availability_features(spark, sf):
    g = b.table(spark, sf, "games").select("game_id", "home_team", "away_team")
    return availability.availability_features(g, _avail(spark, sf)).select("game_id", *_r("f_avail", "t_avail", "f_olc", "t_olc"))


def _team_weeks(spark, sf):
    g = b.table(spark, sf, "games")
    return g.select("league", "season", "week", F.explode(F.array("home_team", "away_team")).alias("team"))


def injury_latest_week(spark, sf):
    return availability.injury_lines(_team_weeks(spark, sf), b.table(spark, sf, "injuries")).select(
        "league", "season", "team", "week", "report_week", "issued", "stale", "lines")


def starter_status(spark, sf):
    g = b.table(spark, sf, "games")
    st = g.select("game_id", "league", "season", "week", F.inline(F.array(
        F.struct(F.col("home_team").alias("team"), F.replace("home_qb_id", F.lit("-q"), F.lit("-g")).alias("qb_id")),
        F.struct(F.col("away_team").alias("team"), F.replace("away_qb_id", F.lit("-q"), F.lit("-g")).alias("qb_id")))))
    return availability.starter_availability(st, b.table(spark, sf, "injuries")).select("game_id", "team", "qb_id", "state", "detail")


def consensus_unpivot(spark, sf):
    return feed.consensus_quotes(b.table(spark, sf, "games")).select("game_id", "book", "market", "side", "point", "price", "source")


def quote_sources_union(spark, sf):
    o = b.table(spark, sf, "offers").select("game_id", "book", "market", "side", "point", "price", "source", "odds_time")
    return (feed.gather_quotes(o, feed.consensus_quotes(b.table(spark, sf, "games"))).groupBy("source", "market")
            .agg(F.count("*").alias("n"), F.count_distinct("game_id").alias("games")))


def revig(spark, sf):
    g = b.table(spark, sf, "games")
    out = {}
    for first, second in (("home_spread_odds", "away_spread_odds"), ("over_odds", "under_odds"), ("home_moneyline", "away_moneyline")):
        out[first], out[second] = prices.revig_pair(F.col(first), F.col(second), FIXED_OVERROUND)
    return g.select("game_id", *[c.alias(n) for n, c in out.items()])


def overround_by_season(spark, sf):
    g = b.table(spark, sf, "games").filter(F.col("result").isNotNull())

    def margin(x, y):
        return prices.implied_any(F.col(x)) + prices.implied_any(F.col(y)) - 1
    d = g.select("season", F.when(F.col("home_spread_odds").isNotNull(), margin("home_spread_odds", "away_spread_odds")).alias("spread_or"),
                 F.when(F.col("home_moneyline").isNotNull(), margin("home_moneyline", "away_moneyline")).alias("ml_or"),
                 F.when(F.col("over_odds").isNotNull(), margin("over_odds", "under_odds")).alias("total_or"))
    return d.groupBy("season").agg(*[b.r6(F.median(c)).alias(c) for c in ("spread_or", "ml_or", "total_or")])


def price_math(spark, sf):
    o = b.table(spark, sf, "offers")
    return o.select("event_id", b.r6(prices.decimal_odds(F.col("price"))).alias("dec"), b.r6(prices.implied(F.col("price"))).alias("implied"),
                    b.r6(prices.no_vig(F.col("price"), F.lit(-110.0))).alias("p_vs_standard"))


def _side_probs(spark, sf):
    fc = b.table(spark, sf, "forecasts")
    push = F.when(F.col("market") == "ml", 0.0).otherwise((F.abs(F.col("point") * 2) % 5) * 0.01)
    return fc.withColumn("p_push", push).withColumn("p_win", F.col("model_prob") * (1 - F.col("p_push")))


def ev_kelly_stake(spark, sf):
    d = _side_probs(spark, sf)
    k = prices.kelly(F.col("p_win"), F.col("p_push"), F.col("price"))
    return d.select("hash", b.r6(prices.expected_value(F.col("p_win"), F.col("p_push"), F.col("price"))).alias("ev"),
                    b.r6(k).alias("kelly"), prices.stake_units(k, S).alias("stake_units"))


def min_price(spark, sf):
    return _side_probs(spark, sf).select("hash", prices.price_for_edge(F.col("p_win"), F.col("p_push"), S.min_edge).alias("min_price"))


def grade_profit_clv(spark, sf):
    w = b.table(spark, sf, "wagers")
    g = b.table(spark, sf, "games").select("game_id", "home_score", "away_score", "spread_line", "total_line", "home_moneyline", "away_moneyline")
    c = F.col
    d = w.join(g, "game_id").withColumn("result", prices.grade(c("market"), c("side"), c("point"), c("home_score"), c("away_score")))
    clv = prices.closing_value(c("market"), c("side"), c("point"), c("price"), c("spread_line"), c("total_line"), c("home_moneyline"), c("away_moneyline"))
    return d.select("bet_id", "result", b.r6(prices.profit(c("result"), c("price"))).alias("flat"), b.r6(clv).alias("clv"))


def schedule_kickoffs(spark, sf):
    g = b.table(spark, sf, "games")
    return g.select("game_id", times.iso(times.kickoff_utc(F.col("gameday"), F.col("gametime"))).alias("kickoff_utc"))


def slate_by_range(spark, sf):
    s = schedule.define_slate(b.table(spark, sf, "games"), season=2012, weeks=(3, 8), date_from="2012-09-20", date_to="2012-10-25")
    return s.select("game_id", "season", "week", "home_team", "away_team", times.iso(F.col("kickoff")).alias("kickoff_utc"), "played")


def upcoming_slate(spark, sf):
    """Current season, next unplayed day's slate and forward-window games, per game."""
    g = b.table(spark, sf, "games")
    return schedule.forward_view(g, as_of="2013-09-20T16:00:00Z", days=7).select(
        "game_id", "current_season", "played", "in_window", "next_day_slate", "started")


def feed_freshness(spark, sf):
    g, i, p = (b.table(spark, sf, n) for n in ("games", "injuries", "plays"))
    return schedule.source_freshness(g, i, p).select("source", "season", "latest")


QUERIES = {f.__name__: f for f in (
    team_games, qb_games, neutral_pace, team_name_fix, snap_expected_share, line_continuity, availability_features,
    injury_latest_week, starter_status, consensus_unpivot, quote_sources_union, revig, overround_by_season, price_math,
    ev_kelly_stake, min_price, grade_profit_clv, schedule_kickoffs, slate_by_range, upcoming_slate, feed_freshness)}

# ---------------------------------------------------------------- oracles

imp, dec = b.duck_implied, b.duck_decimal


def _fix(c):
    return f"CASE {c} WHEN 'OAK' THEN 'LV' WHEN 'SD' THEN 'LAC' WHEN 'STL' THEN 'LA' WHEN 'LAR' THEN 'LA' WHEN 'JAC' THEN 'JAX' WHEN 'WSH' THEN 'WAS' ELSE {c} END"


PBP = f"""scrim AS (SELECT * REPLACE ({_fix('posteam')} AS posteam, {_fix('defteam')} AS defteam) FROM plays WHERE play_type IN ('pass', 'run') AND epa IS NOT NULL),
gaps AS (SELECT *, lag(game_seconds_remaining) OVER (PARTITION BY game_id, drive ORDER BY game_seconds_remaining DESC, play_id) - game_seconds_remaining AS gap FROM scrim),
neutral AS (SELECT game_id, season, week, posteam, defteam, avg(gap) AS neutral_spp, count(*) AS neutral_n FROM gaps
  WHERE qtr <= 3 AND abs(score_differential) <= 7 AND half_seconds_remaining > 120 AND gap > 0 AND gap <= 60 GROUP BY ALL)"""
SNAP = """tg AS (SELECT *, row_number() OVER (PARTITION BY league, season, team ORDER BY week, game_id) AS no FROM (SELECT DISTINCT league, season, team, game_id, week FROM snaps) z),
sn AS (SELECT s.*, t.no FROM snaps s JOIN tg t ON s.league = t.league AND s.season = t.season AND s.team = t.team AND s.game_id = t.game_id),
share AS (SELECT t.league, t.season, t.team, t.game_id, t.week, t.no, s.pfr_player_id, sum(s.offense_pct) / least(t.no - 1, 4) AS exp_off, sum(s.defense_pct) / least(t.no - 1, 4) AS exp_def,
    sum(s.offense_snaps) FILTER (s.position IN ('T', 'G', 'C', 'OL', 'OT', 'OG')) AS line_snaps
  FROM tg t JOIN sn s ON s.league = t.league AND s.season = t.season AND s.team = t.team AND s.no BETWEEN t.no - 4 AND t.no - 1 GROUP BY t.league, t.season, t.team, t.game_id, t.week, t.no, s.pfr_player_id),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league, season, team, no ORDER BY line_snaps DESC, pfr_player_id) AS rk FROM share WHERE line_snaps IS NOT NULL) z WHERE rk <= 5),
olc AS (SELECT t.league, t.season, t.team, t.game_id, sum(CASE WHEN x.rk IS NOT NULL THEN s.offense_snaps ELSE 0 END) / sum(s.offense_snaps) AS olc
  FROM tg t JOIN sn s ON s.league = t.league AND s.season = t.season AND s.team = t.team AND s.no = t.no - 1 AND s.position IN ('T', 'G', 'C', 'OL', 'OT', 'OG')
  LEFT JOIN top5 x ON x.league = t.league AND x.season = t.season AND x.team = t.team AND x.no = t.no AND x.pfr_player_id = s.pfr_player_id GROUP BY ALL HAVING sum(s.offense_snaps) > 0)"""
AVAIL = """xw AS (SELECT gsis_id, max_by(pfr_id, row_no) AS pfr_id FROM crosswalk WHERE pfr_id IS NOT NULL AND gsis_id IS NOT NULL GROUP BY 1),
miss AS (SELECT s.game_id, s.team, sum(exp_off) AS avail_off, sum(exp_def) AS avail_def FROM share s JOIN injuries i ON i.league = s.league AND i.season = s.season AND i.team = s.team AND i.week = s.week
    AND i.report_status IN ('Out', 'Doubtful') AND i.position <> 'QB' JOIN xw ON xw.gsis_id = i.gsis_id AND xw.pfr_id = s.pfr_player_id GROUP BY ALL),
av AS (SELECT t.game_id, t.team, coalesce(m.avail_off, 0) AS o, coalesce(m.avail_def, 0) AS d, coalesce(c.olc, 0.96) AS l FROM tg t
  LEFT JOIN miss m ON m.game_id = t.game_id AND m.team = t.team LEFT JOIN olc c ON c.game_id = t.game_id AND c.team = t.team)"""
PROBS = """probs AS (SELECT *, model_prob * (1 - p_push) AS p_win FROM (SELECT *, CASE WHEN market = 'ml' THEN 0 ELSE (abs(point * 2) % 5) * 0.01 END AS p_push FROM forecasts) z)"""
GRADE = """CASE market WHEN 'spread' THEN (CASE side WHEN 'home' THEN home_score - away_score ELSE away_score - home_score END) + point
  WHEN 'ml' THEN (CASE side WHEN 'home' THEN home_score - away_score ELSE away_score - home_score END)
  ELSE (CASE side WHEN 'over' THEN home_score + away_score - point ELSE point - home_score - away_score END) END"""


def duck_profit(result, price):
    return f"(CASE {result} WHEN 'W' THEN {dec(price)} - 1 WHEN 'P' THEN 0.0 WHEN 'L' THEN -1.0 END)"


def duck_clv():
    h, a = imp("home_moneyline"), imp("away_moneyline")
    return f"""CASE market WHEN 'spread' THEN point + CASE side WHEN 'home' THEN spread_line ELSE -spread_line END
      WHEN 'total' THEN CASE side WHEN 'over' THEN total_line - point ELSE point - total_line END
      ELSE CASE side WHEN 'home' THEN {h} / ({h} + {a}) ELSE 1 - {h} / ({h} + {a}) END - {imp('price')} + 0 * home_moneyline END"""


def _vig(x, y, which):
    p = f"({imp(f'coalesce({x}, -110)')} / ({imp(f'coalesce({x}, -110)')} + {imp(f'coalesce({y}, -110)')}))"
    q = f"({p if which == 0 else f'(1 - {p})'} * {1 + FIXED_OVERROUND})"
    q = f"least(greatest({q}, 1e-6), 1 - 1e-6)"
    own = (x, y)[which]
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN {own} ELSE round_even(CASE WHEN {q} >= 0.5 THEN -100 * {q} / (1 - {q}) ELSE 100 * (1 - {q}) / {q} END, 0) END AS {own}"


_PAIRS = (("home_spread_odds", "away_spread_odds"), ("over_odds", "under_odds"), ("home_moneyline", "away_moneyline"))
# Eastern clock to UTC: +4 h before the first Sunday of November, +5 h from then on (seasons run August-January)
_EASTERN = """CAST(gameday AS TIMESTAMP) + to_hours(CASE WHEN month(gameday) IN (8, 9, 10) OR (month(gameday) = 11 AND day(gameday) <= 7 AND day(gameday) <= (7 - dayofweek(make_date(year(gameday), 11, 1))) % 7) THEN 4 ELSE 5 END)
  + to_minutes(CAST(split_part(gametime, ':', 1) AS INTEGER) * 60 + CAST(split_part(gametime, ':', 2) AS INTEGER))"""

ORACLES = {
    "team_games": b.oracle(["plays"], """SELECT e.game_id, e.season, e.week, e.team, e.opp, round(epa, 6) AS epa, round(sr, 6) AS sr, round(pass_epa, 6) AS pass_epa, round(rush_epa, 6) AS rush_epa,
  round(neutral_spp, 6) AS neutral_spp, plays, coalesce(neutral_n, 0) AS neutral_n FROM
 (SELECT game_id, season, week, posteam AS team, defteam AS opp, avg(epa) AS epa, avg(success) AS sr, avg(epa) FILTER (qb_dropback = 1) AS pass_epa, avg(epa) FILTER (play_type = 'run') AS rush_epa
  FROM scrim WHERE wp > 0.05 AND wp < 0.95 GROUP BY ALL) e
 JOIN (SELECT game_id, posteam, count(*) AS plays FROM scrim GROUP BY ALL) a ON a.game_id = e.game_id AND a.posteam = e.team
 LEFT JOIN neutral n ON n.game_id = e.game_id AND n.posteam = e.team""", PBP),
    "qb_games": b.oracle(["plays"], f"""SELECT game_id, season, week, {_fix('posteam')} AS team, passer_player_id AS qb_id, count(*) AS dropbacks, round(avg(epa), 6) AS epa, min_by(passer_player_name, play_id) AS name
FROM plays WHERE qb_dropback = 1 AND epa IS NOT NULL AND passer_player_id IS NOT NULL AND wp > 0.05 AND wp < 0.95 GROUP BY ALL"""),
    "neutral_pace": b.oracle(["plays"], "SELECT game_id, posteam AS team, defteam AS opp, round(neutral_spp, 6) AS neutral_spp, neutral_n FROM neutral", PBP),
    "team_name_fix": b.oracle(["games"], f"SELECT game_id, {_fix('home_raw')} AS home, {_fix('away_raw')} AS away FROM games"),
    "snap_expected_share": b.oracle(["snaps"], "SELECT league, game_id, team, pfr_player_id, round(exp_off, 6) AS exp_off, round(exp_def, 6) AS exp_def FROM share", SNAP),
    "line_continuity": b.oracle(["snaps"], "SELECT league, game_id, team, round(olc, 6) AS olc FROM olc", SNAP),
    "availability_features": b.oracle(["games", "snaps", "injuries", "crosswalk"], """SELECT g.game_id,
  round((coalesce(a.o, 0) + coalesce(a.d, 0)) - (coalesce(h.o, 0) + coalesce(h.d, 0)), 6) AS f_avail, round(coalesce(h.o, 0) + coalesce(a.o, 0), 6) AS t_avail,
  round(coalesce(h.l, 0.96) - coalesce(a.l, 0.96), 6) AS f_olc, round(coalesce(h.l, 0.96) + coalesce(a.l, 0.96) - 1.92, 6) AS t_olc
FROM games g LEFT JOIN av h ON h.game_id = g.game_id AND h.team = g.home_team LEFT JOIN av a ON a.game_id = g.game_id AND a.team = g.away_team""", SNAP + ",\n" + AVAIL),
    "injury_latest_week": b.oracle(["games", "injuries"], """SELECT q.league, q.season, q.team, q.week, q.wk AS report_week, bool_or(i.report_status IS NOT NULL) AS issued, q.wk <> q.week AS stale,
  CASE WHEN bool_or(i.report_status IS NOT NULL) THEN coalesce(string_agg(listed, '; ' ORDER BY listed), '') ELSE coalesce(string_agg(dnp, '; ' ORDER BY dnp), '') END AS lines
FROM (SELECT t.league, t.season, t.team, t.week, max(i.week) AS wk FROM tw t LEFT JOIN injuries i ON i.league = t.league AND i.season = t.season AND i.team = t.team AND i.week <= t.week GROUP BY ALL) q
LEFT JOIN (SELECT *, CASE WHEN report_status IN ('Out', 'Doubtful', 'Questionable') THEN concat(full_name, ' (', position, ') ', report_status, coalesce(' - ' || report_primary_injury, '')) END AS listed,
  CASE WHEN practice_status LIKE 'Did Not%' THEN concat(full_name, ' (', position, ') did not practice', coalesce(' - ' || practice_primary_injury, '')) END AS dnp FROM injuries) i
 ON i.league = q.league AND i.season = q.season AND i.team = q.team AND i.week = q.wk GROUP BY ALL""",
                                   "tw AS (SELECT DISTINCT league, season, week, unnest([home_team, away_team]) AS team FROM games)"),
    "starter_status": b.oracle(["games", "injuries"], """SELECT game_id, team, qb_id,
  CASE WHEN qb_id IS NULL OR issued IS NULL THEN 'unknown' WHEN status IN ('Out', 'Doubtful') THEN 'ruled_out' WHEN status = 'Questionable' THEN 'questionable' WHEN issued THEN 'available' ELSE 'unknown' END AS state,
  CASE WHEN qb_id IS NULL THEN 'projected starter not listed' WHEN issued IS NULL THEN concat('no week ', week, ' injury report for ', team, ' in the feed yet')
    WHEN status IN ('Out', 'Doubtful') THEN concat('listed ', status) WHEN status = 'Questionable' THEN concat('listed Questionable (practice: ', coalesce(practice, 'n/a'), ')')
    WHEN issued THEN concat('no game-status designation on the final report', coalesce(' (practice: ' || practice || ')', ''))
    ELSE concat('game statuses not issued yet', coalesce('; practice: ' || practice, '; not on the practice report')) END AS detail
FROM (SELECT s.*, (SELECT bool_or(report_status IS NOT NULL) FROM injuries i WHERE i.league = s.league AND i.season = s.season AND i.team = s.team AND i.week = s.week) AS issued,
    (SELECT max_by(report_status, row_no) FROM injuries i WHERE i.league = s.league AND i.season = s.season AND i.team = s.team AND i.week = s.week AND i.gsis_id = s.qb_id AND report_status IS NOT NULL) AS status,
    (SELECT max_by(practice_status, row_no) FROM injuries i WHERE i.league = s.league AND i.season = s.season AND i.team = s.team AND i.week = s.week AND i.gsis_id = s.qb_id AND practice_status IS NOT NULL) AS practice
  FROM (SELECT game_id, league, season, week, home_team AS team, replace(home_qb_id, '-q', '-g') AS qb_id FROM games
        UNION ALL SELECT game_id, league, season, week, away_team, replace(away_qb_id, '-q', '-g') FROM games) s) z"""),
    "consensus_unpivot": b.oracle(["games"], """SELECT game_id, 'consensus' AS book, market, side, point, price, 'consensus' AS source FROM (
  SELECT game_id, 'spread' AS market, 'home' AS side, 0 - spread_line AS point, coalesce(home_spread_odds, -110) AS price FROM games WHERE spread_line IS NOT NULL
  UNION ALL SELECT game_id, 'spread', 'away', spread_line, coalesce(away_spread_odds, -110) FROM games WHERE spread_line IS NOT NULL
  UNION ALL SELECT game_id, 'ml', 'home', NULL, home_moneyline FROM games WHERE home_moneyline IS NOT NULL AND away_moneyline IS NOT NULL
  UNION ALL SELECT game_id, 'ml', 'away', NULL, away_moneyline FROM games WHERE home_moneyline IS NOT NULL AND away_moneyline IS NOT NULL
  UNION ALL SELECT game_id, 'total', 'over', total_line, coalesce(over_odds, -110) FROM games WHERE total_line IS NOT NULL
  UNION ALL SELECT game_id, 'total', 'under', total_line, coalesce(under_odds, -110) FROM games WHERE total_line IS NOT NULL) z"""),
    "quote_sources_union": b.oracle(["games", "offers"], """SELECT source, market, count(*) AS n, count(DISTINCT game_id) AS games FROM (
  SELECT source, market, game_id FROM offers UNION ALL SELECT 'consensus', 'spread', game_id FROM games, (VALUES (1), (2)) v(x) WHERE spread_line IS NOT NULL
  UNION ALL SELECT 'consensus', 'ml', game_id FROM games, (VALUES (1), (2)) v(x) WHERE home_moneyline IS NOT NULL AND away_moneyline IS NOT NULL
  UNION ALL SELECT 'consensus', 'total', game_id FROM games, (VALUES (1), (2)) v(x) WHERE total_line IS NOT NULL) z GROUP BY 1, 2"""),
    "revig": b.oracle(["games"], "SELECT game_id, " + ", ".join(_vig(x, y, k) for x, y in _PAIRS for k in (0, 1)) + " FROM games"),
    "overround_by_season": b.oracle(["games"], "SELECT season, " + ", ".join(
        f"round(median(CASE WHEN {x} IS NOT NULL THEN {imp(x)} + {imp(y)} - 1 END), 6) AS {n}" for (x, y), n in zip((_PAIRS[0], _PAIRS[2], _PAIRS[1]), ("spread_or", "ml_or", "total_or")))
        + " FROM games WHERE result IS NOT NULL GROUP BY 1"),
    "price_math": b.oracle(["offers"], f"""SELECT event_id, round({dec('price')}, 6) AS dec, CASE WHEN abs(price) >= 100 THEN round({imp('price')}, 6) END AS implied,
  CASE WHEN abs(price) >= 100 THEN round({imp('price')} / ({imp('price')} + 110 / 210e0), 6) END AS p_vs_standard FROM offers"""),
    "ev_kelly_stake": b.oracle(["forecasts"], f"""SELECT hash, round(p_win * b - q, 6) AS ev, round(greatest(0, (b * p_win - q) / b), 6) AS kelly,
  round_even(least(greatest(0, (b * p_win - q) / b) * 0.25 * 100, 2.0), 2) AS stake_units FROM (SELECT *, {dec('price')} - 1 AS b, 1 - p_win - p_push AS q FROM probs) z""", PROBS),
    "min_price": b.oracle(["forecasts"], """SELECT hash, CASE WHEN p_win > 0 AND b > 0 THEN CASE WHEN b >= 1 THEN round_even(b * 100, 0) ELSE round_even(-100 / b, 0) END END AS min_price
FROM (SELECT *, (0.02 + 1 - p_win - p_push) / p_win AS b FROM probs) z""", PROBS),
    "grade_profit_clv": b.oracle(["wagers", "games"], f"""SELECT bet_id, result, round({duck_profit('result', 'price')}, 6) AS flat, round({duck_clv()}, 6) AS clv FROM (
  SELECT *, CASE WHEN v > 0 THEN 'W' WHEN v = 0 THEN 'P' WHEN v < 0 THEN 'L' END AS result FROM (SELECT w.*, g.home_score, g.spread_line, g.total_line, g.home_moneyline, g.away_moneyline, {GRADE} AS v
    FROM wagers w JOIN games g ON w.game_id = g.game_id) y) z"""),
    "schedule_kickoffs": b.oracle(["games"], f"SELECT game_id, strftime({_EASTERN}, '%Y-%m-%dT%H:%M:%SZ') AS kickoff_utc FROM games"),
    "slate_by_range": b.oracle(["games"], f"""SELECT game_id, season, week, home_team, away_team, strftime({_EASTERN}, '%Y-%m-%dT%H:%M:%SZ') AS kickoff_utc, result IS NOT NULL AS played
FROM games WHERE season = 2012 AND week BETWEEN 3 AND 8 AND gameday BETWEEN DATE '2012-09-20' AND DATE '2012-10-25'"""),
    "upcoming_slate": b.oracle(["games"], f"""SELECT game_id, (SELECT coalesce(min(season) FILTER (result IS NULL), max(season)) FROM games) AS current_season, result IS NOT NULL AS played,
  coalesce(k > TIMESTAMP '2013-09-20 16:00:00' AND k <= TIMESTAMP '2013-09-27 16:00:00', false) AS in_window,
  gameday = (SELECT min(gameday) FROM games WHERE result IS NULL AND gameday >= DATE '2013-09-20') AS next_day_slate,
  coalesce(k <= TIMESTAMP '2013-09-20 16:00:00', true) AS started FROM (SELECT *, {_EASTERN} AS k FROM games) z"""),
    "feed_freshness": b.oracle(["games", "injuries", "plays"], """SELECT 'schedule' AS source, season, CAST(max(gameday) AS VARCHAR) AS latest FROM games WHERE result IS NOT NULL GROUP BY 2
UNION ALL SELECT 'injuries', season, CAST(max(week) AS VARCHAR) FROM injuries GROUP BY 2 UNION ALL SELECT 'plays', season, CAST(max(week) AS VARCHAR) FROM plays GROUP BY 2"""),
}
