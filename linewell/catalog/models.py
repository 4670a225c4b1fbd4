"""Ratings, regressions, pricing, decisions, evaluation and experiments."""
from __future__ import annotations

from pyspark.sql import functions as F

from linewell.catalog import base as b
from linewell.functions import stats
from linewell.functions.joins import configure, materialise
from linewell.operators import availability, context, metrics, plays, recurrences, validity
from linewell.plans import evaluate, model, pricing, ratings
from linewell.sources import feed
from linewell.texts import TEXTS

S = b.SETTINGS
BOOT = 200
_memo: dict = {}


def _once(spark, sf, what, make):
    """Tables and fits shared by several queries are built once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _memo:
        configure(spark)
        _memo[key] = make()
    return _memo[key]


def _r(*names):
    return [b.r6(n).alias(n) for n in names]


def _ratings(spark, sf):
    def make():
        p = b.table(spark, sf, "plays")
        return ratings.rate(b.table(spark, sf, "games"), plays.team_games(p), plays.passer_games(p))
    return _once(spark, sf, "ratings", make)


def _features(spark, sf):
    def make():
        g = ratings.game_features(b.table(spark, sf, "games"), _ratings(spark, sf).games)
        av = availability.team_game_availability(b.table(spark, sf, "snaps"), b.table(spark, sf, "injuries"), b.table(spark, sf, "crosswalk"))
        return materialise(availability.availability_features(g, av), "features")
    return _once(spark, sf, "features", make)


def _model(spark, sf):
    return _once(spark, sf, "model", lambda: model.fit_walk_forward(_features(spark, sf)))


def _predictions(spark, sf):
    return _once(spark, sf, "predictions", lambda: materialise(evaluate.walk_forward_predictions(_model(spark, sf), _features(spark, sf)), "walk"))


def _nudged(*names):
    """Six digits with ties moved off the edge: early ratings are short decimals that end in a five."""
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]


def coupled_ratings(spark, sf):
    return _features(spark, sf).select("game_id", *_nudged(*ratings.MARGIN_FEATURES, *ratings.TOTAL_FEATURES, "f_rush", "t_npace"))


def team_ratings(spark, sf):
    return _ratings(spark, sf).teams.select("league", "team", *_nudged(*ratings.TEAM_COLUMNS))


def ewma_ratings(spark, sf):
    return recurrences.points_ewma(b.table(spark, sf, "games")).select("league", "game_id", "team", *[F.round(F.col(n) + 1e-9, 6).alias(n) for n in ("pf", "pa")])


def qb_decayed_sums(spark, sf):
    p = b.table(spark, sf, "plays")
    qb = plays.passer_games(p).join(b.table(spark, sf, "games").select("game_id", "league"), "game_id")
    return recurrences.decayed_passer_sums(qb).select("league", "game_id", "qb_id", *_r("n_decayed", "s_decayed"))


def feature_extremes(spark, sf):
    """Schedule-only features: clipped rest, site, division, roof and wind."""
    g = _features(spark, sf)
    return g.select("game_id", "f_hfa", "f_rest", "f_div", "t_dome", "t_wind")


GRAM_COLS = ["home_rest", "away_rest", "div_game", "spread_line"]


def gram_walk_forward(spark, sf):
    g = b.table(spark, sf, "games")
    s = model.gram_by_season(g, GRAM_COLS, "result", F.lit(2010))
    return model.accumulate(s, ["i"]).select("season", "i", b.r6("v").alias("v"))


def shrink_slope(spark, sf):
    p = b.table(spark, sf, "preds").select("season", "result", "total", "spread_line", "total_line", F.col("model_margin").alias("blend_margin"), F.col("model_total").alias("blend_total"))
    return model.shrink_table(p).select("season", "market", "n", *_r("k", "sd"))


def key_number_weights(spark, sf):
    p = b.table(spark, sf, "preds").filter("result is not null and spread_line is not null and total_line is not null")
    rows = p.select(F.col("season").alias("fold"), F.inline(F.array(
        F.struct(F.lit("margin").alias("kind"), F.col("fair_margin").alias("mu"), F.lit(13.0).alias("sd"), F.col("result").alias("actual")),
        F.struct(F.lit("total").alias("kind"), F.col("total_line").alias("mu"), F.lit(13.5).alias("sd"), F.col("total").alias("actual")))))
    return model.key_number_weights(rows).select("fold", "kind", F.col("k").cast("bigint").alias("k"), b.r6("weight").alias("weight"))


def ridge_coefficients(spark, sf):
    c = model.fit_cores(_features(spark, sf))
    return c.select("season", "model", "n", "n_seasons", b.r6("intercept").alias("intercept"), F.posexplode("coefs").alias("i", "coef")).withColumn("coef", b.r6("coef"))


def ridge_predictions(spark, sf):
    m = _model(spark, sf)
    return m.predict(_features(spark, sf)).select("game_id", "season", *_r("model_margin", "blend_margin", "model_total", "blend_total", "fair_margin", "fair_total"))


def calibration_fit(spark, sf):
    """Calibration parameters per test season (one row per season and parameter)."""
    rows = []
    for s, f in sorted(_model(spark, sf).fits.items()):
        vals = {"k_spread": f.k_spread, "k_total": f.k_total, "sd_margin": f.sd_margin, "sd_total": f.sd_total, "ml_a": f.ml[0], "ml_b": f.ml[1], "home_rate": f.home_rate}
        vals.update({f"{m}_{x}": v for m, c in f.cal.items() for x, v in zip("abc", c)})
        rows += [(s, k, round(float(v), 6)) for k, v in vals.items()]
    return spark.createDataFrame(rows, "season int, name string, value double")


def _slate(spark, sf):
    """Slate games with features; results hidden, decision-time kickoffs."""
    k = b.kickoffs(spark, sf)
    return _features(spark, sf).drop("result", "total").join(k, "game_id").filter(F.col("kickoff") > b.now())


def _to_feed_id(c):
    return F.replace(c, F.lit("-q"), F.lit("-g"))


def _contexts(spark, sf):
    inj = b.table(spark, sf, "injuries")
    w = validity.check_weather_inputs(b.table(spark, sf, "weather_inputs"), b.kickoffs(spark, sf), b.now(), S).filter("reason = ''")
    return lambda preds: context.build_contexts(preds, inj, w, S, _to_feed_id)


def game_contexts(spark, sf):
    m = _model(spark, sf)
    c = _contexts(spark, sf)(m.predict(_slate(spark, sf)))
    return c.select("game_id", *[F.array_join(x, " | ").alias(x) for x in ("facts", "assumptions", "missing", "conditions", "block_spread", "block_ml", "block_total", "risks")])


def starter_overrides(spark, sf):
    """Accepted starter confirmations applied to the slate."""
    ok = validity.check_starter_inputs(b.table(spark, sf, "starter_inputs"), b.slate_games(spark, sf), b.now(), S).filter("reason = ''")
    g = _features(spark, sf)
    names = g.select("league", F.inline(F.array(F.struct(F.col("home_qb_name").alias("qb_name"), F.col("home_qb_id").alias("qb_id"), F.col("game_id").alias("o")),
                                                F.struct(F.col("away_qb_name").alias("qb_name"), F.col("away_qb_id").alias("qb_id"), F.col("game_id").alias("o")))))
    names = names.filter("qb_id is not null").groupBy("league", "qb_name").agg(F.max_by("qb_id", "o").alias("qb_id"))
    d = context.apply_overrides(_slate(spark, sf), ok.select("game_id", "team", "qb_name"), names, _ratings(spark, sf).passers)
    return d.select("game_id", "home_qb_id", "away_qb_id", "home_confirmed", "away_confirmed", *_r("home_qb_delta", "away_qb_delta", "f_qb"))


def _priced(spark, sf, at=0):
    valid = validity.valid_quotes(validity.check_quotes(b.table(spark, sf, "offers"), b.kickoffs(spark, sf), F.timestamp_seconds(F.lit(b.NOW_EPOCH + at * 60)), S))
    games = _slate(spark, sf)
    return pricing.price_slate(_model(spark, sf), games, valid, feed.consensus_quotes(games), S, _contexts(spark, sf))


def _decision_columns(d):
    return d.select("game_id", "market", "side", "book", "point", "price", "n_books", "all_prices", *_r("p_win", "p_push", "model_prob", "implied", "market_prob", "ev", "kelly"), "min_price",
                    *_r("ev_worse10", "ev_worse05", "ev_better05", "ev_market_only", "ev_double_weight", "ev_plain"), "reference_live", "decision", "reasons", "stake_units", "risks", "is_best_side")


def decisions(spark, sf):
    return _decision_columns(_priced(spark, sf))


def reprice(spark, sf):
    """Decisions after revalidating every quote at completion, a few minutes later, until stable."""
    games = _slate(spark, sf)
    m, ctx, cons = _model(spark, sf), _contexts(spark, sf), feed.consensus_quotes(games)

    def revalidate(i):
        at = F.timestamp_seconds(F.lit(b.NOW_EPOCH + 240))
        return validity.valid_quotes(validity.check_quotes(b.table(spark, sf, "offers"), b.kickoffs(spark, sf), at, S))
    rows, info = pricing.reprice_until_stable(lambda v: pricing.price_slate(m, games, v, cons, S, ctx), revalidate, materialise(b.valid_quotes(spark, sf), "valid"))
    return _decision_columns(rows).select("game_id", "market", "side", "ev", "decision").withColumns({"repriced": F.lit(info["repriced"]), "expired": F.lit(info["expired_quotes"]), "stable": F.lit(info["stable"])})


def price_sides(spark, sf):
    """Probability of every schedule quote of the test seasons, from the fitted distributions."""
    m = _model(spark, sf)
    g = m.predict(_features(spark, sf).filter("result is not null"))
    q = feed.consensus_quotes(g).withColumns({"ref_mu": F.lit(None).cast("double"), "ref_p": F.lit(None).cast("double")})
    shapes = pricing.outcome_udfs(m)
    d = pricing.with_probability(pricing.with_market(q.join(g.select(*pricing.PREDICTION), "game_id"), m, shapes))
    d = pricing.with_scenarios(d, shapes)
    return d.select("game_id", "market", "side", *_r("p_win", "p_push", "market_prob"))


def top_drivers(spark, sf):
    g = b.table(spark, sf, "preds")
    c = F.col
    parts = {"rest": (c("model_margin") - c("spread_line")) * 0.5, "site": c("fair_margin") - c("spread_line"), "total": (c("model_total") - c("total_line")) * 0.25,
             "cover": c("p_cover") - 0.5, "market": c("p_market") - c("p_model"), "line": c("spread_line") * 0.1}
    return context.top_drivers(g, parts).select("game_id", "driver", b.r6("points").alias("points"))


def risk_flags(spark, sf):
    fc = b.table(spark, sf, "forecasts")
    d = fc.withColumns({"p_push": (F.abs(F.coalesce("point", F.lit(0.0)) * 2) % 7) * 0.01, "ev_market_only": F.col("model_prob") - 0.45, "ev_plain": F.col("ev") - 0.01})
    return d.select("hash", F.array_join(pricing.risk_flags(), " | ").alias("risks"), context.bet_label(F.initcap("side"), F.col("market"), F.col("point")).alias("label"))


def line_labels(spark, sf):
    g = b.table(spark, sf, "games")
    return g.select("game_id", context.line_label(F.col("home_team"), F.col("away_team"), F.col("spread_line")).alias("label"))


def gap_rule(spark, sf):
    p = b.table(spark, sf, "preds")
    c = pricing.gap_contexts(p, S)
    return c.select("game_id", F.size("block_spread").alias("spread_blocked"), F.size("block_total").alias("total_blocked"))


def walk_forward(spark, sf):
    return _predictions(spark, sf).select("game_id", "season", *_r("p_model", "p_market", "p_ratings_only", "p_home_rate", "p_cover", "p_cover_mkt", "p_over", "p_over_mkt"))


def walk_forward_scores(spark, sf):
    return metrics.prob_table(_predictions(spark, sf), BOOT).select("target", "predictor", "n", *_r("brier", "log_loss", "ece", "ci_lo", "ci_hi"))


def replay_bet_table(spark, sf):
    bets = evaluate.placed(evaluate.replay_bets(_model(spark, sf), _features(spark, sf), S))
    bets = materialise(bets.select(*metrics.BET_COLUMNS), "bets")   # texts and sensitivities that no table shows are never made
    return metrics.bet_table(bets, BOOT).select("market", "bets", "games", "won", "lost", "pushed", *_r("flat_roi", "roi_lo", "roi_hi", "flat_drawdown"))


def replay_fixed_overround(spark, sf):
    bets = evaluate.placed(evaluate.replay_bets(_model(spark, sf), _features(spark, sf), S, 0.0476))
    return metrics.bet_seasons(bets).select("season", "bets", *_r("flat_units", "flat_roi"))


def ablation(spark, sf):
    """Feature group G1 against the baseline on identical games."""
    c, _ = evaluate.ablate(_features(spark, sf), "G1", BOOT, _model(spark, sf))
    return c.select("target", "n", *_r("logloss_base", "logloss_exp", "d_logloss", "ci_lo", "ci_hi", "d_brier"), "seasons_improved", "seasons")


def ablation_compare(spark, sf):
    """Paired comparison of two probability columns as arms (seasons as in the schedule)."""
    p = b.table(spark, sf, "preds")
    j = metrics.targets(p)
    y = F.col("y")
    j = j.withColumns({"lb": stats.log_loss(F.col("pk"), y), "le": stats.log_loss(F.col("pm"), y), "db": stats.squared_error(F.col("pm"), y) - stats.squared_error(F.col("pk"), y)})
    return evaluate.paired_summary(j.withColumn("d", F.col("le") - F.col("lb"))).select(
        "target", "n", *_r("logloss_base", "logloss_exp", "d_logloss", "d_brier"), "seasons_improved", "seasons")


def experiment_gate(spark, sf):
    """Acceptance of document sources as if each language were a target of a group."""
    d = b.table(spark, sf, "scored").withColumn("group", F.concat(F.lit("G"), (F.length("cluster") - 3).cast("string")))
    c = d.groupBy("group", F.col("grp").alias("target")).agg((F.avg(F.col("p_model") - F.col("y")) + 0.02).alias("ci_hi"), (F.avg(F.col("p_model") - F.col("y")) - 0.05).alias("ci_lo"),
                                                              F.count_distinct("cluster").alias("seasons_improved"))
    return evaluate.development_gate(c)


def holdout_guard(spark, sf):
    """Registry of runs from the event log, one holdout request per event type group."""
    e = b.table(spark, sf, "events")
    g = F.concat(F.lit("G"), (F.col("user_id") % 6).cast("string"))
    reg = e.select(g.alias("group"), F.when((F.col("user_id") % 6 == 1) & (F.col("value") > 100), "holdout").otherwise("development").alias("period"),
                   ((F.col("value") > 20) & (F.col("user_id") % 6 != 2)).alias("passed"), F.col("event_type").alias("passed_targets"), F.col("event_id").alias("seq"))
    return evaluate.holdout_gate(reg, reg.select("group").distinct())


QUERIES = {f.__name__: f for f in (
    coupled_ratings, team_ratings, ewma_ratings, qb_decayed_sums, feature_extremes, gram_walk_forward, shrink_slope, key_number_weights, ridge_coefficients,
    ridge_predictions, calibration_fit, game_contexts, starter_overrides, decisions, reprice, price_sides, top_drivers, risk_flags, line_labels, gap_rule,
    walk_forward, walk_forward_scores, replay_bet_table, replay_fixed_overround, ablation, ablation_compare, experiment_gate, holdout_guard)}

# ---------------------------------------------------------------- oracles

from linewell.catalog import rating_oracle as ro  # noqa: E402
from linewell.catalog.evaluation import T  # noqa: E402
from linewell.catalog.quotes import SLATE_GAMES, STARTERS  # noqa: E402


_EWMA = """pg AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY gameday, game_id) AS no FROM games WHERE result IS NOT NULL),
lgr AS (SELECT league, no, game_id, 22e0 AS before, 22 + 0.01 * ((home_score + away_score) / 2 - 22) AS after FROM pg WHERE no = 1
  UNION ALL SELECT g.league, g.no, g.game_id, r.after, r.after + 0.01 * ((g.home_score + g.away_score) / 2 - r.after) FROM lgr r JOIN pg g ON g.league = r.league AND g.no = r.no + 1),
tr0 AS (SELECT g.league, g.season, g.game_id, g.gameday, home_team AS team, home_score AS f, away_score AS a FROM pg g UNION ALL SELECT g.league, g.season, g.game_id, g.gameday, away_team, away_score, home_score FROM pg g),
tr AS (SELECT t.*, l.before AS lg, row_number() OVER (PARTITION BY t.league, team ORDER BY gameday, t.game_id) AS no FROM tr0 t JOIN lgr l ON l.league = t.league AND l.game_id = t.game_id),
ew AS (SELECT league, team, no, game_id, season, lg + 0.1 * (f - lg) AS pf, lg + 0.1 * (a - lg) AS pa FROM tr WHERE no = 1
  UNION ALL SELECT t.league, t.team, t.no, t.game_id, t.season, 0.9 * (CASE WHEN t.season <> e.season THEN t.lg + 0.6 * (e.pf - t.lg) ELSE e.pf END) + 0.1 * t.f,
    0.9 * (CASE WHEN t.season <> e.season THEN t.lg + 0.6 * (e.pa - t.lg) ELSE e.pa END) + 0.1 * t.a FROM ew e JOIN tr t ON t.league = e.league AND t.team = e.team AND t.no = e.no + 1)"""
_QB = """qg AS (SELECT g.league, p.game_id, passer_player_id AS qb_id, p.season, p.week, count(*) AS n, avg(epa) AS epa FROM plays p JOIN games g ON g.game_id = p.game_id
    WHERE qb_dropback = 1 AND epa IS NOT NULL AND passer_player_id IS NOT NULL AND wp > 0.05 AND wp < 0.95 GROUP BY g.league, p.game_id, passer_player_id, p.season, p.week),
qs AS (SELECT *, row_number() OVER (PARTITION BY league, qb_id ORDER BY season, week, game_id) AS no FROM qg)"""
_GRAM = "SELECT season, CAST(i AS INTEGER) AS i, round(coalesce(sum(v) OVER (PARTITION BY i ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS v FROM (" + " UNION ALL ".join(
    f"SELECT season, {i} AS i, coalesce(sum({t}) FILTER (result IS NOT NULL AND spread_line IS NOT NULL AND season > 2010), 0) AS v FROM games GROUP BY 1"
    for i, t in enumerate(["1", "result", *GRAM_COLS, *[f"{a} * result" for a in GRAM_COLS], *[f"{GRAM_COLS[i]} * {GRAM_COLS[j]}" for i in range(4) for j in range(i, 4)]])) + ") z"
_MOM = """mo AS (SELECT season, 'spread' AS market, model_margin - spread_line AS e, result - spread_line AS d FROM preds WHERE result IS NOT NULL AND spread_line IS NOT NULL
  UNION ALL SELECT season, 'total', model_total - total_line, total - total_line FROM preds WHERE total IS NOT NULL AND total_line IS NOT NULL)"""


_cdf = b.duck_cdf
_KEYN = f"""kr AS (SELECT season AS fold, 'margin' AS kind, fair_margin AS mu, 13e0 AS sd, result AS actual, -80 AS lo, 80 AS hi FROM preds WHERE result IS NOT NULL AND spread_line IS NOT NULL AND total_line IS NOT NULL
  UNION ALL SELECT season, 'total', total_line, 13.5e0, total, 0, 130 FROM preds WHERE result IS NOT NULL AND spread_line IS NOT NULL AND total_line IS NOT NULL),
ke AS (SELECT fold, kind, k, sum({_cdf('((k + 0.5 - mu) / sd)')} - {_cdf('((k - 0.5 - mu) / sd)')}) AS e, CAST(sum(CASE WHEN k = least(greatest(actual, lo), hi) THEN 1 ELSE 0 END) AS DOUBLE) AS o FROM (SELECT *, unnest(range(lo, hi + 1)) AS k FROM kr) z GROUP BY 1, 2, 3)"""
_DR = "top AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY abs(points) DESC, driver) AS rk FROM (" + " UNION ALL ".join(
    f"SELECT game_id, '{n}' AS driver, {x} AS points FROM preds" for n, x in (
        ("rest", "(model_margin - spread_line) * 0.5"), ("site", "fair_margin - spread_line"), ("total", "(model_total - total_line) * 0.25"),
        ("cover", "p_cover - 0.5"), ("market", "p_market - p_model"), ("line", "spread_line * 0.1"))) + ") z WHERE points IS NOT NULL)"


def _said(code):
    return "'" + TEXTS[code].replace("'", "''") + "'"


_OVERRIDES = """okq AS (SELECT game_id, team, qb_name FROM starters1 WHERE reason0 = '' QUALIFY row_number() OVER (PARTITION BY game_id, team ORDER BY row_no) = 1),
nm AS (SELECT league, qb_name, max_by(q, game_id) AS q FROM (SELECT league, home_qb_name AS qb_name, home_qb_id AS q, game_id FROM games UNION ALL SELECT league, away_qb_name, away_qb_id, game_id FROM games) z WHERE q IS NOT NULL GROUP BY 1, 2),
pf AS (SELECT league, CASE WHEN sum(pn) > 300 THEN sum(pv) / sum(pn) ELSE -0.05 END AS prior FROM pk GROUP BY 1),
fr AS (SELECT sm.league, sm.q, (s + 150 * prior) / (w + 150) AS rating FROM sm JOIN pf ON pf.league = sm.league QUALIFY row_number() OVER (PARTITION BY sm.league, sm.q ORDER BY i DESC) = 1),
sides AS (SELECT game_id, league, no, 'home' AS side, h AS k, home_team AS team, home_qb_id AS q, 1 AS sign FROM gm UNION ALL SELECT game_id, league, no, 'away', a, away_team, away_qb_id, -1 FROM gm),
sb AS (SELECT x.*, z.base FROM sides x ASOF LEFT JOIN ba z ON z.league = x.league AND z.team = x.k AND z.no < x.no),
ov AS (SELECT sb.game_id, sb.side, CASE WHEN o.qb_name IS NOT NULL THEN coalesce(nm.q, concat('unknown:', o.qb_name)) ELSE sb.q END AS q, o.qb_name IS NOT NULL AS confirmed,
    CASE WHEN o.qb_name IS NOT NULL THEN coalesce(fr.rating, pf.prior) - coalesce(sb.base, fr.rating, pf.prior) ELSE coalesce(r.rating - sb.base, 0) END AS delta
  FROM sb LEFT JOIN okq o ON o.game_id = sb.game_id AND o.team = sb.team LEFT JOIN nm ON nm.league = sb.league AND nm.qb_name = o.qb_name LEFT JOIN fr ON fr.league = sb.league AND fr.q = nm.q
    LEFT JOIN pf ON pf.league = sb.league LEFT JOIN rated r ON r.game_id = sb.game_id AND r.sign = sb.sign)"""
_PT = "regexp_replace(CAST(point AS VARCHAR), '\\.0$', '')"

ORACLES = {
    "coupled_ratings": ro.recursive(b.oracle(["games", "plays"], """SELECT g.game_id, round(f_mrtg + 1e-9, 6) AS f_mrtg, round(f_epa + 1e-9, 6) AS f_epa, round(f_sr + 1e-9, 6) AS f_sr, round(f_pass + 1e-9, 6) AS f_pass, round(coalesce(f_qb, 0) + 1e-9, 6) AS f_qb,
  CASE WHEN location = 'Neutral' THEN 0e0 ELSE 1e0 END AS f_hfa, least(greatest(coalesce(home_rest, 7) - coalesce(away_rest, 7), -7), 7) AS f_rest, coalesce(div_game, 0.0) AS f_div,
  round(t_off + 1e-9, 6) AS t_off, round(t_def + 1e-9, 6) AS t_def, round(t_pace + 1e-9, 6) AS t_pace, round(t_pts + 1e-9, 6) AS t_pts, CASE WHEN roof IN ('dome', 'closed') THEN 1e0 ELSE 0e0 END AS t_dome, round(f_rush + 1e-9, 6) AS f_rush, round(t_npace + 1e-9, 6) AS t_npace
FROM games g JOIN ftr ON ftr.game_id = g.game_id LEFT JOIN dl ON dl.game_id = g.game_id""", ro.TEAMS + ",\n" + ro.PASSERS)),
    "team_ratings": ro.recursive(b.oracle(["games", "plays"], ro.FINAL_TEAMS, ro.TEAMS)),
    "starter_overrides": ro.recursive(b.oracle(["games", "plays", "slate", "starter_inputs"], f"""SELECT h.game_id, h.q AS home_qb_id, a.q AS away_qb_id, h.confirmed AS home_confirmed, a.confirmed AS away_confirmed, round(h.delta, 6) AS home_qb_delta,
  round(a.delta, 6) AS away_qb_delta, round(h.delta - a.delta, 6) AS f_qb FROM ov h JOIN ov a ON a.game_id = h.game_id AND a.side = 'away' JOIN slate s ON s.game_id = h.game_id WHERE h.side = 'home' AND s.kickoff_epoch > {b.NOW_EPOCH}""",
                                               ",\n".join((ro.TEAMS, ro.PASSERS, SLATE_GAMES, STARTERS, _OVERRIDES)))),
    "ridge_coefficients": ro.recursive(b.oracle(["games", "plays"], "SELECT season, model, n, seasons AS n_seasons, round(intercept, 6) AS intercept, unnest(range(len(coefs))) AS i, round(unnest(coefs), 6) AS coef FROM core", ro.RIDGE)),
    "ridge_predictions": ro.recursive(b.oracle(["games", "plays"], """SELECT g.game_id, g.season, round(model_margin, 6) AS model_margin, round(blend_margin, 6) AS blend_margin, round(model_total, 6) AS model_total, round(blend_total, 6) AS blend_total,
  round(CASE WHEN spread_line IS NULL THEN model_margin ELSE spread_line + s.k * (blend_margin - spread_line) END, 6) AS fair_margin, round(CASE WHEN total_line IS NULL THEN model_total ELSE total_line + t.k * (blend_total - total_line) END, 6) AS fair_total
FROM fea g LEFT JOIN fitted f ON f.game_id = g.game_id LEFT JOIN slope s ON s.season = g.season AND s.market = 'spread' LEFT JOIN slope t ON t.season = g.season AND t.market = 'total'
WHERE g.season IN (SELECT season FROM core WHERE model = 'model_margin' AND seasons > 3)""", ro.FAIR)),
    "ewma_ratings": ro.recursive(b.oracle(["games"], "SELECT league, game_id, team, round(pf + 1e-9, 6) AS pf, round(pa + 1e-9, 6) AS pa FROM ew", _EWMA)),
    "qb_decayed_sums": b.oracle(["games", "plays"], """SELECT a.league, a.game_id, a.qb_id, round(sum(b.n * pow(0.97, a.no - b.no)), 6) AS n_decayed, round(sum(b.n * b.epa * pow(0.97, a.no - b.no)), 6) AS s_decayed
FROM qs a JOIN qs b ON b.league = a.league AND b.qb_id = a.qb_id AND b.no <= a.no GROUP BY 1, 2, 3""", _QB),
    "feature_extremes": b.oracle(["games"], """SELECT game_id, CASE WHEN location = 'Neutral' THEN 0e0 ELSE 1e0 END AS f_hfa, least(greatest(coalesce(home_rest, 7) - coalesce(away_rest, 7), -7), 7) AS f_rest, coalesce(div_game, 0.0) AS f_div,
  CASE WHEN roof IN ('dome', 'closed') THEN 1e0 ELSE 0e0 END AS t_dome, CASE WHEN roof IN ('dome', 'closed') THEN 0.0 ELSE coalesce(wind, 0.0) END AS t_wind FROM games"""),
    "gram_walk_forward": b.oracle(["games"], _GRAM),
    "shrink_slope": b.oracle(["preds"], """SELECT season, market, n, round(k, 6) AS k, round(sqrt(vd - 2 * k * ced + k * k * ve), 6) AS sd FROM (
  SELECT *, CASE WHEN n < 200 OR ve * n <= 1e-12 THEN 0.0 ELSE least(greatest(ced / ve, 0), 1) END AS k FROM (
    SELECT s.season, s.market, count(*) AS n, var_pop(m.e) AS ve, covar_pop(m.e, m.d) AS ced, var_pop(m.d) AS vd FROM (SELECT DISTINCT season, market FROM mo) s JOIN mo m ON m.market = s.market AND m.season < s.season GROUP BY 1, 2) y) z""", _MOM),
    "key_number_weights": b.oracle(["preds"], """SELECT a.fold, a.kind, a.k, round((CASE WHEN a.kind = 'margin' THEN a.o + m.o ELSE a.o END + 20) / (CASE WHEN a.kind = 'margin' THEN a.e + m.e ELSE a.e END + 20), 6) AS weight
FROM ke a LEFT JOIN ke m ON m.fold = a.fold AND m.kind = a.kind AND m.k = -a.k""", _KEYN),
    "top_drivers": b.oracle(["preds"], "SELECT game_id, driver, round(points, 6) AS points FROM top WHERE rk <= 4 AND abs(points) >= 0.1", _DR),
    "risk_flags": b.oracle(["forecasts"], f"""SELECT hash, concat_ws(' | ', CASE WHEN market = 'spread' AND (p_push > 0.04 OR abs(point) IN (2.5, 3.5, 6.5, 7.5)) THEN {_said('risk_key_numbers')} END,
  CASE WHEN abs(model_prob - 0.45 - ev) < 0.005 THEN {_said('risk_price')} END,
  CASE WHEN model_prob - 0.45 <= 0 THEN {_said('risk_market')} END, CASE WHEN ev - 0.01 <= 0 THEN {_said('risk_plain')} END) AS risks,
  concat(upper(left(side, 1)), substr(side, 2), CASE market WHEN 'ml' THEN ' ML' WHEN 'spread' THEN concat(' ', CASE WHEN point >= 0 THEN '+' ELSE '' END, {_PT}) ELSE concat(' ', {_PT}) END) AS label
FROM (SELECT *, (abs(coalesce(point, 0) * 2) % 7) * 0.01 AS p_push FROM forecasts) z"""),
    "line_labels": b.oracle(["games"], "SELECT game_id, CASE WHEN spread_line IS NULL THEN 'n/a' WHEN abs(spread_line) < 0.25 THEN 'PK' ELSE concat(CASE WHEN spread_line > 0 THEN home_team ELSE away_team END, ' -', printf('%.1f', abs(spread_line))) END AS label FROM games"),
    "gap_rule": b.oracle(["preds"], "SELECT game_id, CASE WHEN abs(model_margin - spread_line) >= 4 THEN 1 ELSE 0 END AS spread_blocked, CASE WHEN abs(model_total - total_line) >= 4 THEN 1 ELSE 0 END AS total_blocked FROM preds"),
    "ablation_compare": b.oracle(["preds"], """SELECT target, CAST(sum(n) AS BIGINT) AS n, round(sum(lb) / sum(n), 6) AS logloss_base, round(sum(le) / sum(n), 6) AS logloss_exp, round(sum(le - lb) / sum(n), 6) AS d_logloss, round(sum(db) / sum(n), 6) AS d_brier,
  count(*) FILTER (le - lb < 0) AS seasons_improved, count(*) AS seasons FROM (SELECT target, season, count(*) AS n, sum(-(y * ln(pk) + (1 - y) * ln(1 - pk))) AS lb, sum(-(y * ln(pm) + (1 - y) * ln(1 - pm))) AS le, sum(pow(pm - y, 2) - pow(pk - y, 2)) AS db FROM tg GROUP BY 1, 2) z GROUP BY 1""", T),
    "experiment_gate": b.oracle(["scored"], """SELECT grp0 AS "group", NOT worse AND n > 0 AS passed, CASE WHEN worse THEN 'significantly worse on a target' WHEN n = 0 THEN 'no target improved enough' ELSE 'passes' END AS verdict,
  CASE WHEN NOT worse AND n > 0 THEN ok ELSE '' END AS passed_targets FROM (SELECT grp0, bool_or(m - 0.05 > 0) AS worse, count(*) FILTER (m + 0.02 < 0 AND c >= 5) AS n, string_agg(grp, ',' ORDER BY grp) FILTER (m + 0.02 < 0 AND c >= 5) AS ok
  FROM (SELECT concat('G', length(cluster) - 3) AS grp0, grp, avg(p_model - y) AS m, count(DISTINCT cluster) AS c FROM scored GROUP BY 1, 2) y GROUP BY 1) z"""),
    "holdout_guard": b.oracle([], """SELECT g AS "group", u IN (1, 2, 3, 4) AND NOT used AND dev IS NOT NULL AS allowed, CASE WHEN u NOT IN (1, 2, 3, 4) THEN 'unknown group' WHEN used THEN 'already evaluated on the holdout' WHEN dev IS NULL THEN 'has not passed the development criteria' ELSE '' END AS reason, dev AS dev_targets
FROM (SELECT concat('G', user_id % 6) AS g, user_id % 6 AS u, bool_or(user_id % 6 = 1 AND value > 100) AS used,
    max_by(event_type, event_id) FILTER (NOT (user_id % 6 = 1 AND value > 100) AND value > 20 AND user_id % 6 <> 2) AS dev FROM events GROUP BY 1, 2) z""").replace("WITH \n", ""),
}
