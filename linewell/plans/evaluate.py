"""Walk-forward evaluation, replayed bets, feature-group comparison and its acceptance rules."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.functions import prices, stats
from linewell.functions.joins import materialise
from linewell.operators import metrics
from linewell.plans import pricing
from linewell.plans.model import FeatureSet, FittedModel, fit_walk_forward
from linewell.plans.ratings import MARGIN_FEATURES, TOTAL_FEATURES
from linewell.sources.feed import consensus_quotes

# Experimental feature groups (extra margin features, extra total features).
GROUPS = {"G1": (["f_rush"], ["t_rush"]), "G2": ([], ["t_npace"]), "G3": (["f_avail"], ["t_avail"]), "G4": (["f_olc"], ["t_olc"])}
DEV_IMPROVED = 5
ODDS_PAIRS = (("home_spread_odds", "away_spread_odds"), ("over_odds", "under_odds"), ("home_moneyline", "away_moneyline"))


def walk_forward_predictions(model: FittedModel, games: DataFrame) -> DataFrame:
    """Played games of every test season with model, market and baseline probabilities."""
    c = F.col
    shapes = pricing.outcome_udfs(model)
    p = model.attach(model.predict(games.filter(c("result").isNotNull())))
    p = model.detach(p.withColumns({"p_ratings_only": stats.sigmoid(c("m_ratings_a") + c("m_ratings_b") * c("model_margin")), "p_home_rate": c("m_home_rate"),
                                    "p_market": prices.no_vig(c("home_moneyline"), c("away_moneyline"))}))
    rows = F.array(F.struct(F.lit("ml").alias("market"), F.lit("home").alias("side"), F.lit(None).cast("double").alias("point")),
                   F.struct(F.lit("spread").alias("market"), F.lit("home").alias("side"), (0.0 - c("spread_line")).alias("point")),
                   F.struct(F.lit("total").alias("market"), F.lit("over").alias("side"), c("total_line").alias("point")))
    d = p.select(*pricing.PREDICTION, F.inline(rows)).withColumns({"ref_mu": F.lit(None).cast("double"), "ref_p": F.lit(None).cast("double")})
    d = pricing.with_probability(pricing.with_market(d, model, shapes))

    def pick(market, col):
        return F.max(F.when((c("market") == market) & ((c("market") == "ml") | c("point").isNotNull()), col))
    cond = c("p_win") / (1 - c("p_push"))
    probs = d.groupBy("game_id").agg(pick("ml", c("p_win")).alias("p_model"), pick("spread", cond).alias("p_cover"), pick("spread", c("p_mkt")).alias("p_cover_mkt"),
                                     pick("total", cond).alias("p_over"), pick("total", c("p_mkt")).alias("p_over_mkt"))
    return p.join(probs, "game_id")


def replay_bets(model: FittedModel, games: DataFrame, settings, overround: float | None = None) -> DataFrame:
    """Best sides at the schedule's closing prices (optionally re-quoted at a fixed overround), graded."""
    c = F.col
    g = model.predict(games.filter(c("result").isNotNull()))
    if overround is not None:
        for x, y in ODDS_PAIRS:
            first, second = prices.revig_pair(c(x), c(y), overround)
            g = g.withColumns({x: first, y: second})
    g = materialise(g, "replay")
    q = consensus_quotes(g).withColumn("ord", F.lit(0))
    d = pricing.flag_best_side(pricing.decide(model, g, q, pricing.gap_contexts(g, settings), settings)).filter("is_best_side")
    d = d.drop("season").join(g.select("game_id", "season", "gameday", "home_score", "away_score"), "game_id")
    d = d.withColumn("result", prices.grade(c("market"), c("side"), c("point"), c("home_score"), c("away_score")))
    stake = prices.stake_units(c("kelly"), settings)
    flat = prices.profit(c("result"), c("price"))
    return d.withColumns({"flat": flat, "kelly_stake": stake, "kelly_units": flat * stake})


def placed(bets: DataFrame) -> DataFrame:
    return bets.filter(F.col("decision") != "NO BET")


# ---------------------------------------------------------------- experiments

def compare_arms(base: DataFrame, trial: DataFrame, n_boot: int = 2000) -> DataFrame:
    """Paired metrics per target over games present in both arms."""
    b = metrics.targets(base).select("game_id", "season", "target", "y", F.col("pm").alias("pb"))
    e = metrics.targets(trial).select("game_id", "target", F.col("pm").alias("pe"))
    y = F.col("y")
    j = b.join(e, ["game_id", "target"]).withColumns({"lb": stats.log_loss(F.col("pb"), y), "le": stats.log_loss(F.col("pe"), y),
                                                      "db": stats.squared_error(F.col("pe"), y) - stats.squared_error(F.col("pb"), y)})
    j = materialise(j.withColumn("d", F.col("le") - F.col("lb")), "arms")
    s = paired_summary(j)
    ci = metrics.cluster_bootstrap(j, ["target"], "game_id", "d", n_boot).select("target", F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))
    return s.join(ci, "target")


def paired_summary(j: DataFrame) -> DataFrame:
    """Target means and seasons improved (rows: target, season, lb, le, d, db)."""
    by_season = j.groupBy("target", "season").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("lb", "le", "d", "db")])
    n = F.sum("n")
    return by_season.groupBy("target").agg(
        n.alias("n"), (F.sum("lb") / n).alias("logloss_base"), (F.sum("le") / n).alias("logloss_exp"), (F.sum("d") / n).alias("d_logloss"),
        (F.sum("db") / n).alias("d_brier"), F.count_if(F.col("d") / F.col("n") < 0).alias("seasons_improved"), F.count("*").alias("seasons"))


def own_line_mae(preds: DataFrame, arm: str) -> DataFrame:
    return preds.agg(F.avg(F.abs(F.col("result") - F.col("model_margin"))).alias("margin"),
                     F.avg(F.abs(F.col("total") - F.col("model_total"))).alias("total")).select(F.lit(arm).alias("arm"), "margin", "total")


def development_gate(comparison: DataFrame) -> DataFrame:
    """One row: passed, verdict kind and passed targets (comparison: target, ci_lo, ci_hi, seasons_improved; optional keys first)."""
    keys = [c for c in ("group",) if c in comparison.columns]
    good = (F.col("ci_hi") < 0) & (F.col("seasons_improved") >= DEV_IMPROVED)
    g = comparison.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("ci_lo") > 0), F.lit(False)).alias("worse"),
                                      F.array_sort(F.collect_list(F.when(good, F.col("target")))).alias("ok"))       # three targets
    ok = ~F.col("worse") & (F.size("ok") > 0)
    verdict = F.when(F.col("worse"), "significantly worse on a target").when(F.size("ok") == 0, "no target improved enough").otherwise("passes")
    return g.select(*keys, ok.alias("passed"), verdict.alias("verdict"), F.when(ok, F.array_join("ok", ",")).otherwise("").alias("passed_targets"))


def holdout_gate(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether each requested group may use the holdout (registry: group, period, passed, passed_targets, seq)."""
    r = registry.groupBy("group").agg(
        F.coalesce(F.bool_or(F.col("period") == "holdout"), F.lit(False)).alias("used"),
        F.max_by("passed_targets", F.when((F.col("period") == "development") & F.col("passed"), F.col("seq"))).alias("dev_targets"))
    d = requests.join(r, "group", "left")
    why = (F.when(~F.col("group").isin(*GROUPS), "unknown group").when(F.coalesce("used", F.lit(False)), "already evaluated on the holdout")
           .when(F.col("dev_targets").isNull(), "has not passed the development criteria").otherwise(""))
    return d.select("group", (why == "").alias("allowed"), why.alias("reason"), "dev_targets")


def holdout_verdict(comparison: DataFrame, dev_targets: list[str]) -> DataFrame:
    """The holdout confirms iff every target passed in development is no worse."""
    return comparison.filter(F.col("target").isin(*dev_targets)).agg(F.coalesce(F.bool_and(F.col("d_logloss") <= 0), F.lit(False)).alias("passed"))


def ablate(games: DataFrame, group: str, n_boot: int = 2000, base: FittedModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(comparison, own-line errors) of the baseline features against baseline plus a group."""
    gm, gt = GROUPS[group]
    fs = FeatureSet(tuple(MARGIN_FEATURES + gm), tuple(TOTAL_FEATURES + gt))
    base = base or fit_walk_forward(games)
    trial = fit_walk_forward(games, fs)
    pb, pe = (materialise(walk_forward_predictions(m, games), "arm") for m in (base, trial))
    return compare_arms(pb, pe, n_boot), own_line_mae(pb, "base").unionByName(own_line_mae(pe, "exp"))


def without_passer_feature() -> FeatureSet:
    return FeatureSet(tuple(f for f in MARGIN_FEATURES if f != "f_qb"))
