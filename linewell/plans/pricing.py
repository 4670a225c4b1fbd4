"""Probabilities for any line, expected values with sensitivities, decisions for a slate."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.functions import prices, stats
from linewell.functions.joins import materialise
from linewell.operators import references
from linewell.operators.quotes import expired_quotes, pairs_of, quote_cells
from linewell.plans.model import FittedModel
from linewell.texts import text

TIMED_SOURCES = ("odds_api", "manual")      # fixed values
KEY_SPREADS = (2.5, 3.5, 6.5, 7.5)
SHIFTS = {"worse10": -1.0, "worse05": -0.5, "better05": 0.5}     # points towards the bet


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


@dataclass
class OutcomeShapes:
    """UDFs over the seasons' outcome distributions (a few kB per season travel with the function).

    Every evaluation a priced row needs is made in one call, so rows cross to Python twice in total.
    """
    implied_mean: Callable      # season, is_total, line, p -> mean
    at_line: Callable           # season, is_total, fair, at, ref_line, ref_mu -> t, push, r, live
    scenarios: Callable         # season, is_total, fair, at, ref_line, ref_mu, p_mkt, toward -> shifted, plain and market values


def outcome_udfs(model: FittedModel) -> OutcomeShapes:
    dists = {s: tuple(np.asarray(x, float) for x in v) for s, v in model.dists().items()}

    def groups(season: pd.Series, is_total: pd.Series):
        s_, t_ = season.to_numpy(), is_total.to_numpy(bool)
        for s in np.unique(s_):
            for flag in (False, True):
                m = np.flatnonzero((s_ == s) & (t_ == flag))
                if int(s) in dists and len(m):
                    d = dists[int(s)]
                    yield m, flag, ((d[2], d[3], stats.TOTAL_LO) if flag else (d[0], d[1], stats.MARGIN_LO))

    def over(mu, line, shape, plain=False):
        """Each distinct (mean, line) is computed once: both sides of a market share most of theirs."""
        sd, w, lo = shape
        cond, push = np.full(len(mu), np.nan), np.full(len(mu), np.nan)
        k = np.flatnonzero(~np.isnan(mu) & ~np.isnan(line))
        some, number = stats.distinct_rows(mu[k], line[k])
        c, q = stats.over_push_of(mu[k][some], line[k][some], float(sd), np.ones_like(w) if plain else w, lo)
        cond[k], push[k] = c[number], q[number]
        return cond, push

    def invert(line, p, shape, flag):
        out = np.full(len(line), np.nan)
        k = np.flatnonzero(~np.isnan(line) & ~np.isnan(p))
        some, number = stats.distinct_rows(line[k], p[k])
        out[k] = stats.implied_mean_of(line[k][some], p[k][some], float(shape[0]), shape[1], flag)[number]
        return out

    @F.pandas_udf(T.DoubleType())
    def implied_mean(season: pd.Series, is_total: pd.Series, line: pd.Series, p: pd.Series) -> pd.Series:
        out = np.full(len(line), np.nan)
        for m, flag, shape in groups(season, is_total):
            out[m] = invert(line.to_numpy(float)[m], p.to_numpy(float)[m], shape, flag)
        return pd.Series(out)

    @F.pandas_udf(_struct("t", "push", "r", "live"))
    def at_line(season: pd.Series, is_total: pd.Series, fair: pd.Series, at: pd.Series, ref_line: pd.Series, ref_mu: pd.Series) -> pd.DataFrame:
        out = np.full((4, len(fair)), np.nan)
        cols = [x.to_numpy(float) for x in (fair, at, ref_line, ref_mu)]
        for m, _, shape in groups(season, is_total):
            f, t, ref, mu = (c[m] for c in cols)
            n = len(m)
            cond, push = over(np.concatenate([f, f, mu]), np.concatenate([t, ref, ref]), shape)
            out[0, m], out[1, m], out[2, m], out[3, m] = cond[:n], push[:n], cond[n:2 * n], cond[2 * n:]
        return pd.DataFrame(dict(zip(("t", "push", "r", "live"), out)))

    names = [f"{n}_{x}" for n in SHIFTS for x in ("t", "push")] + ["plain_t", "plain_push", "plain_r", "market"]

    @F.pandas_udf(_struct(*names))
    def scenarios(season: pd.Series, is_total: pd.Series, fair: pd.Series, at: pd.Series, ref_line: pd.Series, ref_mu: pd.Series,
                  p_mkt: pd.Series, toward: pd.Series) -> pd.DataFrame:
        out = {n: np.full(len(fair), np.nan) for n in names}
        cols = [x.to_numpy(float) for x in (fair, at, ref_line, ref_mu, p_mkt, toward)]
        for m, flag, shape in groups(season, is_total):
            f, t, ref, mu, p, d = (c[m] for c in cols)
            own = np.where(np.isnan(mu), invert(np.where(np.isnan(mu), ref, np.nan), p, shape, flag), mu)
            cond, push = over(np.concatenate([*(f + d * by for by in SHIFTS.values()), own]), np.tile(t, len(SHIFTS) + 1), shape)
            cond, push = cond.reshape(-1, len(m)), push.reshape(-1, len(m))
            for k, n in enumerate(SHIFTS):
                out[f"{n}_t"][m], out[f"{n}_push"][m] = cond[k], push[k]
            out["market"][m] = cond[-1]
            cond, push = over(np.tile(f, 2), np.concatenate([t, ref]), shape, plain=True)
            out["plain_t"][m], out["plain_push"][m], out["plain_r"][m] = cond[:len(m)], push[:len(m)], cond[len(m):]
        return pd.DataFrame(out)
    return OutcomeShapes(implied_mean, at_line, scenarios)


@dataclass
class SideView:
    """Column names a priced row must carry."""
    market: Column
    home_or_over: Column
    at: Column          # the bet's line in home / over terms


def side_view() -> SideView:
    c = F.col
    at = F.when((c("market") == "spread") & (c("side") == "home"), 0.0 - c("point")).otherwise(c("point"))
    return SideView(c("market"), c("side").isin("home", "over"), at)


def _known(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def with_market(rows: DataFrame, model: FittedModel, shapes: OutcomeShapes) -> DataFrame:
    """Adds ``fair``, ``ref_line``, ``edge``, ``p_mkt`` (market probability at ``ref_line``) and the outcome values ``o``.

    rows: quotes joined to their game's prediction, with ``ref_mu`` / ``ref_p`` of the live reference (null = none).
    """
    c = F.col
    total, ml = c("market") == "total", c("market") == "ml"
    line = F.when(total, c("total_line")).otherwise(c("spread_line"))
    d = model.attach(rows).withColumns({
        "is_total": total, "fair": F.when(total, c("fair_total")).otherwise(c("fair_margin")), "ref_line": line, "at": side_view().at,
        "cal": F.when(ml, c("m_cal_ml")).when(total, c("m_cal_total")).otherwise(c("m_cal_spread")),
        "edge": F.coalesce(F.when(total, c("blend_total") - c("total_line")).otherwise(c("blend_margin") - c("spread_line")), F.lit(0.0)),
        "_cons": F.when(total, prices.no_vig_or_default(c("over_odds"), c("under_odds")))
                  .when(ml, F.when(c("home_moneyline").isNotNull() & c("away_moneyline").isNotNull(), prices.no_vig_or_default(c("home_moneyline"), c("away_moneyline"))))
                  .otherwise(prices.no_vig_or_default(c("home_spread_odds"), c("away_spread_odds")))})
    d = d.withColumn("o", shapes.at_line("season", "is_total", F.when(~ml, c("fair")), "at", "ref_line", F.when(~ml, c("ref_mu"))))
    p = F.when(ml, F.coalesce("ref_p", "_cons")).otherwise(F.when(line.isNotNull(), F.coalesce(_known(c("o.live")), c("_cons"))))
    return d.withColumn("p_mkt", p).drop("_cons")


def _base(mult: float) -> Column:
    """Market-anchored probability of home / over at the reference line."""
    cal = F.col("cal")
    return stats.sigmoid(cal[0] + cal[1] * stats.logit(F.col("p_mkt")) + cal[2] * F.col("edge") * mult)


def _win(margin: Column) -> Column:
    return stats.sigmoid(F.col("m_ml_a") + F.col("m_ml_b") * margin)


def side_probability(t: Column, push: Column, r: Column, shift: Column, mult: float = 1.0) -> tuple[Column, Column]:
    """(P(win), P(push)) of a side from outcome values at its line (t, push) and at the reference line (r).

    ``shift`` moves the true margin towards home for moneylines (other markets carry it in ``t``);
    ``mult`` scales the model's weight.
    """
    v = side_view()
    moved = _win(F.col("fair_margin") + shift)
    p_ml = F.when(F.col("p_mkt").isNotNull(), _base(mult) + moved - _win(F.col("fair_margin"))).otherwise(moved)
    p_pt = F.when(F.col("ref_line").isNotNull(), _base(mult) + t - r).otherwise(t)
    p = stats.clip(F.when(v.market == "ml", p_ml).otherwise(p_pt), 0.001, 0.999)
    none = F.when(v.market == "ml", 0.0).otherwise(push)
    return F.when(v.home_or_over, p).otherwise(1 - p) * (1 - none), none


def with_probability(d: DataFrame) -> DataFrame:
    """Adds ``p_win`` and ``p_push``."""
    o = F.col("o")
    win, push = side_probability(o["t"], o["push"], o["r"], F.lit(0.0))
    return d.withColumns({"p_win": win, "p_push": push})


def with_scenarios(d: DataFrame, shapes: OutcomeShapes) -> DataFrame:
    """Adds the six sensitivities ``ev_*`` (if a price is present) and ``market_prob``.

    market_prob is the market's own probability of exactly this bet, conditional on no push.
    """
    c, v = F.col, side_view()
    point = F.when(v.market != "ml", c("fair"))
    toward = F.when(v.home_or_over, 1.0).otherwise(-1.0)
    d = d.withColumn("s", shapes.scenarios("season", "is_total", point, "at", "ref_line", F.when(v.market != "ml", c("ref_mu")), "p_mkt", toward))
    s, o = c("s"), c("o")
    out = {}
    for n, by in SHIFTS.items():
        out[n] = side_probability(s[f"{n}_t"], s[f"{n}_push"], o["r"], toward * by)
    out["market_only"] = side_probability(o["t"], o["push"], o["r"], F.lit(0.0), 0.0)
    out["double_weight"] = side_probability(o["t"], o["push"], o["r"], F.lit(0.0), 2.0)
    out["plain"] = side_probability(s["plain_t"], s["plain_push"], s["plain_r"], F.lit(0.0))
    p = F.when(v.market == "ml", c("p_mkt")).otherwise(_known(s["market"]))
    return d.withColumns({**{f"ev_{n}": prices.expected_value(w, q, c("price")) for n, (w, q) in out.items()},
                          "market_prob": F.when(v.home_or_over, p).otherwise(1 - p)})


PREDICTION = ["game_id", "season", "spread_line", "total_line", "home_spread_odds", "away_spread_odds", "over_odds", "under_odds", "home_moneyline",
              "away_moneyline", "model_margin", "model_total", "blend_margin", "blend_total", "fair_margin", "fair_total"]


def decide(model: FittedModel, preds: DataFrame, quotes: DataFrame, contexts: DataFrame, settings, refs: DataFrame | None = None) -> DataFrame:
    """One decision per (game, market, side): the best available quote and everything derived from it.

    quotes: game_id, book, market, side, point, price, source, odds_time, ord (union order, for ties).
    contexts: game_id, conditions, risks, block_spread, block_ml, block_total (string arrays).
    refs: leave-one-book-out references with mu; None replays history at the schedule's prices.
    """
    c = F.col
    shapes = outcome_udfs(model)
    q = quotes.filter(c("price").isNotNull() & ((c("market") == "ml") | c("point").isNotNull()))
    side = ["game_id", "market", "side"]
    if refs is not None:        # live mode: untimed prices only where a side has no live quote
        live = q.groupBy(*side).agg(F.max(c("source") != "consensus").alias("_live"))
        q = q.join(live, side).filter(~c("_live") | (c("source") != "consensus")).drop("_live")
    offer = F.format_string("%s %s%+d", c("book"), F.when(c("point").isNull(), "").otherwise(
        F.concat(F.when((c("market") == "spread") & (c("point") >= 0), "+").otherwise(""), F.regexp_replace(c("point").cast("string"), r"\.0$", ""), F.lit(" "))), c("price").cast("int"))
    seen = q.groupBy(*side).agg(F.count_distinct("book").alias("n_books"), F.array_join(F.array_sort(F.collect_set(offer)), "; ").alias("all_prices"))
    # same book, side and line: only the best price can be chosen, so price one row each
    better = F.max_by(F.struct("source", "odds_time", "ord", "price"), F.struct("price", -c("ord")))
    q = q.groupBy(*side, "book", "point").agg(better.alias("b")).select(*side, "book", "point", "b.*")
    if refs is not None:
        q = references.attach_reference(q, refs)
    else:
        q = q.withColumns({"ref_mu": F.lit(None).cast("double"), "ref_p": F.lit(None).cast("double"), "ref_n_books": F.lit(None).cast("bigint"),
                           "ref_books": F.lit(None).cast("string"), "ref_oldest": F.lit(None).cast("timestamp")})
    d = with_probability(with_market(q.join(preds.select(*PREDICTION), "game_id"), model, shapes))
    d = d.withColumn("ev", prices.expected_value(c("p_win"), c("p_push"), c("price")))
    best = Window.partitionBy(*side).orderBy(F.desc("ev"), "ord", "book")
    d = d.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")
    d = model.detach(with_scenarios(d, shapes)).drop("o", "s", "cal").join(seen, side).join(contexts, "game_id", "left")
    return finish_decisions(d, settings)


def finish_decisions(d: DataFrame, settings) -> DataFrame:
    """Decision ladder, reasons, stakes and risk flags of priced sides."""
    c = F.col
    none = F.array().cast("array<string>")
    block = F.coalesce(F.when(c("market") == "spread", c("block_spread")).when(c("market") == "ml", c("block_ml")).otherwise(c("block_total")), none)
    cond = F.coalesce("conditions", none)
    edge = f"{settings.min_edge:.0%}"

    def pct(x):
        return F.format_string("%+.1f%%", x * 100)
    d = d.withColumns({"min_price": prices.price_for_edge(c("p_win"), c("p_push"), settings.min_edge),
                       "kelly": prices.kelly(c("p_win"), c("p_push"), c("price")), "implied": prices.implied(c("price")),
                       "model_prob": c("p_win") / (1 - c("p_push")), "reference_live": c("ref_n_books").isNotNull()})
    first = (F.when(c("ev") <= settings.min_edge, text("low_value", pct(c("ev")), F.lit(edge)))
             .when(c("ev_worse05") <= 0, text("fragile", pct(c("ev_worse05")))))
    no = F.concat(F.array_compact(F.array(first)), block)
    timed = c("source").isin(*TIMED_SOURCES)
    sure = timed & c("reference_live")
    waits = F.size(cond) > 0
    decision = (F.when(F.size(no) > 0, "NO BET").when(sure & ~waits, "BET").when(sure, "BET IF CONFIRMED").otherwise("BET IF PRICE AVAILABLE"))
    listed = F.array_join(cond, "; ")
    why = F.when(~timed, text("untimed")).otherwise(text("no_reference"))
    at_least = F.coalesce(F.format_string("%+d", c("min_price").cast("int")), F.lit("n/a"))
    later = F.array_compact(F.array(
        text("take_at", why, at_least, F.lit(edge)), F.when(waits, text("also_condition", listed))))
    reasons = (F.when(F.size(no) > 0, no).when(sure & ~waits, none).when(sure, F.array(text("condition", listed))).otherwise(later))
    d = d.withColumn("decision", decision).withColumn("reasons", F.array_join(reasons, " | "))
    return d.withColumns({
        "stake_units": F.when(c("decision") != "NO BET", prices.stake_units(c("kelly"), settings)).otherwise(0.0),
        "risks": F.array_join(F.concat(F.coalesce("risks", none), risk_flags()), " | ")})


def risk_flags() -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when((c("market") == "spread") & ((c("p_push") > 0.04) | F.abs("point").isin(*KEY_SPREADS)), text("risk_key_numbers")),
        F.when(F.abs(c("ev_market_only") - c("ev")) < 0.005, text("risk_price")),
        F.when(c("ev_market_only") <= 0, text("risk_market")),
        F.when(c("ev_plain") <= 0, text("risk_plain"))))


def flag_best_side(rows: DataFrame) -> DataFrame:
    """is_best_side: the higher-value side of each (game, market)."""
    w = Window.partitionBy("game_id", "market").orderBy(F.desc("ev"), "side")      # two rows
    return rows.withColumn("is_best_side", F.row_number().over(w) == 1)


def gap_contexts(preds: DataFrame, settings) -> DataFrame:
    """Contexts of the historical replay: only the model-versus-market gap rule."""
    c = F.col
    m = F.abs(c("model_margin") - c("spread_line")) >= settings.gap_points
    t = F.abs(c("model_total") - c("total_line")) >= settings.gap_points
    none = F.array().cast("array<string>")

    def gap(x):
        return F.when(x, F.array(F.lit("gap"))).otherwise(none)
    return preds.select("game_id", none.alias("conditions"), none.alias("risks"), gap(m).alias("block_spread"), gap(m).alias("block_ml"), gap(t).alias("block_total"))


def slate_references(valid: DataFrame, games: DataFrame, model: FittedModel, settings) -> DataFrame:
    """Leave-one-book-out references with implied means from the season's own outcome distribution."""
    implied_mean = outcome_udfs(model).implied_mean
    cells = materialise(quote_cells(valid), "cells")
    pairs = pairs_of(cells).join(games.select("game_id", "season"), "game_id")
    pairs = pairs.withColumn("mu", implied_mean("season", F.col("market") == "total", "line", "p")).drop("season")
    return references.build_references(pairs, settings.min_reference_books, quoted=cells)


def price_slate(model: FittedModel, games: DataFrame, valid: DataFrame, consensus: DataFrame, settings,
                contexts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Prices a slate from a given set of valid quotes; nothing carries over from another set.

    games: features and schedule columns of the slate; contexts: predictions -> context rows.
    """
    refs = materialise(slate_references(valid, games, model, settings), "references")
    preds = materialise(model.predict(references.live_lines(games, refs)), "predictions")
    q = valid.withColumn("ord", F.col("event_id")).unionByName(consensus.withColumn("ord", F.lit(1 << 60)), allowMissingColumns=True)
    return flag_best_side(decide(model, preds, q, contexts(preds), settings, refs))


def reprice_until_stable(price: Callable[[DataFrame], DataFrame], revalidate: Callable[[int], DataFrame], initial: DataFrame, max_reprice: int = 2):
    """Prices, revalidates all quotes at completion, and prices again while the valid set changed.

    ``revalidate(i)`` gives the quotes valid at the completion time of pass i.  Returns (rows, info).
    """
    valid, rows = initial, price(initial)
    info = {"repriced": 0, "stable": False, "expired_quotes": 0}
    while True:
        current = materialise(revalidate(info["repriced"]), "valid")
        gone, new = expired_quotes(valid, current), expired_quotes(current, valid)
        n_gone = gone.count()
        if n_gone == 0 and new.isEmpty():
            info["stable"] = True
            return rows, info
        if info["repriced"] >= max_reprice:
            return rows, info
        info["expired_quotes"] += n_gone
        valid, rows = current, price(current)
        info["repriced"] += 1
