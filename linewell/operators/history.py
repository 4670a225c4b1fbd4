"""Append-only forecast history: horizon selection, coverage, grading, settlement."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions import prices, stats, times
from linewell.operators.validity import MARKETS

# Statuses in report order; the first three count as closed windows.
STATUSES = ("eligible", "forecasts exist, none qualify", "no forecast recorded", "window not closed", "unknown kickoff")
TIERS = {"BET": "executable", "BET IF CONFIRMED": "conditional", "BET IF PRICE AVAILABLE": "conditional", "NO BET": "pass"}
MICROS = 60_000_000


def tier_of(decision: Column) -> Column:
    out = F.lit("pass")
    for d, t in TIERS.items():
        out = F.when(decision == d, t).otherwise(out)
    return out


def _with_times(fc: DataFrame, settings) -> DataFrame:
    issued = times.issue_time(times.parse_utc(F.col("recorded_utc")), times.parse_utc(F.col("prediction_completed_utc")))
    d = fc.withColumns({"_issued": issued, "_kick": times.parse_utc(F.col("kickoff_utc")),
                        "_run": F.coalesce("run_id", F.concat(F.lit("legacy@"), "recorded_utc"))})
    lead = times.minutes_between(F.col("_kick"), F.col("_issued"))
    lo, hi = settings.horizon_minutes, settings.horizon_minutes + settings.horizon_tolerance_minutes
    return d.withColumns({"_lead": lead, "_ok": F.coalesce(lead.between(lo, hi), F.lit(False))})


def _runs(d: DataFrame) -> DataFrame:
    """One row per (game, run)."""
    return d.groupBy("game_id", "_run").agg(
        F.max("_issued").alias("issued"), F.min("_ok").alias("ok"), F.min("_lead").alias("lead"), F.min("kickoff_utc").alias("kickoff_utc"))


def horizon_coverage(fc: DataFrame, settings) -> DataFrame:
    """Per game: the latest run whose forecasts all fall inside the window, or why there is none.

    Forecasts are folded to runs first, then runs to games; both are plain aggregations.
    """
    h, tol = settings.horizon_minutes, settings.horizon_tolerance_minutes
    ok = F.col("ok")
    g = (_runs(_with_times(fc, settings)).groupBy("game_id")
         .agg(F.count("*").alias("runs_considered"), F.min("kickoff_utc").alias("kickoff_utc"),
              F.max_by(F.struct("_run", "lead"), F.when(ok, F.struct("issued", "_run"))).alias("pick"),
              F.count("issued").alias("timed"), F.max("lead").alias("max_lead"), F.min("lead").alias("min_lead"),
              F.count("lead").alias("leads"), F.count_if(F.col("lead") < h).alias("late")))
    has = F.col("pick").isNotNull()
    why = (F.when(has, "").when(F.col("timed") == 0, "only legacy forecasts (completion time unknown)")
           .when(F.col("late") == F.col("runs_considered"), f"all forecasts issued after the cutoff (kickoff - {h:g} min)")
           .when(F.col("leads") > 0, F.concat(F.lit(f"no forecast issued inside the {tol:g}-min window (closest lead "),
                                              F.rint("min_lead").cast("bigint").cast("string"), F.lit(" min)")))
           .otherwise("no usable issue time"))
    return g.select("game_id", "kickoff_utc", F.when(has, "eligible").otherwise("excluded").alias("status"), "runs_considered",
                    F.col("pick._run").alias("selected_run"), F.col("pick.lead").alias("lead_minutes"), why.alias("reason"))


def at_horizon(fc: DataFrame, settings) -> DataFrame:
    """All forecast rows of each game's selected run, with lead_minutes; runs are never mixed."""
    cov = horizon_coverage(fc, settings).filter("status = 'eligible'").select("game_id", F.col("selected_run").alias("_run"))
    return (_with_times(fc, settings).join(cov, ["game_id", "_run"])
            .withColumn("lead_minutes", F.col("_lead")).drop("_run", "_issued", "_kick", "_lead", "_ok"))


def slate_coverage(slate: DataFrame, fc: DataFrame, settings, now: Column, markets=MARKETS) -> DataFrame:
    """Exactly one status per slate game (slate: game_id, week, kickoff, played)."""
    kept = fc.filter(F.col("market").isin(*markets))
    cov = horizon_coverage(kept, settings).select("game_id", F.col("status").alias("_s"), F.col("reason").alias("_why"), "lead_minutes")
    closes = F.timestamp_micros(F.unix_micros("kickoff") - F.lit(int(settings.horizon_minutes * MICROS)))
    d = slate.join(cov, "game_id", "left").withColumn("_closes", closes)
    status = (F.when(F.col("kickoff").isNull(), STATUSES[4]).when(F.col("_s") == "eligible", STATUSES[0])
              .when(now < F.col("_closes"), STATUSES[3]).when(F.col("_s").isNotNull(), STATUSES[1]).otherwise(STATUSES[2]))
    d = d.withColumn("status", status)
    st = F.col("status")
    reason = (F.when(st == STATUSES[4], "kickoff time not listed in the schedule")
              .when(st == STATUSES[3], F.concat(F.lit("evaluation window closes "), times.iso(F.col("_closes"))))
              .when(st == STATUSES[1], F.col("_why")).otherwise(""))
    return d.select("game_id", "week", times.iso(F.col("kickoff")).alias("kickoff_utc"), "status", reason.alias("reason"),
                    "played", F.when(st == STATUSES[0], F.col("lead_minutes")).alias("lead_minutes"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Games per status in fixed order, zeros included; share of the closed windows for the first three."""
    dim = coverage.sparkSession.createDataFrame(list(enumerate(STATUSES)), "ord int, status string")
    n = coverage.groupBy("status").agg(F.count("*").alias("games"))
    d = dim.join(n, "status", "left").withColumn("games", F.coalesce("games", F.lit(0)))
    closed = F.col("ord") < 3
    total = F.sum(F.when(closed, F.col("games"))).over(Window.partitionBy())      # five rows
    return d.select("ord", "status", "games", F.when(closed & (total > 0), F.col("games") / total).alias("pct_of_closed_windows"))


def market_coverage(coverage: DataFrame, selected: DataFrame, markets=MARKETS) -> DataFrame:
    """Per market: eligible games, games with a forecast or a market reference, missing games.

    Each eligible game is joined to its own forecasts; markets are a fixed list of three.
    """
    elig = coverage.filter(F.col("status") == "eligible").select("game_id")
    have = selected.groupBy("game_id", "market").agg(F.max(F.col("market_prob").isNotNull()).alias("ref"))
    pairs = elig.withColumn("market", F.explode(F.array(*[F.lit(m) for m in markets]))).join(have, ["game_id", "market"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("ref").isNull(), F.col("game_id"))))
    return pairs.groupBy("market").agg(
        F.count("*").alias("eligible_games"), F.count("ref").alias("with_forecast"), F.count_if("ref").alias("with_market_reference"),
        F.count_if(F.col("ref").isNull()).alias("missing"), F.array_join(missing.cast("array<string>"), ",").alias("missing_games"))


SCORES = ["game_id", "home_score", "away_score", "spread_line", "total_line", "home_moneyline", "away_moneyline"]


def with_results(bets: DataFrame, games: DataFrame) -> DataFrame:
    """Result, flat profit and closing-line value of bets or forecasts; null until the game is final."""
    c = F.col
    d = bets.join(games.select(*SCORES), "game_id", "left")
    d = d.withColumn("result", prices.grade(c("market"), c("side"), c("point"), c("home_score"), c("away_score")))
    clv = prices.closing_value(c("market"), c("side"), c("point"), c("price"), c("spread_line"), c("total_line"), c("home_moneyline"), c("away_moneyline"))
    return d.withColumns({"flat": prices.profit(c("result"), c("price")), "clv": clv})


def score_table(graded: DataFrame) -> DataFrame:
    """Model and market scores on identical decided rows, by market and model version."""
    d = graded.filter(F.col("result").isin("W", "L") & F.col("model_prob").isNotNull() & F.col("market_prob").isNotNull())
    y = F.when(F.col("result") == "W", 1.0).otherwise(0.0)
    m, k = F.col("model_prob"), F.col("market_prob")
    return (d.groupBy("market", F.coalesce("model_version", F.lit("unknown")).alias("model_version"))
            .agg(F.count_distinct("game_id").alias("games"), F.count("*").alias("sides"),
                 F.avg(stats.squared_error(m, y)).alias("model_brier"), F.avg(stats.squared_error(k, y)).alias("market_brier"),
                 F.avg(stats.log_loss(m, y)).alias("model_logloss"), F.avg(stats.log_loss(k, y)).alias("market_logloss")))


def best_sides(fc: DataFrame) -> DataFrame:
    """The recorded best-side flag, or the highest-value side of a (game, market) where none was recorded."""
    top = fc.groupBy("game_id", "market").agg(F.max_by("hash", F.struct("ev", "hash")).alias("_top"))
    flag = F.coalesce("is_best_side", F.col("hash") == F.col("_top"))
    return fc.join(top, ["game_id", "market"]).withColumn("best", flag).drop("_top")


def settlement_by_tier(graded: DataFrame) -> DataFrame:
    """Hypothetical flat results of the best sides, per recommendation tier."""
    d = best_sides(graded).filter(F.col("best") & F.col("tier").isin("executable", "conditional"))
    r = F.col("result")
    return d.groupBy("tier").agg(
        F.count_if(r == "W").alias("won"), F.count_if(r == "L").alias("lost"), F.count_if(r == "P").alias("pushed"),
        F.sum("flat").alias("units"), F.avg(F.when(r.isNotNull(), F.col("clv"))).alias("avg_clv"), F.count_if(r.isNull()).alias("pending"))


def ledger_summary(wagers: DataFrame, games: DataFrame) -> DataFrame:
    """Actual wagers without the voided ones: record, staked, profit, ROI, average closing-line value."""
    d = with_results(wagers.filter(F.col("voided").isNull()), games).withColumn("units", F.col("flat") * F.col("stake_units"))
    r, done = F.col("result"), F.col("result").isNotNull()
    return d.groupBy("market").agg(
        F.count("*").alias("placed"), F.count_if(done).alias("settled"), F.count_if(r == "W").alias("won"), F.count_if(r == "L").alias("lost"),
        F.count_if(r == "P").alias("pushed"), F.sum(F.when(done, F.col("stake_units"))).alias("staked"), F.sum("units").alias("profit"),
        (F.sum("units") / F.sum(F.when(done, F.col("stake_units")))).alias("roi"), F.avg(F.when(done, F.col("clv"))).alias("avg_clv"))


def lead_times(coverage: DataFrame) -> DataFrame:
    """Lead minutes of the selected runs, folded to counts first (leads lie inside the window)."""
    n = coverage.filter("status = 'eligible'").groupBy("lead_minutes").agg(F.count("*").alias("n"))
    return n.agg(F.min("lead_minutes").alias("lead_min"), F.expr("percentile(lead_minutes, 0.5, n)").alias("lead_median"), F.max("lead_minutes").alias("lead_max"))


def tier_counts(fc: DataFrame) -> DataFrame:
    return fc.groupBy("run_id", "tier").agg(F.count("*").alias("n"))


def graded_days(graded: DataFrame, games: DataFrame) -> DataFrame:
    """Flagged sides of a past slate per day and market: record and units."""
    d = best_sides(graded).filter(F.col("best") & (F.col("decision") != "NO BET")).join(games.select("game_id", "gameday"), "game_id")
    r = F.col("result")
    return d.groupBy("gameday", "market").agg(F.count("*").alias("bets"), F.count_if(r == "W").alias("won"),
                                              F.count_if(r == "L").alias("lost"), F.sum("flat").alias("units"))


def recheck(rows: DataFrame, kickoffs: DataFrame, completed: Column, settings) -> DataFrame:
    """Decisions re-examined at completion: kicked-off games, quotes or references stale by then.

    rows: game_id, decision, reasons, odds_time, reference_live, reference_oldest_utc, stake_units.
    """
    age_limit = int(settings.max_odds_age_minutes * MICROS)
    d = rows.join(kickoffs.select("game_id", F.col("kickoff").alias("_k")), "game_id", "left")

    def old(text):
        t = times.parse_utc(text)
        return t.isNull() | (F.unix_micros(completed) - F.unix_micros(t) > age_limit)
    late = F.col("_k").isNull() | (completed >= F.col("_k"))
    open_bet = F.col("decision").isin("BET", "BET IF CONFIRMED")
    quote_old = open_bet & F.col("odds_time").isNotNull() & old(F.col("odds_time"))
    ref_old = open_bet & ~quote_old & F.coalesce("reference_live", F.lit(False)) & old(F.col("reference_oldest_utc"))
    done = times.iso(completed)
    extra = (F.when(late, F.concat(F.lit("kickoff passed before the run completed at "), done))
             .when(quote_old, F.concat(F.lit("quote from "), "odds_time", F.lit(" was stale by completion ("), done, F.lit("); reconfirm the price")))
             .when(ref_old, F.concat(F.lit("market reference quotes expired by completion ("), done, F.lit("; oldest "),
                                     F.coalesce("reference_oldest_utc", F.lit("None")), F.lit("); EV is not current, reconfirm the market"))))
    decision = F.when(late, "NO BET").when(quote_old | ref_old, "BET IF PRICE AVAILABLE").otherwise(F.col("decision"))
    d = d.withColumns({"_d": decision, "_x": extra, "post_kickoff": late})
    reasons = F.concat_ws(" | ", F.when(F.coalesce("reasons", F.lit("")) != "", F.col("reasons")), "_x")
    return (d.withColumns({"reasons": reasons, "decision": F.col("_d"),
                           "stake_units": F.when(F.col("_d") == "NO BET", 0.0).otherwise(F.col("stake_units"))}).drop("_k", "_d", "_x"))
