"""Scoring, calibration, drawdown and cluster-bootstrap intervals."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions import stats
from linewell.functions.joins import lookup

# Bin edges of the calibration table, and evenly spaced edges as floating point yields them.
TABLE_EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
EVEN_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)
TARGETS = ("winner", "home covers", "over hits")
CLUSTERS_PER_BLOCK = 4096
BETS_PER_BLOCK = 1024       # of a drawdown
BET_COLUMNS = ("market", "side", "game_id", "gameday", "result", "flat", "kelly_units", "kelly_stake")     # what ``bet_table`` reads


def bin_of(p: Column, edges=TABLE_EDGES) -> Column:
    """Label of the right-closed bin; the first bin includes its left edge."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        left = "-0.001" if lo == 0 else f"{lo:g}"
        out = F.when((p <= hi) & (p >= 0), f"({left}, {hi:g}]").otherwise(out)
    return out


def targets(preds: DataFrame) -> DataFrame:
    """Rows on which model and market both have a probability, per target; pushes are left out.

    One pass over the predictions (each row yields up to three target rows).
    """
    c = F.col

    def row(name, pm, pk, y, keep):
        return F.struct(F.lit(name).alias("target"), pm.alias("pm"), pk.alias("pk"), F.when(y, 1.0).otherwise(0.0).alias("y"),
                        F.coalesce(keep & pm.isNotNull() & pk.isNotNull(), F.lit(False)).alias("keep"))
    rows = F.array(
        row(TARGETS[0], c("p_model"), c("p_market"), c("result") > 0, c("result") != 0),
        row(TARGETS[1], c("p_cover"), c("p_cover_mkt"), c("result") > c("spread_line"), c("result") != c("spread_line")),
        row(TARGETS[2], c("p_over"), c("p_over_mkt"), c("total") > c("total_line"), c("total") != c("total_line")))
    return (preds.select("game_id", "season", "p_ratings_only", "p_home_rate", F.inline(rows)).filter("keep").drop("keep"))


def unpivot_predictors(t: DataFrame) -> DataFrame:
    """Each predictor on exactly the same rows: game_id, season, target, predictor, p, y."""
    win = F.col("target") == TARGETS[0]

    def one(name, p, when=F.lit(True)):
        return F.struct(F.lit(name).alias("predictor"), p.alias("p"), when.alias("keep"))
    preds = F.array(one("model", F.col("pm")), one("market no-vig (closing)", F.col("pk")), one("coin flip", F.lit(0.5)),
                    one("ratings only (no market)", F.col("p_ratings_only"), win), one("home-team base rate", F.col("p_home_rate"), win))
    return t.select("game_id", "season", "target", "y", F.inline(preds)).filter("keep").drop("keep")


def calibration_table(d: DataFrame, keys: list[str], p: str = "p", y: str = "y", edges=TABLE_EDGES) -> DataFrame:
    return (d.withColumn("bin", bin_of(F.col(p), edges)).groupBy(*keys, "bin")
            .agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("actual")))


def ece(d: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Expected calibration error: bin-weighted |predicted - actual|."""
    t = calibration_table(d, keys, p, y, EVEN_EDGES).filter("bin is not null")
    gap = F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual"))) / F.sum("n")
    return t.groupBy(*keys).agg(gap.alias("ece"))


def score_predictors(t: DataFrame) -> DataFrame:
    """Brier, log loss and calibration error per target and predictor."""
    u = unpivot_predictors(t)
    s = u.groupBy("target", "predictor").agg(F.count("*").alias("n"), F.avg(stats.squared_error(F.col("p"), F.col("y"))).alias("brier"),
                                             F.avg(stats.log_loss(F.col("p"), F.col("y"))).alias("log_loss"))
    e = ece(u.filter("predictor <> 'coin flip'"), ["target", "predictor"])
    return s.join(e, ["target", "predictor"], "left")


def paired_difference() -> Column:
    """Model minus market squared error of one row (negative: the model is better)."""
    m, k = F.col("pm") - F.col("y"), F.col("pk") - F.col("y")
    return m * m - k * k


def prob_table(preds: DataFrame, n_boot: int = 1000) -> DataFrame:
    """``score_predictors`` plus one model-minus-market row per target with its bootstrap interval."""
    t = targets(preds)
    nulls = {"ci_lo": F.lit(None).cast("double"), "ci_hi": F.lit(None).cast("double")}
    ci = cluster_bootstrap(t.withColumn("diff", paired_difference()), ["target"], "game_id", "diff", n_boot)
    n = t.groupBy("target").agg(F.count("*").alias("n"))
    diff = ci.join(n, "target").select("target", F.lit("model minus market (Brier)").alias("predictor"), "n", F.col("est").alias("brier"),
                                       F.lit(None).cast("double").alias("log_loss"), F.lit(None).cast("double").alias("ece"), F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))
    return score_predictors(t).withColumns(nulls).unionByName(diff)


def season_differences(t: DataFrame) -> DataFrame:
    """Season x target table of the mean paired difference."""
    return t.groupBy("season").pivot("target", list(TARGETS)).agg(F.avg(paired_difference()))


def calibration_bins(t: DataFrame) -> DataFrame:
    """Model and market calibration of the winner target side by side (full outer join on the bin)."""
    w = t.filter(F.col("target") == TARGETS[0])
    m = calibration_table(w, [], "pm").select("bin", F.col("n"), F.col("predicted").alias("model_predicted"), "actual")
    k = calibration_table(w, [], "pk").select("bin", F.col("n").alias("n_market"), F.col("predicted").alias("market_predicted"), F.col("actual").alias("actual_market_bins"))
    return m.join(k, "bin", "full_outer")


def mae_by_season(preds: DataFrame) -> DataFrame:
    def mae(c):
        return F.avg(F.abs(F.col("result") - F.col(c)))
    return preds.groupBy("season").agg(F.count("*").alias("games"), mae("spread_line").alias("mae_market"),
                                       mae("model_margin").alias("mae_model"), mae("fair_margin").alias("mae_fair"))


# ---------------------------------------------------------------- bets

def max_drawdown(d: DataFrame, keys: list[str], value: str, day: str, order: list[str], block: Column | None = None) -> DataFrame:
    """Largest fall of the cumulative sum of ``value`` below its running peak (the peak starts at 0).

    The series is cut into consecutive blocks (a day, or a finer ``block`` inside a day that respects
    the order).  Each block is summarised by its total, highest and lowest prefix and inner drawdown;
    block summaries are then chained.  No task ever sorts the whole series.
    """
    b = block if block is not None else F.lit(0)
    d = d.withColumn("_block", b).select(*keys, F.col(day).alias("_day"), "_block", *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).alias("_v"))
    part = [*keys, "_day", "_block"]
    run = Window.partitionBy(*part).orderBy(*[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_c", F.sum("_v").over(run)).withColumn("_m", F.max("_c").over(run))
    blocks = d.groupBy(*part).agg(F.sum("_v").alias("total"), F.max("_c").alias("top"), F.min("_c").alias("low"), F.max(F.col("_m") - F.col("_c")).alias("inner"))
    over = Window.partitionBy(*keys).orderBy("_day", "_block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    x = blocks.withColumn("_start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    x = x.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_start") + F.col("top")).over(before), F.lit(0.0)), F.lit(0.0)))
    fall = F.greatest(F.col("inner"), F.col("_peak") - (F.col("_start") + F.col("low")), F.lit(0.0))
    return x.groupBy(*keys).agg(F.max(fall).alias("drawdown"))


def with_grand_total(bets: DataFrame) -> DataFrame:
    """Each bet once under its market and once under 'all'."""
    return bets.withColumn("market", F.explode(F.array("market", F.lit("all"))))


def bet_totals(bets: DataFrame) -> DataFrame:
    """Per market and over all markets, from grouping sets over one scan (bets: result, flat, kelly_units, kelly_stake)."""
    g = (bets.rollup("market").agg(
        F.count("*").alias("bets"), F.count_distinct("game_id").alias("games"), F.count_if(F.col("result") == "W").alias("won"),
        F.count_if(F.col("result") == "L").alias("lost"), F.count_if(F.col("result") == "P").alias("pushed"), F.avg("flat").alias("flat_roi"),
        F.sum("flat").alias("flat_units"), (F.sum("kelly_units") / F.nullif(F.sum("kelly_stake"), F.lit(0.0))).alias("kelly_roi")))
    return g.withColumn("market", F.coalesce("market", F.lit("all")))


def day_blocks(bets: DataFrame) -> DataFrame:
    """Adds ``block``: ranges of a day's games of about ``BETS_PER_BLOCK`` bets each.

    Games of a day are spread over all leagues, so ranges of a fixed width hold hardly more than a bet each where there are many leagues,
    and the chain of blocks is as long as the table.
    """
    first, count = F.min("game_id"), F.ceil(F.count("*") / BETS_PER_BLOCK)
    days = bets.groupBy("gameday").agg(first.alias("_first"), F.ceil((F.max("game_id") - first + 1) / count).alias("_width"))
    block = F.floor((F.col("game_id") - F.col("_first")) / F.col("_width"))
    return lookup(bets, days, ["gameday"]).withColumn("block", block).drop("_first", "_width")     # one row per day


def bet_table(bets: DataFrame, n_boot: int = 1000) -> DataFrame:
    """``bet_totals`` with game-clustered intervals of the flat return and both drawdowns."""
    both = with_grand_total(day_blocks(bets))
    block = F.col("block")
    order = ["game_id", "side"]
    flat = max_drawdown(both, ["market"], "flat", "gameday", order, block).withColumnRenamed("drawdown", "flat_drawdown")
    kelly = max_drawdown(both, ["market"], "kelly_units", "gameday", order, block).withColumnRenamed("drawdown", "kelly_drawdown")
    ci = cluster_bootstrap(both, ["market"], "game_id", "flat", n_boot).select("market", F.col("lo").alias("roi_lo"), F.col("hi").alias("roi_hi"))
    return bet_totals(bets).join(ci, "market", "left").join(flat, "market", "left").join(kelly, "market", "left")


def bet_seasons(bets: DataFrame) -> DataFrame:
    return bets.groupBy("season").agg(F.count("*").alias("bets"), F.sum("flat").alias("flat_units"), F.avg("flat").alias("flat_roi"))


# ---------------------------------------------------------------- cluster bootstrap

def _clusters(d: DataFrame, keys: list[str], cluster: str, value: str) -> DataFrame:
    return (d.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(cluster).cast("string").alias("_c"))
            .agg(F.sum(value).alias("s"), F.count(value).alias("n")))


def _interval(sims: DataFrame, clusters: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    q = F.percentile("stat", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    ci = sims.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    est = clusters.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("est"))
    return est.join(ci, keys) if keys else est.join(ci, F.lit(True))


def cluster_bootstrap(d: DataFrame, keys: list[str], cluster: str, value: str, n: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean of ``value`` with a percentile interval from resampling whole clusters with replacement.

    A resample of G clusters is a multinomial draw.  It is drawn in two exact steps: first how many
    draws fall into each block of about 4096 clusters, then how they spread inside the block.  Only
    block totals per replicate are shuffled (G/4096 x n rows), not G x n drawn rows, and no task holds
    more than one block.  Seeds depend on (seed, block, keys), so results are repeatable.
    """
    g = _clusters(d, keys, cluster, value)
    sizes = g.groupBy(*keys).agg(F.count("*").alias("_g"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_g") / CLUSTERS_PER_BLOCK))
    placed = (g.join(sizes, keys) if keys else g.join(F.broadcast(sizes), F.lit(True)))
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("_c"), blocks).cast("bigint"))
    per_block = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_k"), F.first("_g").alias("_g"))
    # draws per block and replicate: conditional binomials along the blocks of a key
    key_text = F.concat_ws("\x1f", *keys) if keys else F.lit("")
    sizes_in = per_block.select(*keys, key_text.alias("_key"), "_b", "_k", "_g").repartition(*(keys or ["_g"])).sortWithinPartitions("_key", "_b")
    schema = "_key string, _b long, draws array<long>"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for batch in batches:
            out = []
            for key, b, k, total in zip(batch["_key"], batch["_b"], batch["_k"], batch["_g"]):
                left_draws, left_clusters, rng = state.get(key) or (
                    np.full(n, total, dtype=np.int64), int(total), np.random.default_rng([seed, *key.encode()]))
                take = left_draws.copy() if k == left_clusters else rng.binomial(left_draws, k / left_clusters)
                state[key] = (left_draws - take, left_clusters - int(k), rng)
                out.append((key, b, take.tolist()))
            yield pd.DataFrame(out, columns=["_key", "_b", "draws"])
    draws = sizes_in.select("_key", "_b", "_k", "_g").mapInPandas(split, schema)
    members = placed.select(key_text.alias("_key"), "_b", "_c", "s", "n")
    sims_schema = "_key string, rep int, s double, n double"

    def inside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_key": [], "rep": [], "s": [], "n": []})
        left = left.sort_values("_c")
        key, b = left["_key"].iloc[0], int(left["_b"].iloc[0])
        counts = np.asarray(right["draws"].iloc[0], dtype=np.int64)
        rng = np.random.default_rng([seed + 1, b, *key.encode()])
        w_ = rng.multinomial(counts, np.full(len(left), 1 / len(left)))
        return pd.DataFrame({"_key": key, "rep": np.arange(n, dtype=np.int32), "s": w_ @ left["s"].to_numpy(float), "n": w_ @ left["n"].to_numpy(float)})
    part = members.groupBy("_key", "_b").cogroup(draws.groupBy("_key", "_b")).applyInPandas(inside, sims_schema)
    sims = part.groupBy("_key", "rep").agg((F.sum("s") / F.sum("n")).alias("stat"))
    if keys:
        names = sizes.select(*keys, key_text.alias("_key"))
        sims = sims.join(names, "_key").drop("_key")
    return _interval(sims, g, keys, alpha)


def cluster_bootstrap_hashed(d: DataFrame, keys: list[str], cluster: str, value: str, n: int, alpha: float = 0.05) -> DataFrame:
    """The same interval with draws taken from SHA-256, so that any engine can repeat them.

    Meant for few clusters (every draw is a row); use :func:`cluster_bootstrap` otherwise.
    """
    g = _clusters(d, keys, cluster, value)
    w = Window.partitionBy(*keys).orderBy("_c") if keys else Window.partitionBy(F.lit(0)).orderBy("_c")
    ranked = g.withColumn("_i", F.row_number().over(w) - 1)
    sizes = g.groupBy(*keys).agg(F.count("*").alias("_g"))
    draws = (sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_g") - 1))))
    u = F.conv(F.substring(F.sha2(F.concat_ws("-", "rep", "_j"), 256), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    draws = draws.withColumn("_i", F.floor(u * F.col("_g")).cast("int"))
    sims = draws.join(ranked, [*keys, "_i"]).groupBy(*keys, "rep").agg((F.sum("s") / F.sum("n")).alias("stat"))
    return _interval(sims, g, keys, alpha)
