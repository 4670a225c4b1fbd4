"""Walk-forward regressions and calibration from additive statistics.

All folds are fitted together.  A fold is a calendar season; per-season sums (Gram matrices, moments,
logistic gradients) are aggregated once over the games and accumulated over earlier seasons.  Only
per-season results (a few hundred numbers per season, whatever the data volume) reach the driver.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions import prices, stats
from linewell.functions.joins import materialise
from linewell.plans.ratings import MARGIN_FEATURES, TOTAL_FEATURES

LAMBDA = 5.0                 # fixed values: ridge penalty, seasons before the first inner fold,
INNER_START = 3              # rows needed to trust a shrink slope, prior count of a key number
MIN_SHRINK_ROWS = 200
KEY_PRIOR = 20.0
NEWTON_STEPS = 50


@dataclass(frozen=True)
class FeatureSet:
    """Feature lists of the four regressions (pure and line-aware, margin and total)."""
    margin: tuple = tuple(MARGIN_FEATURES)
    total: tuple = tuple(TOTAL_FEATURES)

    def models(self) -> dict[str, tuple[list[str], str]]:
        return {"model_margin": (list(self.margin), "result"), "blend_margin": ([*self.margin, "spread_line"], "result"),
                "model_total": (list(self.total), "total"), "blend_total": ([*self.total, "total_line"], "total")}


# ---------------------------------------------------------------- ridge

def gram_by_season(games: DataFrame, cols: list[str], target: str, first_season: Column) -> DataFrame:
    """Additive statistics of complete rows per season: (season, i, v), i indexing n, Σy, Σx, Σxy, Σxx (upper)."""
    complete = F.col(target).isNotNull() & (F.col("season") > first_season)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    # rows outside the fit become zeros first, so the sums below are plain products
    zero = F.lit(0.0)
    d = games.select("season", F.when(complete, 1.0).otherwise(zero).alias("one"), F.when(complete, F.col(target)).otherwise(zero).alias("y"),
                     *[F.when(complete, F.col(c).cast("double")).otherwise(zero).alias(f"x{i}") for i, c in enumerate(cols)])
    y, x = F.col("y"), [F.col(f"x{i}") for i in range(len(cols))]
    terms = [F.col("one"), y, *x, *[a * y for a in x], *[x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]]
    sums = d.groupBy("season").agg(*[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)])
    return sums.select("season", F.posexplode(F.array(*[f"s{i}" for i in range(len(terms))])).alias("i", "v"))


def gram_partials(games: DataFrame, fs: FeatureSet, first_season: int) -> DataFrame:
    """As :func:`gram_by_season` for all four regressions in one pass: (season, model, i, v).

    Each Arrow batch adds X'X per season and model; only those sums are shuffled. Entry -1 marks
    seasons with data.
    """
    specs = fs.models()
    need = list(dict.fromkeys(["season", "result", "total", *[c for cols, _ in specs.values() for c in cols]]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for season, rows in b.groupby("season"):
                for model, (cols, target) in specs.items():
                    x, y = rows[cols].to_numpy(float), rows[target].to_numpy(float)
                    ok = ~(np.isnan(x).any(axis=1) | np.isnan(y)) & (season > first_season)
                    x, y = x[ok], y[ok]
                    v = np.concatenate([[float(len(y)), y.sum()], x.sum(axis=0), y @ x, (x.T @ x)[np.triu_indices(len(cols))]])
                    out.append(pd.DataFrame({"season": np.int32(season), "model": model, "i": np.arange(len(v), dtype=np.int32), "v": v}))
            if out:
                yield pd.concat(out)
    d = games.select(*need).mapInPandas(partial, "season int, model string, i int, v double")
    s = d.groupBy("season", "model", "i").agg(F.sum("v").alias("v"))
    own = F.when(F.col("i") == 0, F.array(F.struct(F.col("i"), F.col("v")), F.struct(F.lit(-1).alias("i"), F.signum("v").alias("v"))))
    return s.select("season", "model", F.inline(F.coalesce(own, F.array(F.struct("i", "v")))))


def accumulate(per_season: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over strictly earlier seasons (walk-forward split); one row per season and key."""
    w = Window.partitionBy(*keys).orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    return per_season.withColumn("v", F.coalesce(F.sum("v").over(w), F.lit(0.0)))


def solve_ridge(n: float, sy: float, rest: np.ndarray, d: int, lam: float) -> tuple[np.ndarray, float]:
    """Standardised ridge in original units: (coefficients, intercept)."""
    sx, sxy, upper = rest[:d], rest[d:2 * d], rest[2 * d:]
    xx = np.zeros((d, d))
    xx[np.triu_indices(d)] = upper
    xx = xx + np.triu(xx, 1).T
    mean = sx / n
    cov = xx - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0) / n)
    sd[sd < 1e-9] = 1.0
    z = cov / np.outer(sd, sd) + lam * np.eye(d)
    beta = np.linalg.solve(z, (sxy - mean * sy) / sd) / sd
    return beta, sy / n - float(beta @ mean)


def fit_cores(games: DataFrame, fs: FeatureSet = FeatureSet(), lam: float = LAMBDA) -> DataFrame:
    """Coefficients per season and model, fitted on seasons strictly before it (the first season is left out).

    Output: season, model, n, n_seasons, intercept, coefs. Rows without training data are absent.
    """
    acc = accumulate(gram_partials(games, fs, first_played(games)), ["model", "i"])
    acc = acc.groupBy("season", "model").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))        # at most 66 entries
    acc = acc.select("season", "model", F.transform("s", lambda x: x["v"]).alias("s")).filter(F.col("s")[1] > 0)
    sizes = {m: len(cols) for m, (cols, _) in fs.models().items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for season, model, s in zip(b["season"], b["model"], b["s"]):
                v = np.asarray(s, float)
                beta, icpt = solve_ridge(v[1], v[2], v[3:], sizes[model], lam)
                rows.append((int(season), model, v[1], int(v[0]), icpt, beta.tolist()))
            yield pd.DataFrame(rows, columns=["season", "model", "n", "n_seasons", "intercept", "coefs"])
    return acc.mapInPandas(solve, "season int, model string, n double, n_seasons int, intercept double, coefs array<double>")


def score_with(weights: Column, cols: list[str]) -> Column:
    """Linear score from a weights column (intercept first)."""
    out = weights[0]
    for i, c in enumerate(cols):
        out = out + weights[i + 1] * F.col(c)
    return out


# ---------------------------------------------------------------- the fitted model

@dataclass
class SeasonFit:
    """Calibration of one test season."""
    k_spread: float = 0.0
    k_total: float = 0.0
    sd_margin: float = 1.0
    sd_total: float = 1.0
    ml: tuple = (0.0, 0.0)                       # win probability from the fair margin
    cal: dict = field(default_factory=dict)      # market -> (a, b, c)
    ratings: tuple = (0.0, 0.0)
    home_rate: float = 0.5
    margin_weights: list = field(default_factory=list)
    total_weights: list = field(default_factory=list)


@dataclass
class FittedModel:
    features: FeatureSet
    coefs: dict
    fits: dict[int, SeasonFit]

    def attach(self, d: DataFrame) -> DataFrame:
        """Joins the calibration of the row's season as ``m_*`` columns (seasons without one drop out).

        The table has one row per calendar season, so broadcasting it is safe at any data volume.
        """
        cols = ("m_k_spread", "m_k_total", "m_ml_a", "m_ml_b", "m_ratings_a", "m_ratings_b", "m_home_rate")
        schema = "season int, " + ", ".join(f"{c} double" for c in cols) + ", m_cal_spread array<double>, m_cal_total array<double>, m_cal_ml array<double>"
        rows = [(s, *map(float, (f.k_spread, f.k_total, *f.ml, *f.ratings, f.home_rate)), *[[float(x) for x in f.cal[m]] for m in ("spread", "total", "ml")])
                for s, f in sorted(self.fits.items())]
        return d.join(F.broadcast(d.sparkSession.createDataFrame(rows, schema)), "season")

    @staticmethod
    def detach(d: DataFrame) -> DataFrame:
        return d.drop(*[c for c in d.columns if c.startswith("m_")])

    def raw(self, games: DataFrame) -> DataFrame:
        """Adds the four raw predictions with the coefficients of the game's own season (null without any)."""
        models = self.features.models()
        seasons = sorted({s for t in self.coefs.values() for s in t})
        rows = [(s, *[[float(v) for v in (t[s][0], *t[s][1])] if s in t else None for t in (self.coefs.get(m, {}) for m in models)]) for s in seasons]
        table = games.sparkSession.createDataFrame(rows, "season int, " + ", ".join(f"w_{m} array<double>" for m in models))
        d = games.join(F.broadcast(table), "season", "left")        # one row per season
        return d.withColumns({m: score_with(F.col(f"w_{m}"), cols) for m, (cols, _) in models.items()}).drop(*[f"w_{m}" for m in models])

    def predict(self, games: DataFrame) -> DataFrame:
        """Raw predictions plus fair lines: the market line moved by the share of the disagreement that held up."""
        d = self.attach(self.raw(games))
        sl, tl = F.col("spread_line"), F.col("total_line")
        return self.detach(d.withColumns({
            "fair_margin": F.when(sl.isNotNull(), sl + F.col("m_k_spread") * (F.col("blend_margin") - sl)).otherwise(F.col("model_margin")),
            "fair_total": F.when(tl.isNotNull(), tl + F.col("m_k_total") * (F.col("blend_total") - tl)).otherwise(F.col("model_total"))}))

    def dists(self) -> dict[int, tuple]:
        return {s: (f.sd_margin, f.margin_weights, f.sd_total, f.total_weights) for s, f in self.fits.items()}


def season_map(vals: dict[int, float], season: Column) -> Column:
    """A per-season constant as a literal lookup."""
    table = F.create_map(*[x for s, v in sorted(vals.items()) for x in (F.lit(int(s)), F.lit(float(v)))])
    return F.try_element_at(table, season)


# ---------------------------------------------------------------- shrink slopes

def moments_by_season(oof: DataFrame) -> DataFrame:
    """Per season sums of edge e (model - line) and outcome d (actual - line) for spreads and totals."""
    out = None
    for market, blend, line, actual in (("spread", "blend_margin", "spread_line", "result"), ("total", "blend_total", "total_line", "total")):
        e, d = F.col(blend) - F.col(line), F.col(actual) - F.col(line)
        ok = e.isNotNull() & d.isNotNull()
        part = oof.filter(ok).groupBy("season").agg(*[f.alias(n) for n, f in (
            ("n", F.count("*").cast("double")), ("e", F.sum(e)), ("d", F.sum(d)), ("ee", F.sum(e * e)), ("ed", F.sum(e * d)), ("dd", F.sum(d * d)))])
        part = part.withColumn("market", F.lit(market))
        out = part if out is None else out.unionByName(part)
    return out


def shrink(n, e, d, ee, ed, dd) -> tuple[float, float]:
    """(slope clipped to [0, 1], population sd of what is left); no trust below 200 rows."""
    see, sed, sdd = ee - e * e / n, ed - e * d / n, dd - d * d / n
    k = 0.0 if n < MIN_SHRINK_ROWS or see <= 1e-12 else float(np.clip(sed / see, 0, 1))
    return k, float(np.sqrt(max(sdd - 2 * k * sed + k * k * see, 0.0) / n))


def shrink_table(oof: DataFrame) -> DataFrame:
    """Walk-forward shrink slope per market and test season as columns (season = test season)."""
    m = moments_by_season(oof)
    w = Window.partitionBy("market").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    a = m.select("season", "market", *[F.sum(c).over(w).alias(c) for c in ("n", "e", "d", "ee", "ed", "dd")]).filter("n > 0")
    see, sed = F.col("ee") - F.col("e") * F.col("e") / F.col("n"), F.col("ed") - F.col("e") * F.col("d") / F.col("n")
    sdd = F.col("dd") - F.col("d") * F.col("d") / F.col("n")
    k = F.when((F.col("n") < MIN_SHRINK_ROWS) | (see <= 1e-12), 0.0).otherwise(stats.clip(sed / see, 0.0, 1.0))
    return a.withColumn("k", k).select("season", "market", F.col("n").cast("bigint").alias("n"), "k", F.sqrt((sdd - 2 * F.col("k") * sed + F.col("k") * F.col("k") * see) / F.col("n")).alias("sd"))


# ---------------------------------------------------------------- logistic calibration

def fan_out(rows: DataFrame, folds: list[int]) -> DataFrame:
    """Each row once per test season after its own (test seasons are a short fixed list)."""
    later = F.filter(F.array(*[F.lit(int(s)) for s in folds]), lambda s: s > F.col("season"))
    return rows.withColumn("fold", F.explode(later))


LOGIT_ROW = ["season", "target", "a", "b", "x2", "y", "feats"]


def by_target(batch: pa.RecordBatch) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """The rows of each target as arrays, by season."""
    cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
    target, season = cols["target"], cols["season"]
    for name in np.unique(target) if len(target) else ():
        at = np.flatnonzero(target == name)
        at = at[np.argsort(season[at], kind="stable")]
        out = {c: cols[c][at] for c in ("season", "a", "b", "x2", "y")}
        if name == "ratings":
            out["feats"] = np.column_stack([v[at] for c, v in cols.items() if c not in LOGIT_ROW])
        yield name, out


def newton_sums(x1: np.ndarray, x2: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient (3) and upper Hessian (6) of a logistic fit on 1, x1 and x2."""
    p = 1 / (1 + np.exp(-(beta[0] + beta[1] * x1 + beta[2] * x2)))
    r, w = y - p, p * (1 - p)
    w1, w2 = w * x1, w * x2
    return np.array([r.sum(), r @ x1, r @ x2, w.sum(), w1.sum(), w2.sum(), w1 @ x1, w1 @ x2, w2 @ x2])


def fit_logistics(rows: DataFrame, folds: list[int], k_of: dict[int, float], coefs: dict[int, tuple[float, list[float]]],
                  ridge: dict[str, tuple[float, float, float]], penalised: set[str],
                  steps: int = NEWTON_STEPS, tol: float = 1e-12) -> dict[tuple[int, str], np.ndarray]:
    """Newton fits of all (fold, target) logistic regressions at once; a fold uses rows of earlier seasons.

    rows: season, target, a, b, x2, y, feats; x1 = a + k(fold) * b, or the fold's own linear score of
    ``feats``. Each step is one distributed pass: batches add gradients and Hessians of every fold, and
    only those sums (nine numbers per fit) are combined; the 3 x 3 solves happen on the driver. A fit
    starts from zero and stops when no coefficient moves any more.
    """
    beta: dict[tuple[int, str], np.ndarray] = {}
    names = ["g0", "g1", "g2", "h00", "h01", "h02", "h11", "h12", "h22"]
    schema = "fold int, target string, " + ", ".join(f"{n} double" for n in names)
    # one column per feature: with batches of bounded bytes Spark measures an array column anew at every row
    width = max((len(c) for _, c in coefs.values()), default=0)
    flat = rows.select(*LOGIT_ROW[:-1], *[F.get("feats", F.lit(i)).alias(f"x_{i}") for i in range(width)])
    for _ in range(steps):
        now = dict(beta)

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, str], np.ndarray] = {}
            for batch in batches:
                for target, d in by_target(batch):
                    last = np.searchsorted(d["season"], folds)      # rows of earlier seasons come first
                    for f, m in zip(folds, last):
                        if m:
                            x1 = coefs[f][0] + d["feats"][:m] @ np.asarray(coefs[f][1]) if target == "ratings" else d["a"][:m] + k_of[f] * d["b"][:m]
                            part = newton_sums(x1, d["x2"][:m], d["y"][:m], now.get((f, target), np.zeros(3)))
                            totals[f, target] = totals.get((f, target), 0.0) + part
            keys, values = list(totals), np.array(list(totals.values())).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.int32()), pa.array([t for _, t in keys], pa.string()),
                                              *[pa.array(v, pa.float64()) for v in values.T]], names=["fold", "target", *names])
        total = flat.mapInArrow(sums, schema).groupBy("fold", "target").agg(*[F.sum(n).alias(n) for n in names])
        moved = 0.0
        for s in total.collect():      # folds x targets rows
            key = (s["fold"], s["target"])
            old, pen = beta.get(key, np.zeros(3)), np.diag(ridge[s["target"]])
            h = np.zeros((3, 3))
            h[np.triu_indices(3)] = [s[n] for n in names[3:]]
            h = h + np.triu(h, 1).T + pen
            g = np.array([s[n] for n in names[:3]]) - (pen @ old if s["target"] in penalised else 0.0)
            beta[key] = old + np.linalg.solve(h, g)
            moved = max(moved, float(np.max(np.abs(beta[key] - old))))
        if not beta or moved < tol:
            break
    return beta


def calibration_rows(oof: DataFrame) -> DataFrame:
    """Rows of the market-anchored calibrations and of the fallback win probability ('fair')."""
    c = F.col
    edge, tedge = c("blend_margin") - c("spread_line"), c("blend_total") - c("total_line")

    def row(target, a, b, x2, y, keep):
        return F.struct(F.lit(target).alias("target"), a.alias("a"), b.alias("b"), x2.alias("x2"), F.when(y, 1.0).otherwise(0.0).alias("y"),
                        F.coalesce(keep & a.isNotNull() & b.isNotNull() & x2.isNotNull(), F.lit(False)).alias("keep"))

    def vig(first, second):
        return stats.logit(prices.no_vig_or_default(c(first), c(second)))
    zero = F.lit(0.0)
    ml_ok = (c("result") != 0) & c("home_moneyline").isNotNull() & c("away_moneyline").isNotNull()
    rows = F.array(
        row("fair", c("spread_line"), edge, zero, c("result") > 0, c("result") != 0),
        row("spread", vig("home_spread_odds", "away_spread_odds"), zero, edge, c("result") > c("spread_line"), c("result") != c("spread_line")),
        row("total", vig("over_odds", "under_odds"), zero, tedge, c("total") > c("total_line"), c("total") != c("total_line")),
        row("ml", vig("home_moneyline", "away_moneyline"), zero, edge, c("result") > 0, ml_ok))
    none = F.lit(None).cast("array<double>")
    return oof.select("season", F.inline(rows)).filter("keep").drop("keep").withColumn("feats", none).select(*LOGIT_ROW)


def baseline_rows(train: DataFrame, cols: list[str]) -> DataFrame:
    """Training rows of the ratings-only baseline (scored with each fold's own coefficients)."""
    zero = F.lit(0.0)
    d = train.filter("result <> 0").dropna(subset=cols)
    return d.select("season", F.lit("ratings").alias("target"), zero.alias("a"), zero.alias("b"), zero.alias("x2"),
                    F.when(F.col("result") > 0, 1.0).otherwise(0.0).alias("y"), F.array(*cols).alias("feats"))


# ---------------------------------------------------------------- key numbers

def key_number_weights(rows: DataFrame) -> DataFrame:
    """Observed / expected frequency of every integer outcome (fold, kind, k, weight).

    rows: fold, kind ('margin' | 'total'), mu, sd, actual.  The expected count of k is a difference of summed normal
    CDFs at k -/+ 0.5. A task adds them up over its rows, batch by batch, and returns one number per edge, fold and kind.
    """
    bounds = {"margin": (stats.MARGIN_LO, stats.MARGIN_HI), "total": (stats.TOTAL_LO, stats.TOTAL_HI)}

    def at_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for (fold, kind), d in batch.groupby(["fold", "kind"]):
                lo, hi = bounds[kind]
                edges = np.arange(lo, hi + 2) - 0.5
                mu, sd = d["mu"].to_numpy(float), d["sd"].to_numpy(float)
                total = sums.setdefault((fold, kind), np.zeros(len(edges)))
                for i in range(0, len(mu), 4096):
                    total += stats.np_normal_cdf((edges[:, None] - mu[i:i + 4096]) / sd[i:i + 4096]).sum(1)
        yield pd.DataFrame([(fold, kind, k, v) for (fold, kind), t in sums.items() for k, v in enumerate(t, bounds[kind][0])], columns=["fold", "kind", "k", "c"])

    is_margin = F.col("kind") == "margin"
    d = rows.withColumns({"_lo": F.when(is_margin, stats.MARGIN_LO).otherwise(stats.TOTAL_LO), "_hi": F.when(is_margin, stats.MARGIN_HI).otherwise(stats.TOTAL_HI)})
    edges = (rows.select("fold", "kind", "mu", "sd").mapInPandas(at_edges, f"fold {rows.schema['fold'].dataType.simpleString()}, kind string, k int, c double")
             .groupBy("fold", "kind", "k").agg(F.sum("c").alias("c")))
    w = Window.partitionBy("fold", "kind").orderBy("k")         # 132 or 162 rows
    expected = edges.withColumn("e", F.lead("c").over(w) - F.col("c")).filter("e is not null")
    inside = F.least(F.greatest(F.col("actual").cast("int"), F.col("_lo")), F.col("_hi"))
    observed = d.groupBy("fold", "kind", inside.alias("k")).agg(F.count("*").cast("double").alias("o"))
    both = expected.join(observed, ["fold", "kind", "k"], "left").select("fold", "kind", "k", "e", F.coalesce("o", F.lit(0.0)).alias("o"))
    # margins are symmetric: k and -k share their counts (0 meets itself)
    mirror = F.when(F.col("kind") == "margin", F.array("k", -F.col("k"))).otherwise(F.array("k"))
    both = both.withColumn("k", F.explode(mirror)).groupBy("fold", "kind", "k").agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
    return both.select("fold", "kind", "k", ((F.col("o") + KEY_PRIOR) / (F.col("e") + KEY_PRIOR)).alias("weight"))


def outcome_rows(oof: DataFrame, fits: dict[int, SeasonFit]) -> DataFrame:
    d = fan_out(oof, sorted(fits))
    c, f = F.col, F.col("fold")

    def get(name):
        return season_map({s: getattr(x, name) for s, x in fits.items()}, f)
    mu = c("spread_line") + get("k_spread") * (c("blend_margin") - c("spread_line"))
    tmu = c("total_line") + get("k_total") * (c("blend_total") - c("total_line"))
    rows = F.array(F.struct(F.lit("margin").alias("kind"), mu.alias("mu"), get("sd_margin").alias("sd"), c("result").alias("actual")),
                   F.struct(F.lit("total").alias("kind"), tmu.alias("mu"), get("sd_total").alias("sd"), c("total").alias("actual")))
    return d.select("fold", F.inline(rows)).filter("mu is not null and actual is not null")


# ---------------------------------------------------------------- fit

def out_of_fold(games: DataFrame, model: FittedModel, ready: list[int]) -> DataFrame:
    """Played games of seasons with enough history, predicted by their own walk-forward core."""
    return model.raw(games.filter(F.col("result").isNotNull() & F.col("season").isin(*ready)))


def fit_walk_forward(games: DataFrame, fs: FeatureSet = FeatureSet(), lam: float = LAMBDA, baselines: bool = True) -> FittedModel:
    """Fits every test season at once.

    The inner fold of a season is the same model as the outer fold's core for that season, so the
    out-of-fold table is computed once and each test season calibrates on its rows from earlier seasons.
    """
    cores = fit_cores(games, fs, lam).collect()         # seasons x 4 models x at most a dozen numbers
    coefs: dict = {}
    for r in cores:
        coefs.setdefault(r["model"], {})[r["season"]] = (r["intercept"], list(r["coefs"]))
    seen = {r["season"]: r["n_seasons"] for r in cores if r["model"] == "model_margin"}
    ready = sorted(s for s, n in seen.items() if n >= INNER_START)
    model = FittedModel(fs, coefs, {})
    tests = [s for s in ready if seen[s] > INNER_START]
    if not tests:
        return model
    keep = ["game_id", "season", "result", "total", "spread_line", "total_line", "home_spread_odds", "away_spread_odds", "over_odds", "under_odds",
            "home_moneyline", "away_moneyline", *model.coefs]
    oof = materialise(out_of_fold(games, model, ready).select(*keep), "oof")
    sums: dict = {}
    for r in moments_by_season(oof).collect():
        sums.setdefault(r["market"], {})[r["season"]] = np.array([r[c] for c in ("n", "e", "d", "ee", "ed", "dd")])
    for s in tests:
        past = {m: [v for q, v in t.items() if q < s] for m, t in sums.items()}
        if not (past.get("spread") and past.get("total")):
            continue
        (ks, sm), (kt, st) = shrink(*np.sum(past["spread"], axis=0)), shrink(*np.sum(past["total"], axis=0))
        model.fits[s] = SeasonFit(ks, kt, sm, st)
    rows = calibration_rows(oof)
    light, steep = (1e-6, 1e-6, 1e-6), (1e-6, 1.0, 1.0)
    ridge = {"fair": light, "ratings": light, "spread": steep, "total": steep, "ml": steep}
    if baselines:
        train = games.filter(F.col("result").isNotNull() & (F.col("season") > first_played(games)))
        rows = rows.unionByName(baseline_rows(train, list(fs.margin)))
        home = train.filter("result <> 0").groupBy("season").agg(F.sum((F.col("result") > 0).cast("double")).alias("w"), F.count("*").alias("n")).collect()
        for s, f in model.fits.items():
            f.home_rate = sum(r["w"] for r in home if r["season"] < s) / sum(r["n"] for r in home if r["season"] < s)
    rows = materialise(rows, "calibration")
    k_of = {s: f.k_spread for s, f in model.fits.items()}
    for (s, target), b in fit_logistics(rows, sorted(model.fits), k_of, coefs["model_margin"], ridge, {"spread", "total", "ml"}).items():
        f = model.fits[s]
        if target in ("fair", "ratings"):
            setattr(f, "ml" if target == "fair" else "ratings", (float(b[0]), float(b[1])))
        else:
            f.cal[target] = tuple(float(x) for x in b)
    for r in key_number_weights(outcome_rows(oof, model.fits)).orderBy("fold", "kind", "k").collect():     # 292 numbers per season
        getattr(model.fits[r["fold"]], "margin_weights" if r["kind"] == "margin" else "total_weights").append(r["weight"])
    return model


def first_played(games: DataFrame) -> int:
    return games.agg(F.min(F.when(F.col("result").isNotNull(), F.col("season")))).first()[0]
