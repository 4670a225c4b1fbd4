"""What keeps shared steps from growing faster than their input: few shuffles, bounded tasks, flat rows to Python."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linewell.catalog import base as b
from linewell.catalog import models
from linewell.functions import stats
from linewell.operators import availability, metrics, plays
from linewell.plans import model, pricing


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-").startswith("Exchange hash") for line in plan.splitlines())


def test_team_games_take_one_shuffle(spark, sf):
    p = b.table(spark, sf, "plays")
    assert shuffles(plays.team_games(p)) == 1


def test_snap_gap_stays_inside_a_drive(spark):
    d = spark.createDataFrame([(1, 0, 100.0, "a"), (1, 0, 70.0, "b"), (1, 1, 60.0, "c"), (1, None, 50.0, "d"), (1, None, 45.0, "e")],
                              "game_id int, drive int, game_seconds_remaining double, play_id string")
    got = {r["play_id"]: r["gap"] for r in plays.with_snap_gap(d).collect()}
    assert got == {"a": None, "b": 30.0, "c": None, "d": None, "e": 5.0}


def test_player_games_take_one_shuffle_beyond_their_input(spark, sf):
    snaps = b.table(spark, sf, "snaps")
    assert shuffles(availability.player_games(snaps)) - shuffles(snaps) == 1


def test_tasks_of_a_shuffle_are_bounded(spark, sf):
    b.table(spark, sf, "games")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(8 << 20)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 800


def test_newton_rows_reach_python_without_arrays(spark, monkeypatch):
    seen = []
    inner = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda d, *a, **k: (seen.append([t for _, t in d.dtypes]), inner(d, *a, **k))[1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ [0.8, -0.5]))).astype(float)
    rows = [(2010 + i % 3, "ratings", 0.0, 0.0, 0.0, float(y[i]), x[i].tolist()) for i in range(400)]
    rows += [(2010 + i % 3, "ml", float(x[i, 0]), 0.0, float(x[i, 1]), float(y[i]), None) for i in range(400)]
    d = spark.createDataFrame(rows, "season int, target string, a double, b double, x2 double, y double, feats array<double>")
    beta = model.fit_logistics(d, [2012], {2012: 0.0}, {2012: (0.1, [0.8, -0.5])}, {"ratings": (1e-6,) * 3, "ml": (1e-6, 1.0, 1.0)}, {"ml"})
    assert seen and all("array" not in t for types in seen for t in types)
    m = np.arange(400) % 3 < 2
    for target, x1, x2, pen in (("ratings", 0.1 + x @ [0.8, -0.5], np.zeros(400), 0.0), ("ml", x[:, 0], x[:, 1], np.diag((1e-6, 1.0, 1.0)))):
        z = np.column_stack([np.ones(400), x1, x2])[m]
        now = beta[2012, target]
        gradient = z.T @ (y[m] - 1 / (1 + np.exp(-z @ now))) - (pen @ now if target == "ml" else 0.0)
        assert np.abs(gradient).max() < 1e-8


class TwoSeasons:
    def dists(self):
        rng = np.random.default_rng(3)
        return {s: (13.0 + 0.2 * k, rng.uniform(0.4, 1.6, 161), 13.5 - 0.2 * k, rng.uniform(0.4, 1.6, 131)) for k, s in enumerate((2020, 2021))}


def test_scenarios_take_few_evaluations_and_agree_with_halving(monkeypatch):
    """Rows as the pricing gives them: both sides of each market, quoted at the reference line or beside it."""
    seen = []
    for name in ("np_normal_cdf", "_cdf_in_place"):
        inner = getattr(stats, name, None)
        monkeypatch.setattr(stats, name, lambda x, f=inner: (seen.append(x.size), f(x))[1], raising=False)
    model, rng, n = TwoSeasons(), np.random.default_rng(4), 400
    total = rng.random(n) < 0.5
    line = np.where(total, 44.0, 0.0) + np.round(2 * rng.normal(0, 6, n)) / 2
    market = pd.DataFrame({"season": rng.choice([2020, 2021, 1999], n), "is_total": total, "fair": line + rng.normal(0, 3, n), "at": line + rng.choice([0.0, 0.0, 0.5, -1.0], n),
                           "ref": line, "mu": np.where(rng.random(n) < 0.7, np.nan, line + 1.0), "p": rng.choice([0.5, 0.48, 0.52, 0.00001, np.nan], n)})
    d = pd.concat([market.assign(toward=t) for t in (1.0, -1.0)], ignore_index=True)
    shapes = pricing.outcome_udfs(model)
    got = shapes.scenarios.func(*[d[c] for c in d.columns])
    first = shapes.at_line.func(*[d[c] for c in ("season", "is_total", "fair", "at", "ref", "mu")])
    assert sum(seen) < 12 * 162 * len(d)        # 60 with halving

    want = {c: np.full(len(d), np.nan) for c in [*got.columns, "t", "push", "r", "live"]}
    for i, r in enumerate(d.itertuples()):
        if r.season not in model.dists():
            continue
        m_sd, m_w, t_sd, t_w = model.dists()[r.season]
        sd, w, lo = (t_sd, t_w, stats.TOTAL_LO) if r.is_total else (m_sd, m_w, stats.MARGIN_LO)

        def over(mu, at, weights=w):
            return [x[0] for x in stats.np_over_push(np.array([mu]), np.array([sd]), weights[None, :], np.array([at]), lo)]
        for name, by in pricing.SHIFTS.items():
            want[f"{name}_t"][i], want[f"{name}_push"][i] = over(r.fair + r.toward * by, r.at)
        want["plain_t"][i], want["plain_push"][i] = over(r.fair, r.at, np.ones_like(w))
        want["plain_r"][i] = over(r.fair, r.ref, np.ones_like(w))[0]
        want["t"][i], want["push"][i] = over(r.fair, r.at)
        want["r"][i] = over(r.fair, r.ref)[0]
        one = np.empty(1, object)
        one[0] = w
        own = r.mu if r.mu == r.mu else stats.np_implied_mean(np.array([r.ref]), np.array([r.p]), np.array([sd]), one, np.array([r.is_total]))[0]
        want["market"][i] = over(own, r.at)[0] if own == own else np.nan
        want["live"][i] = over(r.mu, r.ref)[0] if r.mu == r.mu else np.nan
    for c in want:
        np.testing.assert_allclose((got if c in got else first)[c].to_numpy(), want[c], rtol=0, atol=1e-9)


@pytest.mark.parametrize("is_total,lo,n", [(False, stats.MARGIN_LO, 161), (True, stats.TOTAL_LO, 131)])
def test_implied_means_at_the_edges(is_total, lo, n):
    """Lines beyond all outcomes, quarter lines, and probabilities that no mean of the bracket gives."""
    line = np.array([lo - 300.0, lo, lo + n - 1, lo + 500.0, 30.0, 30.25, 30.5, np.nan, 30.0])
    w, k = np.random.default_rng(5).uniform(0.3, 1.7, n), len(line)
    ws = np.empty(5 * k, object)
    ws[:] = [w] * (5 * k)
    at, p = np.tile(line, 5), np.repeat([0.0, 0.3, 0.5, 0.99995, np.nan], k)
    np.testing.assert_allclose(stats.implied_mean_of(at, p, 13.0, w, is_total), stats.np_implied_mean(at, p, np.full(5 * k, 13.0), ws, np.full(5 * k, is_total)), rtol=0, atol=1e-8)


def test_a_bet_table_makes_no_texts(spark, sf, monkeypatch):
    """What is written for the table holds its columns alone, so that lists of prices and risks aren't made for every side."""
    written, inner = {}, models.materialise
    monkeypatch.setattr(models, "materialise", lambda d, label: (written.update({label: d}), inner(d, label))[1])
    got = models.replay_bet_table(spark, sf)
    assert written["bets"].columns == list(metrics.BET_COLUMNS)
    plan = written["bets"]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    bets = {r["market"]: r["bets"] for r in got.collect()}
    assert bets.pop("all", 0) == sum(bets.values()) == written["bets"].count()


def test_drawdowns_chain_few_blocks(spark):
    """Games of a day lie far apart, as with many leagues and one has most of the bets; a bet without a day stays."""
    rng, n = np.random.default_rng(9), 12_000
    d = pd.DataFrame({"market": rng.choice(["spread", "total"], n), "side": "over", "game_id": rng.permutation(n) * 1500, "flat": np.round(rng.normal(0, 1, n), 3)})
    d["gameday"] = np.where(rng.random(n) < 0.7, "2020-01-02", np.where(rng.random(n) < 0.5, "2020-01-01", "2020-01-03"))
    d["result"], d["kelly_units"], d["kelly_stake"] = np.where(d["flat"] > 0, "W", "L"), d["flat"] / 2, 0.5
    bets = spark.createDataFrame(d).withColumn("gameday", F.col("gameday").cast("date"))
    sizes = [r["count"] for r in metrics.day_blocks(bets).groupBy("gameday", "block").count().collect()]
    assert sum(sizes) == n and max(sizes) < 2 * 1024 and len(sizes) <= 3 + n // 1024 + 3
    got = {r["market"]: (r["flat_drawdown"], r["kelly_drawdown"]) for r in metrics.bet_table(bets, 20).collect()}
    for market in ("spread", "total", "all"):
        run = (d if market == "all" else d[d["market"] == market]).sort_values(["gameday", "game_id"])["flat"].cumsum().to_numpy()
        want = (np.maximum(np.maximum.accumulate(run), 0) - run).max()
        assert got[market] == (pytest.approx(want), pytest.approx(want / 2))
    undated = bets.withColumn("gameday", F.when(F.col("game_id") % 2 == 0, F.col("gameday")))
    assert metrics.day_blocks(undated).count() == n
