import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewell import Settings
from linewell.functions import prices, stats, times


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_implied_and_decimal(spark):
    p = {n: prices.implied(F.lit(float(v))) for n, v in (("a", -110), ("b", 150), ("c", 100), ("d", -200), ("e", 50))}
    r = one(spark, **p)
    assert (r.a, r.b, r.c, r.d, r.e) == (pytest.approx(110 / 210), pytest.approx(0.4), 0.5, pytest.approx(2 / 3), None)
    assert one(spark, x=prices.no_vig(F.lit(-110.0), F.lit(-110.0))).x == 0.5


def test_value_kelly_and_min_price(spark):
    r = one(spark, ev=prices.expected_value(F.lit(0.55), F.lit(0.0), F.lit(-110.0)), push=prices.expected_value(F.lit(0.5), F.lit(0.1), F.lit(100.0)),
            k=prices.kelly(F.lit(0.40), F.lit(0.0), F.lit(-110.0)), m=prices.price_for_edge(F.lit(0.55), F.lit(0.0), 0.02))
    assert r.ev == pytest.approx(0.55 * 100 / 110 - 0.45) and r.push == pytest.approx(0.1) and r.k == 0
    assert one(spark, e=prices.expected_value(F.lit(0.55), F.lit(0.0), F.lit(float(r.m)))).e == pytest.approx(0.02, abs=0.01)


@pytest.mark.parametrize("market,side,point,home,away,want", [
    ("spread", "home", -3.0, 24.0, 21.0, "P"), ("spread", "home", -3.5, 24.0, 21.0, "L"), ("spread", "away", 3.5, 24.0, 21.0, "W"),
    ("ml", "away", None, 20.0, 23.0, "W"), ("total", "over", 44.5, 24.0, 21.0, "W"), ("total", "under", 45.0, 24.0, 21.0, "P")])
def test_grade(spark, market, side, point, home, away, want):
    g = prices.grade(F.lit(market), F.lit(side), F.lit(point).cast("double"), F.lit(home), F.lit(away))
    assert one(spark, g=g).g == want


def test_revig_keeps_no_vig_probability(spark):
    a, b = prices.revig_pair(F.lit(-130.0), F.lit(110.0), 0.0476)
    r = one(spark, a=a, b=b, before=prices.no_vig(F.lit(-130.0), F.lit(110.0)), after=prices.no_vig(a, b), over=prices.implied(a) + prices.implied(b) - 1)
    assert r.after == pytest.approx(r.before, abs=0.003) and r.over == pytest.approx(0.0476, abs=0.003)
    n, m = prices.revig_pair(F.lit(None).cast("double"), F.lit(110.0), 0.0476)
    assert tuple(one(spark, n=n, m=m)) == (None, 110.0)


def test_strict_time_parsing(spark):
    good = times.iso(times.parse_utc(F.lit("2026-10-11T12:00:00-04:00")))
    assert one(spark, t=good).t == "2026-10-11T16:00:00Z"
    for bad in ("2026-10-11T12:00:00", "", "yesterday", "soon"):
        assert one(spark, t=times.parse_utc(F.lit(bad))).t is None
    for day, want in (("2026-10-11", "2026-10-11T17:00:00Z"), ("2026-11-15", "2026-11-15T18:00:00Z")):
        assert one(spark, t=times.iso(times.kickoff_utc(F.lit(day).cast("date"), F.lit("13:00")))).t == want
    assert one(spark, t=times.kickoff_utc(F.lit("2026-10-11").cast("date"), F.lit(None).cast("string"))).t is None


def test_erf_and_distribution(spark):
    assert one(spark, x=stats.erf(F.lit(0.7))).x == pytest.approx(math.erf(0.7), abs=2e-7)
    w = np.ones((1, 161))
    pmf = stats.np_outcome_pmf(np.array([3.0]), np.array([13.0]), w, stats.MARGIN_LO)
    assert pmf.sum() == pytest.approx(1) and pmf[0, 83] == pmf.max()
    ws = np.empty(1, object)
    ws[:] = [np.ones(161)]
    cond, _ = stats.np_over_push(np.array([3.2]), np.array([13.0]), w, np.array([3.0]), stats.MARGIN_LO)
    mu = stats.np_implied_mean(np.array([3.0]), cond, np.array([13.0]), ws, np.array([False]))
    assert mu[0] == pytest.approx(3.2, abs=1e-9)


def test_settings_ranges():
    Settings(min_edge=0.0)
    for bad in ({"min_edge": 1.0}, {"max_odds_age_minutes": 0}, {"min_reference_books": 1.5}, {"kelly_fraction": float("nan")}, {"gap_points": True}):
        with pytest.raises(ValueError):
            Settings(**bad)
