import pytest
from pyspark.sql import functions as F

from linewell import Settings
from linewell.functions import joins, times
from linewell.operators import quotes, references, validity

S = Settings()
KICK = "2026-10-11T17:00:00Z"
COLS = "event_id long, game_id string, book string, market string, side string, point double, price double, source string, odds_time string"


def at(text):
    return times.parse_utc(F.lit(text))


def check(spark, rows, now="2026-10-11T16:00:00Z", settings=S):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLS)
    k = spark.range(1).select(F.lit("G").alias("game_id"), at(KICK).alias("kickoff"))
    return validity.check_quotes(df, k, at(now), settings)


def quote(game="G", book="bk", market="spread", side="away", point=7.0, price=-110.0, t="2026-10-11T15:50:00Z"):
    return (game, book, market, side, point, price, "odds_api", t)


@pytest.mark.parametrize("row,now,want", [
    (quote(), None, ""), (quote(t="2026-10-11T15:29:00Z"), None, "stale"), (quote(t="2026-10-11T15:30:00Z"), None, ""),
    (quote(t="2026-10-11T15:50:00"), None, "timestamp"), (quote(t=None), None, "timestamp"), (quote(t="soon"), None, "timestamp"),
    (quote(t="2026-10-11T16:10:00Z"), None, "future"), (quote(t="2026-10-11T17:01:00Z"), "2026-10-11T17:05:00Z", "kickoff"),
    (quote(t="2026-10-11T16:55:00Z"), "2026-10-11T17:00:00Z", "kickoff"), (quote(price=-50.0), None, "price"), (quote(point=7.25), None, "point"),
    (quote(market="total", side="over", point=-3.0), None, "point"), (quote(side="over"), None, "market/side"), (quote(game="X"), None, "not in slate")])
def test_reject_reasons(spark, row, now, want):
    reason = check(spark, [row], now or "2026-10-11T16:00:00Z").first()["reject_reason"]
    assert (want in reason) if want else reason == ""


def pair(book, line, a=-110.0, b=-110.0, ta="2026-10-11T15:50:00Z", tb="2026-10-11T15:50:00Z"):
    return [quote(book=book, side="home", point=-line, price=a, t=ta), quote(book=book, side="away", point=line, price=b, t=tb)]


def refs(spark, rows, min_books=2):
    v = validity.valid_quotes(check(spark, rows))
    p = references.with_implied_mean(references.flat_distributions(quotes.quote_pairs(v))).drop("sd", "weights")
    return {r["excluded"]: r for r in references.build_references(p, min_books, v).collect()}


def test_pairing_and_gap(spark):
    v = validity.valid_quotes(check(spark, pair("a", 3.0)))
    p = quotes.quote_pairs(v).collect()
    assert len(p) == 1 and p[0]["p"] == 0.5 and p[0]["line"] == 3.0 and p[0]["overround"] == pytest.approx(220 / 210 - 1)
    apart = pair("a", 3.0, tb="2026-10-11T15:40:00Z")
    assert quotes.quote_pairs(validity.valid_quotes(check(spark, apart))).count() == 0
    newer = pair("a", 3.0) + pair("a", 3.0, -150.0, 130.0, "2026-10-11T15:55:00Z", "2026-10-11T15:55:00Z")
    p = quotes.quote_pairs(validity.valid_quotes(check(spark, newer))).collect()
    assert len(p) == 1 and p[0]["p"] == pytest.approx(0.58, abs=0.02)


def test_leave_one_out(spark):
    rows = pair("a", 3.0) + pair("b", 3.0, -112.0, -108.0) + pair("c", 3.0, -250.0, 200.0)
    r = refs(spark, rows)
    assert set(r) == {None, "a", "b", "c"} and r["c"]["books"] == "a,b" and r[None]["n_books"] == 3
    assert r["c"]["mu"] < r["a"]["mu"]
    assert set(refs(spark, pair("a", 3.0) + pair("b", 3.0))) == {None}


def brute(pairs, excluded):
    """Median line and nearest pair per book, straight from the definition."""
    kept = [p for p in pairs if p[0] != excluded]
    books = sorted({p[0] for p in kept})
    if len(books) < 2:
        return None
    lines = sorted(p[1] for p in kept)
    n = len(lines)
    med = (lines[(n - 1) // 2] + lines[n // 2]) / 2
    near = sorted(min((abs(ln - med), t, ln) for b, ln, t in kept if b == k)[2] for k in books)
    m = len(near)
    return len(books), round((near[(m - 1) // 2] + near[m // 2]) / 2 * 2) / 2


def test_order_statistics_equal_brute_force(spark):
    """Many alternative lines per book: rank arithmetic gives what listing all combinations gives."""
    import random
    rng = random.Random(4)
    for _ in range(3):
        data = {(f"b{rng.randrange(5)}", rng.randrange(-8, 9) * 0.5) for _ in range(rng.randrange(4, 18))}
        rows, flat = [], []
        for i, (book, line) in enumerate(sorted(data)):
            t = f"2026-10-11T15:{40 + i % 20:02d}:00Z"
            rows += pair(book, line, ta=t, tb=t)
            flat.append((book, line, t))
        got = {k: (v["n_books"], v["line"]) for k, v in refs(spark, rows).items()}
        want = {e: brute(flat, e) for e in [None, *{b for b, _, _ in flat}]}
        assert got == {k: v for k, v in want.items() if v}


def test_salted_lookup_equals_plain_join(spark):
    fact = spark.range(1000).selectExpr("id", "cast(if(id % 3 = 0, 0, id % 7) as int) as k")
    dim = spark.range(5).selectExpr("cast(id as int) as k", "id * 10 as v")
    a = sorted(map(tuple, joins.lookup(fact, dim, ["k"], salts=4).select("id", "k", "v").collect()), key=str)
    b = sorted(map(tuple, fact.join(dim, "k", "left").select("id", "k", "v").collect()), key=str)
    assert a == b


def test_starter_and_weather_inputs(spark):
    slate = spark.range(1).select(F.lit("G").alias("game_id"), at(KICK).alias("kickoff"), F.lit("MIA").alias("home_team"), F.lit("CIN").alias("away_team"))
    now = at("2026-10-11T15:55:00Z")
    base = ("G", KICK, "MIA", "Q", "beat", "2026-10-11T15:00:00Z")
    rows = [base, base, ("G", KICK, "NYJ", "Q", "beat", base[5]), ("G", KICK, "CIN", " ", "beat", base[5]), ("G", KICK, "CIN", "Q", None, base[5]),
            ("G", KICK, "CIN", "Q", "beat", "2026-10-11T16:10:00Z"), ("G", "2026-10-12T17:00:00Z", "CIN", "Q", "beat", base[5])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no long, game_id string, kickoff_utc string, team string, qb_name string, source string, confirmed_utc string")
    got = [r["reason"] for r in validity.check_starter_inputs(df, slate, now, S).orderBy("row_no").collect()]
    for reason, want in zip(got, ("", "duplicate", "not in this game", "qb_name", "source", "after the decision", "does not match")):
        assert want in reason if want else reason == ""
    w = ("G", KICK, "10", "60", "svc", "2026-10-11T12:00:00Z", "2026-10-11T12:05:00Z", KICK)
    bad = [("-3", 2), ("nan", 2), ("inf", 2), ("250", 2), ("calm", 2), ("400", 3), ("2026-10-11T11:00:00Z", 6), ("2026-10-12T17:00:00Z", 7)]
    rows = [w] + [tuple(v if i == pos else x for i, x in enumerate(w)) for v, pos in bad]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no long, game_id string, kickoff_utc string, wind_mph string, temp_f string, source string, forecast_utc string, retrieved_utc string, valid_for_utc string")
    got = [r["reason"] for r in validity.check_weather_inputs(df, slate, now, S).orderBy("row_no").collect()]
    assert got[0] == "" and all(got[1:])
