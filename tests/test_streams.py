import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linewell.streaming import quotes as sq
from linewell.streaming import stateful
from linewell.streaming.sinks import drain, replay, split_late

T0 = dt.datetime(2024, 2, 1, 12)
SCHEMA = "event_id long, game_id long, book string, market string, side string, point double, price double, odds_time_utc timestamp"


def frame(spark, rows):
    """(event_id, game, book, market, side, point, price, minutes after T0)"""
    return spark.createDataFrame([(*r[:7], T0 + dt.timedelta(minutes=r[7])) for r in rows], SCHEMA)


def at(minutes):
    return F.lit(T0 + dt.timedelta(minutes=minutes))


def shown(df):
    return sorted((r["game_id"], r["market"], r["book"], r["line"], r["first_price"], r["second_price"]) for r in df.collect())


def test_pairs_follow_the_newest_quote_of_each_side(spark):
    rows = [(1, 1, "b", "ml", "home", None, -110.0, 0), (2, 1, "b", "ml", "away", None, 100.0, 3), (3, 1, "b", "ml", "home", None, -120.0, 4),
            (4, 2, "b", "spread", "home", -3.0, -110.0, 0), (5, 2, "b", "spread", "away", 3.0, -105.0, 6),                      # six minutes apart
            (6, 3, "b", "total", "over", 40.0, -110.0, 0), (7, 3, "b", "total", "under", 40.0, -110.0, 1), (8, 3, "b", "total", "under", 40.0, -115.0, 20),  # replaced
            (9, 4, "b", "total", "over", 40.0, -110.0, 0), (10, 4, "b", "total", "under", 41.0, -110.0, 0),                     # other line
            (11, 5, "b", "ml", "home", None, -110.0, 0), (12, 5, "b", "ml", "away", None, 105.0, 5)]                            # exactly five minutes
    got = sq.current_pairs(drain(sq.pair_matches(replay(frame(spark, rows), F.col("event_id").asc(), 3, "pairs", ("odds_time_utc", at(120)))), "pairs"))
    assert shown(got) == [(1, "ml", "b", None, -120.0, 100.0), (5, "ml", "b", None, -110.0, 105.0)]


def test_quotes_leave_the_state_once_the_watermark_has_passed(spark):
    rows = [(i, i % 40, "b", "ml", "home" if i % 2 else "away", None, -110.0, i / 4) for i in range(400)]      # 100 minutes
    progress = []
    drain(sq.pair_matches(replay(frame(spark, rows), F.col("event_id").asc(), 5, "state", ("odds_time_utc", at(300))), late_minutes=10), "state", progress=progress)
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert max(held) < 2 * 400 * 0.7 and held[-1] <= 4      # the clock's own rows at most


def test_late_rows_go_to_a_table_of_their_own(spark):
    rows = [(1, 1, "b", "ml", "home", None, -110.0, 0), (2, 1, "b", "ml", "home", None, -110.0, 30), (3, 1, "b", "ml", "home", None, -110.0, 19), (4, 1, "b", "ml", "home", None, -110.0, 20)]
    good, late = split_late(replay(frame(spark, rows), F.col("event_id").asc(), 2, "late"), "odds_time_utc", 10)
    assert sorted(r["event_id"] for r in good.collect()) == [1, 2, 4]
    assert [(r["event_id"], r["watermark"]) for r in late.collect()] == [(3, T0 + dt.timedelta(minutes=20))]


@pytest.mark.parametrize("parts", [1, 4])
def test_timers_withdraw_old_quotes(spark, parts):
    rows = [(1, 1, "b", "ml", "home", None, -110.0, 0), (2, 1, "b", "ml", "home", None, -120.0, 25), (3, 2, "b", "ml", "home", None, -110.0, 1), (4, 2, "c", "ml", "home", None, -110.0, 29)]
    updates = drain(stateful.latest_with_expiry(replay(frame(spark, rows), F.col("event_id").asc(), parts, "expiry", ("odds_time_utc", at(80))), 30.0), "expiry", "update")
    got = {(r["game_id"], r["book"]): (r["event_id"], r["live"]) for r in stateful.standing(updates).collect()}
    assert got == {(1, "b"): (2, True), (2, "b"): (3, False), (2, "c"): (4, True)}


def test_an_empty_table_as_a_stream(spark):
    none = frame(spark, [])
    assert sq.current_pairs(drain(sq.pair_matches(replay(none, F.col("event_id").asc(), 2, "none", ("odds_time_utc", at(80)))), "none")).collect() == []
    good, late = split_late(replay(none, F.col("event_id").asc(), 2, "none"), "odds_time_utc", 10)
    assert good.count() == late.count() == 0


def test_a_quote_as_old_as_may_be_isnt_late(spark):
    """Two minutes ahead of the clock, then thirty behind it: 32 minutes, two batches later."""
    rows = [(1, 1, "b", "ml", "home", None, -110.0, 2), (2, 2, "b", "ml", "home", None, -110.0, 0), (3, 3, "b", "ml", "home", None, -110.0, -30), (4, 3, "b", "ml", "away", None, 100.0, -30)]
    updates = drain(stateful.latest_with_expiry(replay(frame(spark, rows), F.col("event_id").asc(), 4, "edge", ("odds_time_utc", at(3))), 30.0), "edge", "update")
    assert {r["event_id"] for r in stateful.standing(updates).collect()} == {1, 2, 3, 4}
    got = sq.current_pairs(drain(sq.pair_matches(replay(frame(spark, rows), F.col("event_id").asc(), 4, "edge", ("odds_time_utc", at(120)))), "edge"))
    assert shown(got) == [(3, "ml", "b", None, -110.0, 100.0)]


class Store:
    """One game's state and timers in memory; counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, at):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at


def test_a_trigger_takes_few_calls_of_the_state_store():
    """Forty keys of a game, three quotes each, in two triggers: a call for each key would be eighty at least."""
    store, p = Store(), stateful.LatestQuote(30.0)
    p.init(store)

    def trigger(ids):
        d = pd.DataFrame({"game_id": 7, "book": [f"b{i % 5}" for i in ids], "market": "total", "side": ["over" if i % 2 else "under" for i in ids], "point_key": [str(i % 4) for i in ids],
                          "event_id": ids, "price": [-100.0 - i for i in ids], "quoted_us": [i % 50 * 1_000_000 for i in ids]})
        return pd.concat(p.handleInputRows((7,), iter([d[:30], d[30:]]), None))
    first, second = trigger(list(range(60))), trigger(list(range(60, 120)))
    assert store.calls <= 8 and len(store.timers) == 1
    newest = {}
    for i in range(120):
        k = (f"b{i % 5}", "over" if i % 2 else "under", str(i % 4))
        newest[k] = max(newest.get(k, (-1,)), (i % 50 * 1_000_000, -100.0 - i, i))
    last = pd.concat([first, second]).drop_duplicates(["book", "side", "point_key"], keep="last")
    assert {(r.book, r.side, r.point_key): (r.quoted_us, r.price, r.event_id) for r in last.itertuples()} == newest
    # the timer is that of the oldest quote; at its end it withdraws those alone that are as old
    ends = sorted({q[0] // 1000 + 1_800_000 for q in newest.values()})
    for end in ends:
        assert store.timers == {end}
        gone = pd.concat(p.handleExpiredTimer((7,), Clock(end), Clock(end)))
        store.timers.remove(end)
        assert not gone["live"].any() and set(gone["event_id"]) == {q[2] for q in newest.values() if q[0] // 1000 + 1_800_000 == end}
    assert store.value is None and not store.timers


def test_quotes_end_at_the_watermark(spark):
    """The watermark stops at 30 minutes and 1 ms: a quote of 1 ms is withdrawn, one of 2 ms stands, in the same game and in another."""
    ms = 1 / 60_000
    rows = [(1, 1, "b", "ml", "home", None, -110.0, 0), (2, 1, "c", "ml", "home", None, -110.0, ms), (3, 1, "d", "ml", "home", None, -110.0, 2 * ms), (4, 2, "b", "ml", "home", None, -110.0, ms)]
    updates = drain(stateful.latest_with_expiry(replay(frame(spark, rows), F.col("event_id").asc(), 1, "edge", ("odds_time_utc", at(62 + 2 * ms))), 30.0), "edge", "update")
    assert {r["event_id"]: r["live"] for r in stateful.standing(updates).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_parts_of_a_replay_are_several_files_and_one_trigger(spark):
    rows = [(i, i % 7, "b", "ml", "home", None, -110.0, i / 10) for i in range(400)]
    stream, seen = replay(frame(spark, rows), F.col("event_id").asc(), 4, "files", ("odds_time_utc", at(80)), file_rows=30), {}

    def look(batch, n):
        got = batch.select("event_id", "file").collect()
        seen[n] = (sorted(r[0] for r in got if r[0] is not None), len({r[1] for r in got}))
    stream.withColumn("file", F.input_file_name()).writeStream.trigger(availableNow=True).foreachBatch(look).start().awaitTermination()
    assert [seen[k][0] for k in sorted(seen)] == [list(range(k, k + 100)) for k in (0, 100, 200, 300)] + [[], []]
    assert all(files == 3 for _, files in seen.values())
