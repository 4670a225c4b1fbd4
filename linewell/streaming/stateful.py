"""Keyed state with timers: latest live quote with expiry, and ratings updated per finished game."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linewell.plans.league_state import EARLY_PRIOR, PARAMS, PRIOR_EVIDENCE, STARTS, TEAM_VALUES, gather, scatter
from linewell.plans.ratings import PASSER_FEATURES, TEAM_FEATURES, rating_input, run_of, team_features

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATEST = T.StructType([T.StructField(n, t) for n, t in (
    ("game_id", T.LongType()), ("book", T.StringType()), ("market", T.StringType()), ("side", T.StringType()), ("point_key", T.StringType()),
    ("event_id", T.LongType()), ("price", T.DoubleType()), ("quoted_us", T.LongType()), ("live", T.BooleanType()))])
KEY = ["game_id", "book", "market", "side", "point_key"]


QUOTE = KEY[1:]     # what tells a game's quotes apart
HELD = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in QUOTE]
                    + [T.StructField("quoted_us", T.ArrayType(T.LongType())), T.StructField("price", T.ArrayType(T.DoubleType())),
                       T.StructField("event_id", T.ArrayType(T.LongType())), T.StructField("timer_ms", T.LongType())])


class LatestQuote(StatefulProcessor):
    """Keeps the newest quote of each key of a game; a timer withdraws those that are older than the allowed age.

    A game's quotes (books by markets by lines, some dozens) are one state value with one timer, at the first end of its quotes: calls
    of the state store are counted in games and triggers, not in quotes.
    """

    def __init__(self, max_age_minutes: float):
        self.max_age_ms = int(max_age_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.game = handle.getValueState("game", HELD)

    def held(self) -> tuple[dict, int | None]:
        """(newest quotes by key, time of the timer)"""
        now = self.game.get()
        if now is None:
            return {}, None
        *columns, timer = tuple(now)
        n = len(QUOTE)
        return dict(zip(zip(*columns[:n]), zip(*columns[n:]))), timer

    def keep(self, quotes: dict, timer: int | None) -> None:
        end = min((t // 1000 for t, _, _ in quotes.values()), default=None)
        end = None if end is None else end + self.max_age_ms
        if end != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if end is not None:
                self.handle.registerTimer(end)
        if quotes:
            self.game.update((*(list(c) for c in zip(*quotes)), *(list(c) for c in zip(*quotes.values())), end))
        else:
            self.game.clear()

    def changes(self, game, quotes: dict, live: bool) -> pd.DataFrame:
        out = [(game, *k, i, price, t, live) for k, (t, price, i) in quotes.items()]
        return pd.DataFrame(out, columns=LATEST.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        quotes, timer = self.held()
        new = {}
        for b in rows:
            b = b[b["event_id"].notna()]   # the others only move the clock
            names = zip(*(b[n].tolist() for n in QUOTE))
            for k, q in zip(names, zip(b["quoted_us"].astype("int64").tolist(), b["price"].astype("float64").tolist(), b["event_id"].astype("int64").tolist())):
                if k not in quotes or q > quotes[k]:
                    quotes[k] = new[k] = q
        if new:
            self.keep(quotes, timer)
            yield self.changes(key[0], new, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        quotes, _ = self.held()
        clock = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())   # timers at the watermark fire
        old = {k: q for k, q in quotes.items() if q[0] // 1000 + self.max_age_ms <= clock}
        # the timer that fires is removed by the store
        self.keep({k: q for k, q in quotes.items() if k not in old}, None)
        yield self.changes(key[0], old, False)

    def close(self) -> None:
        pass


def standing(updates: DataFrame) -> DataFrame:
    """The last change of each key; ``live`` tells whether its quote still stands. Changes without a game only moved the clock."""
    order = F.struct("quoted_us", "price", "event_id", ~F.col("live"))
    last = updates.filter(F.col("game_id").isNotNull()).groupBy(*KEY).agg(F.max_by(F.struct("event_id", "price", "quoted_us", "live"), order).alias("q"))
    return last.select(*KEY, "q.*")


def latest_with_expiry(valid: DataFrame, max_age_minutes: float, skew_minutes: float = 2.0) -> DataFrame:
    """Changes of the latest live quote per key: new quotes (live) and withdrawals (not live).

    A valid quote may be ``max_age_minutes`` old and the newest one ``skew_minutes`` ahead of the clock: the watermark stays more than both
    behind, so that none counts as late (rows at the watermark do).
    """
    valid.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    d = valid.withWatermark("odds_time_utc", f"{max_age_minutes + skew_minutes:g} minutes 1 millisecond").select(
        "game_id", "book", "market", "side", F.coalesce(F.col("point").cast("string"), F.lit("-")).alias("point_key"), "event_id", "price",
        F.unix_micros("odds_time_utc").alias("quoted_us"), "odds_time_utc")
    return d.groupBy("game_id").transformWithStateInPandas(LatestQuote(max_age_minutes), LATEST, "Update", "eventTime")


# ---------------------------------------------------------------- ratings

RATING_OUT = T.StructType([T.StructField("league", T.LongType()), T.StructField("game_id", T.LongType())]
                          + [T.StructField(n, T.DoubleType()) for n in (*TEAM_FEATURES, *PASSER_FEATURES, "f_qb")])
NAME = T.StructType([T.StructField("name", T.StringType())])
TEAM_STATE = T.StructType([T.StructField("season", T.LongType()), T.StructField("rates", T.ArrayType(T.DoubleType())), T.StructField("base", T.DoubleType())])
PASSER_STATE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("value", "weight", "career")])
LEAGUE_STATE = T.StructType([T.StructField("levels", T.ArrayType(T.DoubleType())), T.StructField("pool_value", T.DoubleType()), T.StructField("pool_weight", T.DoubleType())])


def rating_rows(games: DataFrame, team_games: DataFrame, passer_games: DataFrame) -> DataFrame:
    """Rating input with the passers of both teams as arrays, for streams of finished and coming games."""
    own = passer_games.groupBy("game_id", "team").agg(F.array_sort(F.collect_list(F.struct("qb_id", F.col("dropbacks").cast("double").alias("dropbacks"), "epa"))).alias("passers"))
    d = rating_input(games, team_games)
    for side in ("home", "away"):
        d = d.join(own.select("game_id", F.col("team").alias(f"{side}_team"), F.col("passers").alias(f"{side}_passers")), ["game_id", f"{side}_team"], "left")
    return d


class LeagueRatings(StatefulProcessor):
    """Features of the games of a league as they arrive. Teams and passers are entries of map states: a trigger reads and rewrites
    those of its games alone."""

    def __init__(self, params: dict):
        self.p = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", NAME, TEAM_STATE)
        self.passers = handle.getMapState("passers", NAME, PASSER_STATE)
        self.league = handle.getValueState("league", LEAGUE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        games = pd.concat(list(rows)).sort_values(["gameday", "game_id"]).reset_index(drop=True)   # one league's games of one trigger
        levels, *pool = tuple(self.league.get()) if self.league.exists() else (STARTS, 0.0, 0.0)
        teams = sorted({*games["home_team"], *games["away_team"]})
        old = [tuple(self.teams.getValue((t,))) if self.teams.containsKey((t,)) else (None, [0.0] * len(TEAM_VALUES), None) for t in teams]
        run = run_of(games, teams, [o[0] for o in old])
        state = gather(np.array([o[1] for o in old]), np.array(levels))
        ahead, after = run.replay(state, self.p)
        rated, base = self.passers_of(games, run, after, pool, [o[2] for o in old])
        now, levels = scatter(state)
        last = {}
        for home, away, season in zip(run.home, run.away, games["season"]):
            last[home] = last[away] = int(season)
        for k, t in enumerate(teams):
            self.teams.updateValue((t,), (last[k], now[k].tolist(), base[k]))
        self.league.update((levels.tolist(), *pool))
        yield pd.DataFrame({"league": games["league"], "game_id": games["game_id"], **team_features(ahead), **rated})[RATING_OUT.names]

    def passers_of(self, games: pd.DataFrame, run, after: np.ndarray, pool: list[float], base: list[float | None]) -> tuple[dict, list]:
        """PASSER_FEATURES and f_qb of the games, and the teams' passer baselines after them; ``pool`` is moved in place."""
        listed = [[r for r in rows if r["dropbacks"]] if rows is not None else [] for c in ("home_passers", "away_passers") for rows in games[c]]
        starters = [[q if isinstance(q, str) else None for q in games[c]] for c in ("home_qb_id", "away_qb_id")]
        names = sorted({r["qb_id"] for rows in listed for r in rows} | {q for side in starters for q in side if q})
        number = {q: k for k, q in enumerate(names)}
        sums = np.array([tuple(self.passers.getValue((q,))) if self.passers.containsKey((q,)) else (0.0, 0.0, 0.0) for q in names]).reshape(-1, 3)
        shrink, step = self.p["qb_shrink"], 2 * self.p["a_eff"]
        out = np.full((len(games), 2, 3), np.nan)
        moved = np.zeros(len(names), bool)

        def rating(at) -> np.ndarray:
            prior = pool[0] / pool[1] if pool[1] > PRIOR_EVIDENCE else EARLY_PRIOR
            return (sums[at, 0] + shrink * prior) / (sums[at, 1] + shrink)

        for i in range(len(games)):
            pair = (run.home[i], run.away[i])
            for s, k in enumerate(pair):
                q = starters[s][i]
                own = rating(number[q]) if q else np.nan
                out[i, s] = own, np.nan if base[k] is None else base[k], own - base[k] if q and base[k] is not None else 0.0
            result, _, _, _, both, *_ = run.facts[i]
            if result != result or not both:
                continue
            for s, k in enumerate(pair):
                rows = listed[s * len(games) + i]
                if not rows:
                    continue
                at, n = [number[r["qb_id"]] for r in rows], np.array([r["dropbacks"] for r in rows])
                seen = float(n @ rating(at) / n.sum())
                base[k] = seen if base[k] is None else base[k] + step * (seen - base[k])
                value = np.array([np.nan if r["epa"] is None else r["epa"] for r in rows]) - after[i, 0] - after[i, 2 - s]
                sound = ~np.isnan(value)
                at, n, value = np.array(at)[sound], n[sound], value[sound]
                fresh = sums[at, 2] < self.p["qb_new"]
                pool[0] += float((n * value)[fresh].sum())
                pool[1] += float(n[fresh].sum())
                sums[at, :2] *= self.p["qb_decay"]
                sums[at] += np.column_stack([n * value, n, n])
                moved[at] = True
        for k in np.flatnonzero(moved):
            self.passers.updateValue((names[k],), tuple(sums[k].tolist()))
        columns = dict(zip(PASSER_FEATURES, (out[:, s, v] for v in range(3) for s in range(2))))
        return columns | {"f_qb": out[:, 0, 2] - out[:, 1, 2]}, base

    def close(self) -> None:
        pass


def rating_updates(games: DataFrame, params: dict | None = None) -> DataFrame:
    """Features of each arriving game, taken before its result moves the league's state.

    games: ``rating_rows``, arriving in date order between micro-batches; inside one, a league's rows are put in order first.
    """
    games.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return games.groupBy("league").transformWithStateInPandas(LeagueRatings({**PARAMS, **(params or {})}), RATING_OUT, "Append", "None")


def file_stream(spark: SparkSession, table: DataFrame, path: str) -> DataFrame:
    """A written table as a stream (used to replay history)."""
    table.write.parquet(path)
    return spark.readStream.schema(table.schema).parquet(path)
