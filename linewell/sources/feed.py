"""Nested quote feeds and schedule lines, flattened to long quotes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.functions import prices, times
from linewell.functions.joins import lookup, once
from linewell.sources.views import FULL_NAMES, TEAM_CODES

# Feed message layout and market names.
FEED_SCHEMA = ("home_team string, away_team string, commence_time string, bookmakers array<struct<key string, last_update string, "
               "markets array<struct<key string, last_update string, outcomes array<struct<name string, price double, point double>>>>>>")
FEED_MARKETS = {"h2h": "ml", "spreads": "spread", "totals": "total"}
MATCH_MINUTES = 360.0
CODES = dict(zip(FULL_NAMES.split(","), TEAM_CODES.split(",")))


def _map(pairs: dict):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def parse_feed(messages: DataFrame, codes: dict[str, str] = CODES) -> DataFrame:
    """One row per usable feed message (``payload`` JSON text): team codes, start time, nested bookmakers."""
    keep = [c for c in messages.columns if c != "payload"]
    team = _map(codes)
    d = once(messages, j=F.from_json("payload", FEED_SCHEMA)).select(*keep, "j.*")
    return (once(d, commence=times.parse_utc(F.col("commence_time"))).filter(F.col("commence").isNotNull())
            .select(*keep, F.col("home_team").alias("home_full"),
                    F.try_element_at(team, F.col("home_team")).alias("home_team"), F.try_element_at(team, F.col("away_team")).alias("away_team"), "commence", "bookmakers"))


def flatten_feed(parsed: DataFrame) -> DataFrame:
    """One row per outcome of a known market; other columns of the message are kept."""
    keep = [c for c in parsed.columns if c not in ("home_full", "bookmakers")]
    d = parsed.select(*keep, "home_full", F.explode("bookmakers").alias("bk"))
    d = d.select(*keep, "home_full", "bk.key", "bk.last_update", F.explode("bk.markets").alias("mk"))
    d = d.withColumn("market", F.try_element_at(_map(FEED_MARKETS), F.col("mk.key"))).filter(F.col("market").isNotNull())
    d = d.select("*", F.explode("mk.outcomes").alias("oc"))
    side = (F.when(F.col("market") == "total", F.lower("oc.name"))
            .when(F.col("oc.name") == F.col("home_full"), "home").otherwise("away"))
    return d.select(*keep, F.col("key").alias("book"), "market", side.alias("side"), F.col("oc.point").alias("point"), F.col("oc.price").alias("price"),
                    F.coalesce("mk.last_update", "last_update").alias("odds_time"))


def match_games(parsed: DataFrame, games: DataFrame, minutes: float = MATCH_MINUTES) -> DataFrame:
    """Messages with the game of the same league and teams that starts within ``minutes`` (the last match wins).

    The time condition becomes part of the join key: games are entered under their own and both
    neighbouring time buckets, as wide as the tolerance, and a message looks into one bucket. A pairing
    that meets many times never compares all its messages with all its games, and a message meets its
    candidates (games of one pairing within hours of each other) as one row.
    """
    width = int(minutes * 60)
    keys = ["league", "home_team", "away_team", "bucket"]
    own = F.floor(F.unix_seconds("kickoff") / width)
    g = games.withColumn("bucket", F.explode(F.array(own - 1, own, own + 1)))
    g = g.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("game_id", "kickoff")), False).alias("games"))
    d = lookup(parsed.withColumn("bucket", F.floor(F.unix_seconds("commence") / width)), g, keys, "inner")
    near = F.filter("games", lambda x: F.abs(F.unix_micros(F.col("commence")) - F.unix_micros(x["kickoff"])) <= width * 1_000_000)
    return d.withColumn("game_id", F.get(near, 0)["game_id"]).filter("game_id is not null").drop("bucket", "games")


def consensus_quotes(games: DataFrame) -> DataFrame:
    """Long quotes of the schedule's own closing lines: up to six rows per game, untimed."""
    null, default = F.lit(None).cast("double"), F.lit(prices.DEFAULT_PRICE)

    def row(market, side, point, price, present):
        return F.struct(F.lit(market).alias("market"), F.lit(side).alias("side"), point.alias("point"), price.alias("price"), present.alias("present"))
    c = F.col
    has_ml = c("home_moneyline").isNotNull() & c("away_moneyline").isNotNull()
    rows = F.array(
        row("spread", "home", 0.0 - c("spread_line"), F.coalesce("home_spread_odds", default), c("spread_line").isNotNull()),
        row("spread", "away", c("spread_line"), F.coalesce("away_spread_odds", default), c("spread_line").isNotNull()),
        row("ml", "home", null, c("home_moneyline"), has_ml),
        row("ml", "away", null, c("away_moneyline"), has_ml),
        row("total", "over", c("total_line"), F.coalesce("over_odds", default), c("total_line").isNotNull()),
        row("total", "under", c("total_line"), F.coalesce("under_odds", default), c("total_line").isNotNull()))
    return (games.select("game_id", F.inline(rows)).filter("present").drop("present")
            .select("game_id", F.lit("consensus").alias("book"), "market", "side", "point", "price",
                    F.lit("consensus").alias("source"), F.lit(None).cast("string").alias("odds_time")))


def gather_quotes(*sources: DataFrame) -> DataFrame:
    """All quote sources as one table."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
