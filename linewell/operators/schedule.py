"""Schedule selections: slates, forward windows, training cuts, source freshness."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions import times


def with_kickoff(games: DataFrame) -> DataFrame:
    return games.withColumn("kickoff", times.kickoff_utc(F.col("gameday"), F.col("gametime")))


def define_slate(games: DataFrame, season: int | None = None, weeks: tuple[int, int] | None = None,
                 date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Scheduled games of a season, an inclusive week range and an inclusive date range."""
    g = games
    if season is not None:
        g = g.filter(F.col("season") == season)
    if weeks is not None:
        g = g.filter(F.col("week").between(*weeks))
    if date_from is not None:
        g = g.filter(F.col("gameday") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        g = g.filter(F.col("gameday") <= F.lit(date_to).cast("date"))
    return with_kickoff(g).withColumn("played", F.col("result").isNotNull())


def day_range(games: DataFrame, start: str, days: int) -> DataFrame:
    """Games on [start, start + days)."""
    first = F.lit(start).cast("date")
    return games.filter((F.col("gameday") >= first) & (F.col("gameday") < F.date_add(first, days)))


def not_started(games: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(games still ahead, games dropped because the kickoff is unknown or has passed, with a note that says which)."""
    gone = F.col("kickoff").isNull() | (F.col("kickoff") <= now)
    note = F.when(F.col("kickoff").isNull(), "kickoff unknown").otherwise(F.concat(F.lit("kickoff passed at "), times.iso(F.col("kickoff"))))
    return games.filter(~gone), games.filter(gone).withColumn("note", note)


def training_rows(games: DataFrame, cutoff: str) -> DataFrame:
    """Played games before a date, without the first season (its ratings are still warming up)."""
    first = games.agg(F.min("season").alias("_first"))
    cut = games.filter(F.col("result").isNotNull() & (F.col("gameday") < F.lit(cutoff).cast("date")))
    return cut.join(F.broadcast(first), F.col("season") > F.col("_first")).drop("_first")      # one-row side


def forward_view(games: DataFrame, as_of: str, days: int) -> DataFrame:
    """Flags per game at a decision time: current season, forward window, next unplayed day, started."""
    now = times.parse_utc(F.lit(as_of))
    later = F.timestamp_micros(F.unix_micros(now) + F.lit(days * 86_400_000_000))
    open_day = F.col("result").isNull() & (F.col("gameday") >= F.to_date(now))
    facts = games.agg(F.coalesce(F.min(F.when(F.col("result").isNull(), F.col("season"))), F.max("season")).alias("current_season"),
                      F.min(F.when(open_day, F.col("gameday"))).alias("_next"))      # one row by construction
    k = F.col("kickoff")
    return (with_kickoff(games).join(F.broadcast(facts), F.lit(True))
            .withColumns({"played": F.col("result").isNotNull(), "in_window": F.coalesce((k > now) & (k <= later), F.lit(False)),
                          "next_day_slate": F.col("gameday") == F.col("_next"), "started": F.coalesce(k <= now, F.lit(True))}))


def source_freshness(games: DataFrame, injuries: DataFrame, plays: DataFrame) -> DataFrame:
    """Latest game day with a result, latest injury and play week, per season."""
    def part(name, df, col):
        return df.groupBy("season").agg(F.max(col).cast("string").alias("latest")).select(F.lit(name).alias("source"), "season", "latest")
    return (part("schedule", games.filter(F.col("result").isNotNull()), "gameday")
            .unionByName(part("injuries", injuries, "week")).unionByName(part("plays", plays, "week")))
