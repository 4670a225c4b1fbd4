"""Readers and writers on files that Spark writes from the given tables, and schedule selections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.catalog import base as b
from linewell.functions import times
from linewell.operators import schedule
from linewell.sources import readers, schemas, writers
from linewell.streaming.sinks import new_folder


def _as(df: DataFrame, schema: T.StructType, **named: Column) -> DataFrame:
    """The columns of a file schema; those that the table lacks are null."""
    return df.select(*[(named[f.name] if f.name in named else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def schedule_file(spark, sf):
    """A schedule as text with NA for nulls and old team codes, read back."""
    g = b.table(spark, sf, "games")
    path = new_folder(spark, "schedule")
    d = _as(g, schemas.GAMES, home_team=F.col("home_raw"), away_team=F.col("away_raw"), gameday=F.date_format("gameday", "yyyy-MM-dd"))
    d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in d.columns]).write.option("header", True).csv(path)
    r = readers.read_games(spark, path)
    return r.select(F.col("game_id").cast("long").alias("game_id"), "season", "week", F.date_format("gameday", "yyyy-MM-dd").alias("day"), "home_team", "away_team", "home_score", "away_score", "result", "spread_line", "roof", "wind", "location")


def play_files(spark, sf):
    """Plays by season on files; two seasons read."""
    path = new_folder(spark, "plays")
    _as(b.table(spark, sf, "plays"), schemas.PLAYS).write.partitionBy("season").parquet(path)
    r = readers.read_plays(spark, path, [2011, 2013])
    return r.groupBy("season", "posteam").agg(F.count(F.lit(1)).alias("plays"), b.r6(F.sum("epa")).alias("epa"), F.count("qb_dropback").alias("known"))


def injury_files(spark, sf):
    path = new_folder(spark, "injuries")
    _as(b.table(spark, sf, "injuries"), schemas.INJURIES).write.parquet(path)
    r = readers.read_injuries(spark, path, 2012)
    return r.groupBy("team", "week", "report_status").agg(F.count(F.lit(1)).alias("n"), F.min("gsis_id").alias("first"))


def snap_files(spark, sf):
    path = new_folder(spark, "snaps")
    _as(b.table(spark, sf, "snaps"), schemas.SNAPS).write.parquet(path)
    r = readers.read_snaps(spark, path)
    return r.groupBy("season", "team").agg(F.count(F.lit(1)).alias("n"), b.r6(F.sum("offense_pct")).alias("offense"), F.count("defense_pct").alias("defense_known"))


def crosswalk_file(spark, sf):
    path = new_folder(spark, "players")
    _as(b.table(spark, sf, "crosswalk"), schemas.PLAYERS).write.parquet(path)
    return readers.read_crosswalk(spark, path).groupBy("gsis_id").agg(F.count(F.lit(1)).alias("n"), F.min("pfr_id").alias("pfr_id"))


def manual_quote_file(spark, sf):
    """Quotes from a user's file: some with a kickoff that isn't the game's, some with an unusable price; what is accepted."""
    k = b.kickoffs(spark, sf)
    d = b.table(spark, sf, "offers").join(k, "game_id")
    path = new_folder(spark, "manual")
    given = F.timestamp_seconds(F.unix_seconds("kickoff") + F.when(F.col("event_id") % 7 == 0, 3600).otherwise(0))
    cols = {"kickoff_utc": times.iso(given), "odds_time_utc": F.col("odds_time"), "price": F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("price").cast("string"))}
    d.select(*[(cols[c] if c in cols else F.col(c)).cast("string").alias(c) for c in schemas.MANUAL_QUOTES]).write.option("header", True).csv(path)
    ok, rejected = readers.read_manual_quotes(spark, path, k.select(F.col("game_id").cast("string").alias("game_id"), "kickoff"), 10)
    good = ok.groupBy("market", "side").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), b.r6(F.sum("price")).alias("prices"))
    return good.unionByName(rejected.groupBy("market", "side").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("rejected "), "market").alias("market"), "side", "n", F.lit(0).cast("long").alias("priced"), F.lit(None).cast("double").alias("prices")))


def season_refresh(spark, sf):
    """Plays by season and team, then one season written anew: only that one changes."""
    d = b.table(spark, sf, "plays").groupBy("season", "posteam").agg(F.count(F.lit(1)).alias("plays"))
    path = new_folder(spark, "seasons")
    writers.refresh_season_aggregates(d, path)
    writers.refresh_season_aggregates(d.filter("season = 2011").withColumn("plays", -F.col("plays")), path)
    return spark.read.parquet(path).select(F.col("season").cast("int").alias("season"), "posteam", "plays")


def slate_days(spark, sf):
    """Games of 45 days from a date on."""
    return schedule.day_range(b.table(spark, sf, "games"), "2011-10-01", 45).select("game_id", "home_team")


def started_games(spark, sf):
    """Slate games two hours from now: those still ahead, and the others with the reason they are dropped for."""
    now = F.timestamp_seconds(F.lit(b.NOW_EPOCH + 7200))
    g = b.slate_games(spark, sf).withColumn("kickoff", F.when(F.col("game_id") % 5 != 0, F.col("kickoff")))
    ahead, gone = schedule.not_started(g, now)
    return ahead.select("game_id", F.lit("").alias("note")).unionByName(gone.select("game_id", "note"))


def training_cut(spark, sf):
    return schedule.training_rows(b.table(spark, sf, "games"), "2011-12-01").select("game_id", "season")


QUERIES = {f.__name__: f for f in (schedule_file, play_files, injury_files, snap_files, crosswalk_file, manual_quote_file, season_refresh, slate_days, started_games, training_cut)}

ORACLES = {
    "schedule_file": b.oracle(["games"], "SELECT game_id, season, week, strftime(gameday, '%Y-%m-%d') AS day, home_team, away_team, home_score, away_score, result, spread_line, roof, wind, location FROM games"),
    "play_files": b.oracle(["plays"], "SELECT season, posteam, count(*) AS plays, round(sum(epa), 6) AS epa, count(qb_dropback) AS known FROM plays WHERE season IN (2011, 2013) GROUP BY 1, 2"),
    "injury_files": b.oracle(["injuries"], "SELECT team, week, report_status, count(*) AS n, min(gsis_id) AS first FROM injuries WHERE season = 2012 GROUP BY 1, 2, 3"),
    "snap_files": b.oracle(["snaps"], "SELECT season, team, count(*) AS n, round(sum(offense_pct), 6) AS offense, count(defense_pct) AS defense_known FROM snaps GROUP BY 1, 2"),
    "crosswalk_file": b.oracle(["crosswalk"], "SELECT gsis_id, count(*) AS n, min(pfr_id) AS pfr_id FROM crosswalk WHERE gsis_id IS NOT NULL AND pfr_id IS NOT NULL GROUP BY 1"),
    "manual_quote_file": b.oracle(["offers", "slate"], """SELECT CASE WHEN event_id % 7 = 0 OR kickoff_epoch IS NULL THEN concat('rejected ', market) ELSE market END AS market, side, count(*) AS n, count(*) FILTER (kickoff_epoch IS NOT NULL AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND price IS NOT NULL) AS priced,
  round(sum(price) FILTER (kickoff_epoch IS NOT NULL AND event_id % 7 <> 0 AND event_id % 11 <> 0), 6) AS prices FROM offers JOIN slate ON slate.game_id = offers.game_id GROUP BY 1, 2"""),
    "season_refresh": b.oracle(["plays"], "SELECT season, posteam, CASE WHEN season = 2011 THEN -count(*) ELSE count(*) END AS plays FROM plays GROUP BY 1, 2"),
    "slate_days": b.oracle(["games"], "SELECT game_id, home_team FROM games WHERE gameday >= DATE '2011-10-01' AND gameday < DATE '2011-10-01' + 45"),
    "started_games": b.oracle(["slate", "games"], f"""SELECT s.game_id, CASE WHEN s.game_id % 5 = 0 OR kickoff_epoch IS NULL THEN 'kickoff unknown' WHEN kickoff_epoch <= {b.NOW_EPOCH + 7200} THEN concat('kickoff passed at ', {b.duck_iso('kickoff_epoch')}) ELSE '' END AS note FROM slate s JOIN games g ON g.game_id = s.game_id"""),
    "training_cut": b.oracle(["games"], "SELECT game_id, season FROM games WHERE result IS NOT NULL AND gameday < DATE '2011-12-01' AND season > (SELECT min(season) FROM games)"),
}
