"""Scans: schedules, plays, injuries, snaps, crosswalks, user files, manual quotes, logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.operators.history import tier_of
from linewell.operators.plays import current_code
from linewell.operators.validity import check_game_keys
from linewell.sources import schemas


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _nan_to_null(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Schedule CSV with scores and closing lines; current team codes, parsed day."""
    d = spark.read.schema(schemas.GAMES).option("header", True).option("nullValue", "NA").csv(path)
    return _nan_to_null(d).withColumns({"home_team": current_code(F.col("home_team")), "away_team": current_code(F.col("away_team")),
                                        "gameday": F.to_date("gameday")})


def read_plays(spark: SparkSession, path: str, seasons: list[int] | None = None) -> DataFrame:
    """Play table pruned to the needed columns; ``season`` is a partition column, so seasons prune files."""
    d = spark.read.schema(schemas.PLAYS).parquet(path)
    return _nan_to_null(d if seasons is None else d.filter(F.col("season").isin(*seasons)))


def _season_table(spark: SparkSession, path: str, schema: T.StructType, season: int | None) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    d = spark.read.schema(schema).parquet(path)
    d = d if season is None else d.filter(F.col("season") == season)
    return _nan_to_null(d).withColumn("team", current_code(F.col("team")))


def read_injuries(spark: SparkSession, path: str, season: int | None = None) -> DataFrame:
    """Injury reports; an unpublished season is an empty table."""
    return _season_table(spark, path, schemas.INJURIES, season)


def read_snaps(spark: SparkSession, path: str, season: int | None = None) -> DataFrame:
    return _season_table(spark, path, schemas.SNAPS, season)


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PLAYERS).parquet(path).dropna(subset=["gsis_id", "pfr_id"])


def read_user_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """User-kept CSV: ``#`` comments, all text, blanks are null; missing columns are an error, a missing file is empty.

    ``row_no`` follows the position in the file.
    """
    schema = schemas.texts(*columns)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("row_no", F.lit(0).cast("bigint"))
    d = spark.read.option("header", True).option("comment", "#").option("inferSchema", False).csv(path)
    lacking = [c for c in columns if c not in d.columns]
    if lacking:
        raise ValueError(f"{path} is missing columns {lacking}")
    return d.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns]).withColumn("row_no", F.monotonically_increasing_id())


def read_manual_quotes(spark: SparkSession, path: str, kickoffs: DataFrame, tolerance_minutes: float) -> tuple[DataFrame, DataFrame]:
    """(quotes, rejected rows) of a manual quote file; unusable numbers become null."""
    d = check_game_keys(read_user_csv(spark, path, schemas.MANUAL_QUOTES), kickoffs, tolerance_minutes)
    ok = d.filter("reason = ''").select("game_id", "book", "market", "side", F.col("point").try_cast("double").alias("point"),
                                        F.col("price").try_cast("double").alias("price"), F.lit("manual").alias("source"), F.col("odds_time_utc").alias("odds_time"))
    return ok, d.filter("reason <> ''")


def read_log(spark: SparkSession, path: str, data: T.StructType = schemas.FORECAST_DATA) -> DataFrame:
    """A JSON-lines log with the payload unnested; absent fields of older records are null."""
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([*data.fields, *T.StructType().add("recorded_utc", "string").add("hash", "string").fields]))
    d = spark.read.schema(schemas.log_record(data)).json(path)
    return d.select("data.*", "recorded_utc", "hash")


def import_legacy(spark: SparkSession, path: str, history: DataFrame) -> DataFrame:
    """Rows of the old CSV log in forecast layout; empty when the history already has legacy rows."""
    old = T.StructType([f for f in schemas.FORECAST.fields]).add("model_version", "string").add("logged_utc", "string")
    header = spark.read.text(path).limit(1).first()[0].split(",")
    by_name = {f.name: f for f in old.fields}
    d = spark.read.schema(T.StructType([by_name.get(h, T.StructField(h, T.StringType())) for h in header])).option("header", True).csv(path)
    cols = [F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.FORECAST.fields]
    d = d.select(*cols, "model_version", F.col("logged_utc").alias("run_utc"), F.lit(True).alias("legacy")).withColumns(
        {"reference": F.lit("schedule consensus (untimed)"), "reference_live": F.lit(False)})
    d = d.withColumns({"tier": tier_of(F.col("decision")), "recorded_utc": F.col("run_utc")})
    done = history.filter("legacy").select(F.lit(1).alias("k")).limit(1)
    return d.withColumn("k", F.lit(1)).join(done, "k", "left_anti").drop("k")


def file_times(df: DataFrame) -> DataFrame:
    """Files of a source with their modification times."""
    return df.select("_metadata.file_path", "_metadata.file_modification_time").distinct()
