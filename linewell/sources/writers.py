"""Sinks: run snapshots, forecast history, graded tables, cached aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.functions import times
from linewell.operators.history import tier_of
from linewell.sources import schemas
from linewell.sources.run_store import RunStore


def save_snapshot(frames: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Writes all input tables of a run as one unit; returns the snapshot id, a hash of their contents. An existing run is refused."""
    store = RunStore(next(iter(frames.values())).sparkSession, root)
    if not store.write(frames, run_id):
        raise FileExistsError(f"run {run_id} has a snapshot")
    return store.manifest(run_id)["snapshot_id"]


def forecast_rows(decisions: DataFrame, games: DataFrame, run_id: str, completed: Column, recorded: Column, model_version: str) -> DataFrame:
    """Decisions in history layout: game facts, tier and run stamps; rows of started games are left out."""
    g = games.select("game_id", F.col("season"), F.col("week"), "home_team", "away_team", times.iso(F.col("kickoff")).alias("kickoff_utc"))
    d = decisions.drop(*[c for c in ("season", "week", "home_team", "away_team", "kickoff_utc") if c in decisions.columns]).join(g, "game_id")
    if "post_kickoff" in d.columns:
        d = d.filter(~F.col("post_kickoff"))
    have = {"ev[fair 0.5 worse]": "ev_worse05", "ev[market only]": "ev_market_only", "price_source": "source"}
    cols = []
    for f in schemas.FORECAST.fields:
        src = have.get(f.name, f.name)
        col = F.col(f"`{src}`").cast(f.dataType) if src in d.columns else F.lit(None).cast(f.dataType)
        cols.append(col.alias(f.name))
    return d.select(*cols).withColumns({"tier": tier_of(F.col("decision")), "run_id": F.lit(run_id), "prediction_completed_utc": times.iso(completed),
                                        "model_version": F.lit(model_version), "recorded_utc": times.iso(recorded)})


def append_forecasts(rows: DataFrame, root: str, run_id: str) -> bool:
    """Records the forecasts of a run; refused as a whole when any row would be recorded before it was completed. A run that is
    recorded already adds nothing (False), so an append may be repeated."""
    early = rows.filter(times.parse_utc(F.col("recorded_utc")) < times.parse_utc(F.col("prediction_completed_utc")))
    if not early.isEmpty():
        raise ValueError("prediction completion is in the future; refusing to record")
    return RunStore(rows.sparkSession, root).write({"forecasts": rows}, run_id)


def read_forecasts(spark: SparkSession, root: str, schema: T.StructType = schemas.FORECAST_DATA) -> DataFrame:
    """The forecasts of all recorded runs."""
    return RunStore(spark, root).read("forecasts", schema)


def write_graded(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def refresh_season_aggregates(df: DataFrame, path: str) -> None:
    """Team or passer games by season: only the seasons present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
