import pytest
from pyspark.sql import functions as F

from linewell.functions import times
from linewell.sources import readers, schemas, writers


def test_user_csv_and_manual_quotes(spark, tmp_path):
    p = tmp_path / "manual.csv"
    p.write_text("# a comment\ngame_id,kickoff_utc,book,market,side,point,price,odds_time_utc\n"
                 "G,2026-10-11T17:00:00Z,bk,spread,home,-3.5,abc,2026-10-11T16:00:00Z\nG,2026-10-12T17:00:00Z,bk,ml,home,,-110,\nX,2026-10-11T17:00:00Z,bk,ml,home,,-110,\n")
    k = spark.range(1).select(F.lit("G").alias("game_id"), times.parse_utc(F.lit("2026-10-11T17:00:00Z")).alias("kickoff"))
    ok, bad = readers.read_manual_quotes(spark, str(p), k, 10)
    r = ok.collect()
    assert len(r) == 1 and r[0]["price"] is None and r[0]["point"] == -3.5 and bad.count() == 2
    assert readers.read_user_csv(spark, str(tmp_path / "none.csv"), schemas.WEATHER).count() == 0
    with pytest.raises(ValueError):
        readers.read_user_csv(spark, str(p), schemas.WEATHER)


def test_history_round_trip_and_legacy(spark, tmp_path):
    line = '{"data":{"game_id":"g","price":-110.0,"run_id":"r"},"hash":"h","kind":"forecast","prev":"p","recorded_utc":"2026-10-11T15:00:00Z","seq":0}\n'
    (tmp_path / "log.jsonl").write_text(line)
    h = readers.read_log(spark, str(tmp_path / "log.jsonl"))
    assert h.first()["game_id"] == "g" and h.first()["hash"] == "h" and h.first()["legacy"] is None
    (tmp_path / "old.csv").write_text("game_id,kickoff_utc,market,side,price,decision,model_version,logged_utc\ng,2026-10-11T17:00:00Z,ml,home,-120,BET,v1,2026-10-11T12:00:00Z\n")
    old = readers.import_legacy(spark, str(tmp_path / "old.csv"), h)
    r = old.first()
    assert r["tier"] == "executable" and r["price"] == -120 and r["legacy"] and r["recorded_utc"] == "2026-10-11T12:00:00Z"
    assert readers.import_legacy(spark, str(tmp_path / "old.csv"), old).count() == 0


def test_snapshot_refuses_existing_run_and_late_completion(spark, tmp_path):
    df = spark.range(3)
    writers.save_snapshot({"x": df}, str(tmp_path), "r1")
    with pytest.raises(Exception):
        writers.save_snapshot({"x": df}, str(tmp_path), "r1")
    rows = spark.createDataFrame([("2026-10-11T15:00:00Z", "2026-10-11T15:00:01Z")], "recorded_utc string, prediction_completed_utc string")
    with pytest.raises(ValueError):
        writers.append_forecasts(rows, str(tmp_path / "h"), "r1")


def test_season_refresh_and_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "agg")
    writers.refresh_season_aggregates(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, season int"), path)
    writers.refresh_season_aggregates(spark.createDataFrame([(9, 2021)], "v int, season int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("season", "v").collect())) == [(2020, 1), (2021, 9)]
    d = spark.createDataFrame([("g", 2020, 1.5), ("h", 2021, float("nan"))], "game_id string, season int, epa double")
    d.write.partitionBy("season").parquet(str(tmp_path / "plays"))
    p = readers.read_plays(spark, str(tmp_path / "plays"), [2021])
    assert p.first()["epa"] is None and "PartitionFilters: [isnotnull(season" in p._jdf.queryExecution().toString().replace("#", " #").replace("season #", "season#")
    assert readers.read_injuries(spark, str(tmp_path / "nothing")).count() == 0
