"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from linewell import catalog
from linewell.catalog import models

HEADLINE = ["quotes_pairs_novig", "quotes_reject_reasons", "reference_ml_loo", "reference_lines_loo", "feed_match_kickoff", "team_games", "qb_games",
            "availability_features", "starter_status", "grade_profit_clv", "prob_table", "calibration_documents", "bet_table_grouping_sets", "max_drawdown",
            "cluster_bootstrap_blocks", "horizon_select", "slate_coverage", "wager_intake_prefix", "chain_seal", "ewma_ratings", "key_number_weights",
            "coupled_ratings", "ridge_predictions", "decisions", "walk_forward_scores"]

SHARED = {"coupled_ratings": ("ratings", "features"), "ridge_predictions": ("ratings", "features", "model"), "decisions": ("ratings", "features", "model"),
          "walk_forward_scores": ("ratings", "features", "model", "predictions")}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g")).config("spark.sql.shuffle.partitions", cpus).config("spark.log.level", "ERROR"))
    if "BENCH_CHECKPOINT_DIR" not in os.environ:
        os.environ["BENCH_CHECKPOINT_DIR"] = tempfile.mkdtemp(prefix="spark-")
    spark = b.config("spark.checkpoint.dir", os.environ["BENCH_CHECKPOINT_DIR"]).getOrCreate()
    spark.range(1000).selectExpr("sum(id)").collect()
    q, times = catalog.queries(), {}
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    for name in names:
        for part in SHARED.get(name, ()):   # what several queries share is timed apart, once
            if f"build_{part}" not in times:
                t = time.perf_counter()
                getattr(models, f"_{part}")(spark, sf_dir)
                times[f"build_{part}"] = round(time.perf_counter() - t, 3)
        t = time.perf_counter()
        q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
