import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linewell.operators.order import with_positions


def test_positions_are_dense_and_in_order(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("k"), "id").repartition(7)
    got = with_positions(df, [F.col("k").asc(), F.col("id").desc()], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(5000))
    by = sorted(got, key=lambda r: r["at"])
    assert [(r["k"], r["id"]) for r in by] == sorted([(r["k"], r["id"]) for r in got], key=lambda r: (r[0], -r[1]))


@pytest.mark.parametrize("spread", [True, False])
def test_ties_nulls_and_empty_tables(spark, spread):
    df = spark.createDataFrame([(None, 1), (2, 1), (2, 1), (2, 1), (1, 5), (None, 1)], "k int, v int")
    got = with_positions(df, [F.col("k").asc_nulls_last()], "at", spread).orderBy("at").collect()
    assert [r["k"] for r in got] == [1, 2, 2, 2, None, None] and [r["at"] for r in got] == list(range(6))
    assert with_positions(df.limit(0), [F.col("k").asc()], "at", spread).collect() == []
    with pytest.raises(ValueError):
        with_positions(df, [F.col("k").asc()], "v")


def test_equal_rows_are_spread(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be joined to one
    try:
        placed = with_positions(df, [F.col("k").asc()], "at")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [pq.read_metadata(f.removeprefix("file://")).num_rows for f in placed.inputFiles()]
    assert sum(sizes) == 20000 and max(sizes) < 12000
    assert placed.agg(F.sum("at")).first()[0] == 20000 * 19999 // 2
