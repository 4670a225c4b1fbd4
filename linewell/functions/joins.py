"""Join and materialisation helpers that hold up under skew and lost executors."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
_fallback_dir: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on (all are runtime settings)."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split hot join partitions even where that costs one more shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # the JVM never compiles methods above 8000 bytes of bytecode; let Spark split those stages instead
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a Python worker gets batches of bounded bytes, however long the rows are
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    }.items():
        spark.conf.set(key, value)
    return spark


def bounded_tasks(spark: SparkSession) -> SparkSession:
    """Settings that keep what one task of a shuffle holds from growing with the input.

    A compressed megabyte of narrow rows takes twenty or more in a sort or an aggregate, so a task gets about 8 MB; there are
    enough partitions for that, and adaptive execution joins them again where a table is small.
    """
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(8 << 20))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "800")
    return spark


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (an upper bound for filters and aggregates)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "left", salts: int = 0) -> DataFrame:
    """Join a large table to a keyed lookup whose keys may be hot in the large table.

    The lookup is broadcast only when the planner's estimate is below a fixed bound.  Beyond it the
    join shuffles and adaptive execution splits hot partitions; with ``salts`` the fact rows of a key
    are spread over that many partitions up front and each lookup row is repeated once per salt.
    ``fact`` is on the left ('left', 'inner', 'left_semi' or 'left_anti').
    """
    if salts:
        spread = fact.withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int"))
        copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return spread.join(copies, [*on, "_salt"], how).drop("_salt")
    if planned_bytes(dim) <= BROADCAST_BYTES:
        return fact.join(F.broadcast(dim), on, how)
    return fact.join(dim, on, how)


def matched(fact: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Keep ('left_semi'), drop ('left_anti') or complete ('left', 'inner') rows whose key is among ``keys``, a table that grows with the input.

    Always shuffled: the planner's estimate counts the bytes of compressed files and can't keep such a table off the driver.
    """
    return fact.join(keys.hint("merge"), on, how)


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    Catalyst copies the definition of a plain column into every filter and field access above it, which
    repeats regular expressions and JSON parsing many times. A generator of one row stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a local one only where none is named and there is no cluster (tests)."""
    global _fallback_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder: intermediate tables need one that all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="spark-")
    return _fallback_dir


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a plan once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
