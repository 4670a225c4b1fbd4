"""A training-data pipeline: quality, exact copies, near-copies, benchmark leaks, mixing.

Each stage reads what its predecessor kept, written as Parquet, and returns the columns of documents; the last one returns a
row for each copy that the mix takes, with its number in ``copy``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linewell.functions.joins import shared_dir
from linewell.llm import decontaminate, exact_dedup, mixing, quality, simhash
from linewell.llm.common import session


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of documents that aren't held out."""
    return quality.passing(docs, session(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    session(spark)
    return exact_dedup.distinct_texts(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies, by SimHash links and an exact check behind them, the smallest id stays."""
    session(spark)
    return simhash.one_of_each_group(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.clean(docs, session(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    session(spark)
    return mixing.copies(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("mixing", mixing_stage)]

ORACLE_SQL = None  # a trained classifier decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each keeps is written to the shared folder and read again."""
    session(spark)
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
