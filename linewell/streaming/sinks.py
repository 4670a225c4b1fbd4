"""Running a stream to the end of its input into files of the shared folder."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewell.functions.joins import shared_dir
from linewell.operators.order import with_positions


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


FILE_ROWS = 200_000     # of a replayed part: one task writes and one reads them


def replay(table: DataFrame, order: Column, parts: int, label: str, clock: tuple[str, Column] | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """A table as a stream of ``parts`` micro-batches in order of arrival.

    With ``clock`` (column, time) two more batches follow, of rows that hold the time alone: a heartbeat, which moves watermarks on
    when no more data comes. Every part and beat is the same number of files, of about ``file_rows`` rows, and read as one trigger.
    """
    spark, path = table.sparkSession, new_folder(table.sparkSession, label)
    placed = with_positions(table, [order], "arrival", spread_ties=False)
    rows = placed.count()
    part = F.floor(F.col("arrival") * parts / F.lit(max(1, rows)))
    files = max(1, rows // parts // file_rows)     # fewer than a part has rows, so none is empty
    for k in range(parts):
        placed.filter(part == k).repartitionById(files, F.pmod("arrival", F.lit(files)).cast("int")).drop("arrival").write.mode("append").parquet(path)
    if clock is not None:
        beat = spark.range(0, files, 1, files).select(*[(clock[1] if f.name == clock[0] else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
        for _ in range(2):
            beat.write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def split_late(stream: DataFrame, time_col: str, late_minutes: float) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows behind the watermark with ``watermark``) of a stream, none of them lost.

    The watermark of a micro-batch is the newest time of all batches ahead of it, less the allowed lateness. Each batch writes that newest time
    beside its rows, so the split of a replayed batch is the same.
    """
    spark = stream.sparkSession
    good, late, clock, check = (new_folder(spark, f"late-{n}") for n in ("good", "late", "clock", "checkpoint"))
    newest = F.max(F.unix_micros(time_col))

    def write(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{clock}/batch={batch_id - 1}").first()[0] if batch_id else None
        mark = None if before is None else F.timestamp_micros(F.lit(before - int(late_minutes * 60_000_000)))
        behind = F.lit(False) if mark is None else F.coalesce(F.col(time_col) < mark, F.lit(False))
        batch.filter(~behind).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        batch.filter(behind).withColumn("watermark", F.lit(None).cast("timestamp") if mark is None else mark).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.agg(F.greatest(newest, F.lit(before).cast("bigint")).alias("t")).coalesce(1).write.mode("overwrite").parquet(f"{clock}/batch={batch_id}")
    q = stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if q.lastProgress is None:
        none = spark.createDataFrame([], stream.schema)
        return none, none.withColumn("watermark", F.lit(None).cast("timestamp"))
    return tuple(spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch") for folder in (good, late))


def drain(stream: DataFrame, label: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Processes all available input and returns what was written; the progress reports of all triggers go to ``progress``.

    Each micro-batch overwrites its own sub-folder, so a replayed batch leaves no duplicates
    (exactly-once together with the stream's checkpoint). In complete mode only the last batch counts.
    """
    spark = stream.sparkSession
    out, check = new_folder(spark, label), new_folder(spark, f"{label}-checkpoint")
    schema, last = stream.schema, []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last[:] = [batch_id]
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    if not last:
        return spark.createDataFrame([], schema)
    path = f"{out}/batch={last[0]}" if mode == "complete" else f"{out}/batch=*"
    return spark.read.schema(schema).parquet(path)
