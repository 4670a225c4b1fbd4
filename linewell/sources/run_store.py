"""Tables of runs, visible as a whole or not at all.

A run's tables are written to a folder of their own attempt, by Spark's writers, which survive lost and repeated tasks. Then one small file, the
run's manifest, is moved to its place in a single step that fails if it is taken. Readers only follow manifests: what a killed attempt
leaves behind is never read, and a run id that has a manifest adds nothing when it is written again.
"""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, path) -> str:
        stream = self._files(path).open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, run_id: str, text: str) -> bool:
        """Moves the manifest to its place; False if another attempt was first."""
        own, to = self._path("manifests", f".{run_id}-{uuid.uuid4().hex}"), self._path("manifests", f"{run_id}.json")
        out = self._files(own).create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, to, none)
            return True
        except Exception:
            if self._files(to).exists(to):
                self._files(own).delete(own, False)
                return False
            raise

    def manifest(self, run_id: str) -> dict | None:
        path = self._path("manifests", f"{run_id}.json")
        return json.loads(self._read(path)) if self._files(path).exists(path) else None

    def runs(self) -> list[str]:
        found = self._files(self._path()).globStatus(self._path("manifests", "*.json")) or []
        return sorted(s.getPath().getName().removesuffix(".json") for s in found)

    def write(self, frames: dict[str, DataFrame], run_id: str) -> bool:
        """Writes the tables of a run; True if they are the run's now, False if the run was there. Whatever fails leaves no table of it."""
        if not run_id or any(c in run_id for c in "/\\*?[]{}") or run_id.startswith("."):
            raise ValueError(f"unusable run id {run_id!r}")
        if self.manifest(run_id) is not None:
            return False
        attempt = f"data/{run_id}/{uuid.uuid4().hex}"
        tables, done = {}, False
        try:
            for name, df in frames.items():
                df.write.parquet(f"{self.root}/{attempt}/{name}")
                tables[name] = {"schema": df.schema.jsonValue(), **content(self.spark.read.schema(df.schema).parquet(f"{self.root}/{attempt}/{name}"))}
            snapshot = hashlib.sha256(json.dumps({n: [t["rows"], t["digest"]] for n, t in tables.items()}, sort_keys=True).encode()).hexdigest()
            done = self._publish(run_id, json.dumps({"run_id": run_id, "attempt": attempt, "tables": tables, "snapshot_id": snapshot}))
        finally:
            if not done:
                path = self._path(*attempt.split("/"))
                self._files(path).delete(path, True)   # this attempt's own folder
        return done

    def read(self, name: str, schema: T.StructType, runs: list[str] | None = None) -> DataFrame:
        """The rows of a table in all (or the named) runs, with run_id; runs without the table add none. Columns that a run lacks are null."""
        folders = []
        for run in self.runs() if runs is None else runs:
            m = self.manifest(run)
            if m is not None and name in m["tables"]:
                folders.append((run, m["attempt"], f"{self.root}/{m['attempt']}/{name}"))
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("run_id", F.lit(""))
        run_of = F.create_map(*[F.lit(x) for run, attempt, _ in folders for x in (attempt.rsplit("/", 1)[1], run)])
        d = self.spark.read.schema(schema).parquet(*[f for _, _, f in folders])
        return d.select(*[f.name for f in schema], F.element_at(run_of, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)).alias("run_id"))


def content(df: DataFrame) -> dict:
    """Rows of a table and a digest that doesn't depend on their order."""
    texts = df.select(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256).alias("h")) if df.columns else df.select(F.lit("").alias("h"))
    parts = [F.sum(F.conv(F.substring("h", k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in (1, 13, 25, 37)]
    rows, *sums = texts.agg(F.count(F.lit(1)), *parts).first()
    return {"rows": rows, "digest": hashlib.sha256("|".join(s or "0" for s in sums).encode()).hexdigest()}
