"""An archive of rows by key that grows batch by batch, with a Bloom filter of its keys beside it.

A batch first asks the filter. Rows that it doesn't know are new without a look at the archive; only the others are compared with archived
rows, of which only those with a key that was asked for are moved. Rows and filter of a batch become visible together (``RunStore``), and
a batch id that is there adds nothing when it is sent again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.functions.joins import lookup, matched, materialise
from linewell.sources.run_store import RunStore

WORDS = 1024         # of 64 bits, in a bucket of the filter
HASHES = 4
BITS_PER_KEY = 10
FILTER = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))])


def key_tag(key: list[str]) -> Column:
    """A digest of the key; nulls match."""
    return F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)


class Archive:
    """``keys`` is about how many keys are expected; beyond it the filter lets more rows through, and results stay exact."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], keys: int = 1_000_000):
        self.store, self.schema, self.key = RunStore(spark, root), schema, key
        self.buckets = max(1, -(-keys * BITS_PER_KEY // (WORDS * 64)))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("_tag", F.lit(0)), F.lit(self.buckets))

    @staticmethod
    def _places() -> list[Column]:
        return [F.pmod(F.xxhash64("_tag", F.lit(k)), F.lit(WORDS * 64)) for k in range(1, HASHES + 1)]

    def rows(self) -> DataFrame:
        return self.store.read("rows", self.schema)

    def _filter(self) -> DataFrame:
        """The filter of all batches: the last one holds those before it."""
        runs = self.store.runs()
        return self.store.read("filter", FILTER, runs[-1:]).drop("run_id")

    def _filter_of(self, tagged: DataFrame) -> DataFrame:
        set_ = tagged.select(self._bucket().alias("bucket"), F.explode(F.array(*self._places())).alias("at"))
        words = set_.groupBy("bucket", F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        of_bucket = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))   # WORDS entries at most
        return of_bucket.select("bucket", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(WORDS - 1).cast("long")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("words"))

    def split(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that the filter doesn't know, rows that it may know), each with ``_tag``; one row of each key."""
        fresh = batch.dropDuplicates(self.key).withColumn("_tag", key_tag(self.key))
        asked = lookup(fresh.withColumn("bucket", self._bucket()), self._filter(), ["bucket"])
        known = F.lit(True)
        for at in self._places():
            known = known & (F.element_at("words", (F.floor(at / 64) + 1).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0)
        marked = materialise(asked.withColumn("_known", F.coalesce(known, F.lit(False))).drop("bucket", "words"), "asked")
        return marked.filter("NOT _known").drop("_known"), marked.filter("_known").drop("_known")

    def add(self, batch: DataFrame, batch_id: str) -> int:
        """Archives the rows of a batch whose key isn't there yet, one of each key; returns how many. Batch ids must rise."""
        runs = self.store.runs()
        if batch_id in runs:
            return 0
        if runs and batch_id < runs[-1]:
            raise ValueError(f"batch {batch_id} comes after {runs[-1]}")
        new, asked = self.split(batch.select(*self.schema.names))
        hits = matched(self.rows().select(*self.key).withColumn("_tag", key_tag(self.key)).select("_tag"), asked.select("_tag"), ["_tag"], "left_semi")
        added = materialise(new.unionByName(matched(asked, hits.distinct(), ["_tag"], "left_anti")), "added")
        both = self._filter().unionByName(self._filter_of(added))
        merged = both.groupBy("bucket").agg(F.collect_list("words").alias("w")).select("bucket", F.expr("aggregate(slice(w, 2, size(w)), w[0], (x, y) -> zip_with(x, y, (a, b) -> a | b))").alias("words"))   # two at most
        self.store.write({"rows": added.drop("_tag").select(*self.schema.names), "filter": merged}, batch_id)
        return self.store.manifest(batch_id)["tables"]["rows"]["rows"]
