"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one per partition and then added up, name the digests that may hold more than
``1 / limit`` of all rows. Their exact counts are taken once; the winners (at most ``limit`` rows, whatever
the input) are broadcast, so that the rows of very large groups are decided map-side and never meet in
one task. All other digests, each below that share, go through an ordinary aggregate and join.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.joins import materialise
from linewell.llm.common import without

SPACES = r"[\x20\x09-\x0D]+"
LIMIT = 1000


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def shrink(counts: dict, size: int) -> dict:
    """Misra-Gries: subtracts the (size + 1)-th largest count from all and keeps what is left above zero."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return {k: v - cut for k, v in counts.items() if v > cut}


def summaries(digests: DataFrame, size: int) -> DataFrame:
    """Per partition at most ``size`` digests with lower bounds of their counts, short by n / (size + 1) at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            found = pc.value_counts(b.column(0))
            for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                counts[key] = counts.get(key, 0) + n
            if len(counts) > 4 * size:
                counts = shrink(counts, size)
        counts = shrink(counts, size)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    return digests.select("digest").mapInArrow(run, "digest binary, n long")


def heavy_hitters(digests: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(digest, keep_id, group_size) of every digest with more than 1 / limit of all rows: below ``limit`` rows.

    Each summary has 2 * limit counters, so a true heavy hitter keeps a sum of n / (2 * limit) at least, which
    at most 2 * limit digests can have: both broadcasts are bounded by the parameter alone.
    """
    n = digests.count()
    likely = (summaries(digests, 2 * limit).groupBy("digest").agg(F.sum("n").alias("n"))
              .filter(F.col("n") * F.lit(2 * limit) >= F.lit(n)).select("digest"))
    return (digests.join(F.broadcast(likely), "digest").groupBy("digest")
            .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .filter((F.col("group_size") > 1) & (F.col("group_size") * F.lit(limit) > F.lit(n))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space runs become one space. Null text: the empty text. The
    smallest id of a group stays; rows that repeat an id and text count each in group_size and share one
    answer. Null ids lose against any id; in a group without ids all rows stay. Empty table: no rows. Other
    columns of ``docs`` aren't read, so their names can't clash.
    """
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")), "digests")
    heavy = materialise(heavy_hitters(digests, limit), "heavy")
    hot = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return hot.unionByName(rest.join(groups, "digest")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Rows without an id, and rows that repeat an id and text, stay."""
    return without(docs, materialise(exact_dedup(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(id_col)), "copies"), id_col)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
