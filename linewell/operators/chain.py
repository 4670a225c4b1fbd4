"""Hash-chained logs: sealing per log key and auditing."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64      # fixed value: the link before the first record
SEALED = T.StructType([T.StructField(n, t) for n, t in (
    ("log_id", T.StringType()), ("seq", T.LongType()), ("recorded_utc", T.StringType()), ("kind", T.StringType()),
    ("body", T.StringType()), ("prev", T.StringType()), ("hash", T.StringType()))])


def canonical(seq: Column, recorded: Column, kind: Column, body: Column, prev: Column) -> Column:
    """The text that is hashed: fields joined by a unit separator."""
    return F.concat_ws("\x1f", seq.cast("string"), recorded, kind, F.coalesce(body, F.lit("")), prev)


def seal(rows: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Chains new records of each log in ``order`` onto that log's last hash.

    rows: log_id, ord, recorded_utc, kind, body. tails (optional): log_id, seq, hash of the last record.
    A chain is serial by nature; a log is streamed through its task in Arrow batches of bounded bytes with one hash as
    state, so memory stays flat however long the log and its rows are, and logs run in parallel.
    """
    null = F.lit(None)
    if tails is None:
        rows = rows.withColumns({"tail_seq": null.cast("bigint"), "tail_hash": null.cast("string")})
    else:
        rows = rows.join(tails.select("log_id", F.col("seq").alias("tail_seq"), F.col("hash").alias("tail_hash")), "log_id", "left")
    ordered = rows.repartition("log_id").sortWithinPartitions("log_id", "ord").select("log_id", "recorded_utc", "kind", "body", "tail_seq", "tail_hash")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, prev, seq = object(), GENESIS, 0
        for batch in batches:
            chained = []
            for own, recorded, kind, body, tail_seq, tail in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if own != log:
                    log, (prev, seq) = own, (GENESIS, 0) if tail is None else (tail, tail_seq + 1)
                digest = hashlib.sha256("\x1f".join((str(seq), recorded, kind, body or "", prev)).encode()).hexdigest()
                chained.append((seq, prev, digest))
                prev, seq = digest, seq + 1
            seqs, prevs, digests = zip(*chained) if chained else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.int64()), *(batch.column(k) for k in (1, 2, 3)),
                                              pa.array(prevs, pa.string()), pa.array(digests, pa.string())], SEALED.names)
    return ordered.mapInArrow(fold, SEALED)


def audit(log: DataFrame, position: str = "pos", verified: DataFrame | None = None) -> DataFrame:
    """One row per log: records, whether the chain is intact, first bad position and why.

    log: log_id, pos (stored order), seq, recorded_utc, kind, body, prev, hash. Each record is compared
    with its predecessor through an equi join on (log, position - 1), so a long log is spread over
    many tasks instead of being sorted in one. ``verified`` (log_id, pos, hash) holds the last record of what was
    verified before and isn't among the rows.
    """
    before = log.select("log_id", position, "hash")
    if verified is not None:
        before = before.unionByName(verified.select("log_id", F.col("pos").alias(position), "hash"))
    before = before.select("log_id", (F.col(position) + 1).alias(position), F.col("hash").alias("_before"))
    d = log.join(before, ["log_id", position], "left")
    expect = F.when(F.col(position) == 0, F.lit(GENESIS)).otherwise(F.col("_before"))
    digest = F.sha2(canonical(F.col("seq"), F.col("recorded_utc"), F.col("kind"), F.col("body"), F.col("prev")), 256)
    problem = (F.when(~F.col("seq").eqNullSafe(F.col(position)), "sequence out of order")
               .when(~F.col("prev").eqNullSafe(expect), "previous-hash link broken")
               .when(~F.col("hash").eqNullSafe(digest), "content does not match its hash"))
    d = d.withColumn("problem", problem)
    bad = F.when(F.col("problem").isNotNull(), F.col(position))
    return d.groupBy("log_id").agg(F.count("*").alias("records"), (F.count(bad) == 0).alias("intact"),
                                   F.min(bad).alias("first_bad"), F.min_by("problem", bad).alias("problem"))


def append(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Seals rows onto an existing log; logs whose chain is broken are refused (their rows do not pass)."""
    good = audit(log).filter("intact")
    tails = log.groupBy("log_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    broken = audit(log).filter("not intact").select("log_id")
    return seal(rows.join(broken, "log_id", "left_anti"), tails.join(good.select("log_id"), "log_id"))
