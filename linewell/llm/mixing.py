"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has the same expected number of copies, its source's target over its size. In a
fixed order of the source, the running sum of expected copies plus one random offset crosses integers; a
document is emitted once for each integer that its own step crosses. The order goes by size class first, so
long and short documents are taken in proportion and the taken words follow the target closely.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions.joins import BROADCAST_BYTES, materialise, planned_bytes

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS = 5000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(no_source, source, source_size, target) per source.

    Sources in code point order, null last, take the weights in turn. A share above ``most`` times its source
    stops there and the excess goes to the others by weight. In order of cap over weight that needs one running
    sum: a source is capped while its cap is no more than its share of what the sources before it leave.
    """
    step = math.lcm(*weights)
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(Window.orderBy("no_source", "source")) - 1) % len(weights) + 1).cast("int"))
    per_source = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")).withColumn("w", turn).withColumn("cap", F.col("source_size") * most)
    everything, before = Window.partitionBy(), Window.orderBy((F.col("cap") * step / F.col("w")).cast("long"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    led = per_source.select(
        "*", F.sum("source_size").over(everything).alias("total"), F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    led = led.withColumn("capped", F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("total") - F.col("cap_before")))
    free = (F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)) * F.col("w")
    shared = F.col("all_w") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(everything)
    return led.select("no_source", "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free.cast("double") / shared.cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken.

    size counts words (null and empty texts: 0); null sources form a source of their own. The order within a
    source is size class, block (md5 of the id), size, id; ranks come from counts per block and a rank inside the
    block, so no task holds a source. A source of size 0 has target 0 and copies 0. Repeated rows are
    documents of their own; null ids come last in their block. An empty table gives no rows. Only the three
    named columns are read.
    """
    sizes = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                                    word_count(F.col(text_col)).alias("size")), "sizes")
    blocks = max(1, -(-sizes.count() // block_rows))
    keys = ["no_source", "source", "class", "block"]
    rows = sizes.select("*", F.length(F.bin("size")).alias("class"), F.coalesce(F.pmod(hex_number(F.col("doc_id").cast("string"), 8), F.lit(blocks)), F.lit(0)).alias("block"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.groupBy("no_source", "source", "class").agg(F.sum("n").alias("n"))
    of_class = classes.select("no_source", "source", "class", (F.sum("n").over(Window.partitionBy("no_source", "source").orderBy("class")) - F.col("n")).alias("class_before"))
    starts = (counts.select(*keys, (F.sum("n").over(Window.partitionBy("no_source", "source", "class").orderBy("block")) - F.col("n")).alias("block_before"))
              .join(of_class, ["no_source", "source", "class"]).join(targets(sizes, weights, most), ["no_source", "source"]))
    inside = Window.partitionBy(*keys).orderBy("size", F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(starts, keys).withColumn("rank", F.col("rank") + F.col("class_before") + F.col("block_before"))
    offset = hex_number(F.concat(F.lit(seed), F.col("source")), 3) / F.lit(4096.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(F.col("rank") * rate + offset) - F.floor((F.col("rank") - 1) * rate + offset)
    return ranked.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Every document as often as the mix takes it, with all its columns and the number of the copy in ``copy`` (``copy_`` where
    that name is taken). Rows that share an id, or have none, each take the largest number of copies among them."""
    taken = materialise(mix(docs, id_col, text_col, source_col, **options).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")), "mix")
    name = "copy"
    while name in docs.columns:
        name += "_"
    left, right = docs.select(F.struct("*").alias("row")), taken.select(F.col("doc_id").alias("mix_id"), "copies")
    if planned_bytes(taken) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, F.col("row")[id_col].eqNullSafe(F.col("mix_id"))).select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(name))


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
nb AS (SELECT greatest(1, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) AS blocks FROM t),
s AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM t GROUP BY ALL),
sw AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY no_source, source) - 1) % 3]::BIGINT AS w, 3 * source_size AS cap FROM s),
led AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM sw WINDOW b AS (ORDER BY cap * 10 // w, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * (all_w - w_before) <= w * (total - cap_before) AS capped FROM led),
goal AS (SELECT no_source, source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
  ((total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w)::DOUBLE / (all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())::DOUBLE END AS target FROM marked),
r AS (SELECT t.*, row_number() OVER (PARTITION BY no_source, source ORDER BY length(bin(size)),
  coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % (SELECT blocks FROM nb), 0), size, doc_id NULLS LAST) AS rank FROM t),
c AS (SELECT r.doc_id, r.size, g.source_size, g.target, r.rank, CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
  ('0x' || substr(md5('{SEED}' || r.source), 1, 3))::BIGINT::DOUBLE / 4096.0::DOUBLE AS off FROM r JOIN goal g USING (no_source, source)),
k AS (SELECT *, (floor(rank::DOUBLE * rate + off) - floor((rank - 1)::DOUBLE * rate + off))::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM k
"""
