"""Positions in a global order, without a window over the whole table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions.joins import materialise

ROW_BITS = 33  # monotonically_increasing_id: partition above, row inside the partition below


def with_positions(df: DataFrame, order: list[Column], name: str = "position", spread_ties: bool = True) -> DataFrame:
    """All rows with their 0-based position in the order ``order``, in a column ``name`` that ``df`` doesn't have.

    The rows are dealt into ranges by sampled bounds and sorted inside each; what is written once then holds the range and the
    rank inside it, and the rows before a range are a running sum over one count per range. Rows that tie in ``order`` take
    neighbouring positions in an order that is fixed once written; with ``spread_ties`` they may lie in several ranges, so that
    a key of very many equal rows isn't one task's. An empty table gives no rows.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name} already")
    mid, tie = f"{name}_range", f"{name}_tie"
    keyed, by = (df.withColumn(tie, F.rand(1)), [*order, F.col(tie).asc()]) if spread_ties else (df, order)
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(tie)
    kept = materialise(ranged.withColumn(mid, F.monotonically_increasing_id()), "ordered")
    of_range = F.shiftright(mid, ROW_BITS)
    starts = (kept.groupBy(of_range.alias("range")).agg(F.count(F.lit(1)).alias("rows"))
              .select("range", (F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before")))
    # one row per range: at most as many as the shuffle has partitions
    return (kept.join(F.broadcast(starts), of_range == F.col("range"))
            .select(*df.columns, (F.col("before") + F.col(mid).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias(name)))
