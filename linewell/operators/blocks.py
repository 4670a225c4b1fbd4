"""Running sums and carried values over long ordered keys: blocks are solved apart and then chained."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(d: DataFrame, keys: list[str], block: str, order: list[str], cols: dict[str, str], source: DataFrame | None = None) -> DataFrame:
    """Adds, per entry (name, column) of ``cols``, the sum of the column over all rows of the key before the row.

    ``block`` must not contradict ``order``. A key with very many rows is spread over its blocks; only one row per block
    meets in a task to be chained. ``source`` has the same rows where ``d`` is costly: the blocks are summed from it.
    """
    before = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chain = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = (d if source is None else source).groupBy(*keys, block).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in cols.items()])
    heads = totals.select(*keys, block, *[F.coalesce(F.sum(f"_t_{n}").over(chain), F.lit(0)).alias(f"_h_{n}") for n in cols])
    inner = d.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in cols.items()})
    return inner.join(heads, [*keys, block]).withColumns({n: F.col(n) + F.col(f"_h_{n}") for n in cols}).drop(*[f"_h_{n}" for n in cols])


def carried(d: DataFrame, keys: list[str], block: str, order: list[str], col: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: the last value of ``col`` that isn't null among the rows of the key before the row, null if there is none.

    ``source`` has the same rows where ``d`` is costly: the ends of the blocks are taken from it.
    """
    source = d if source is None else source
    before = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chain = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = source.filter(F.col(col).isNotNull()).groupBy(*keys, block).agg(F.max_by(col, F.struct(*order)).alias("_end"))
    blocks = source.select(*keys, block).distinct().join(ends, [*keys, block], "left")
    heads = blocks.select(*keys, block, F.last("_end", ignorenulls=True).over(chain).alias("_head"))
    inner = d.withColumn(name, F.last(col, ignorenulls=True).over(before))
    return inner.join(heads, [*keys, block]).withColumn(name, F.coalesce(name, "_head")).drop("_head")
