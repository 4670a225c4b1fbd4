"""Leave-one-book-out market references by order statistics.

The reference of (game, market) without book B is built from medians over the other books.  Listing
all (excluded book, other book) combinations would grow with the square of the books; instead each
row's rank within its group says which two order statistics remain the middle ones once that row is
gone, so every leave-one-out value is read from a constant number of window values.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions import stats, times, udfs
from linewell.functions.joins import materialise

GROUP = ["game_id", "market"]


def _order_stats(d: DataFrame, keys: list[str], value: str, parts: tuple[str, ...]) -> DataFrame:
    """Adds ``{value}_{part}`` (whole group) and ``{value}_{part}_loo`` (group without this row)."""
    ranked = Window.partitionBy(*keys).orderBy(F.col(value), F.col("book"))
    whole = Window.partitionBy(*keys)
    d = d.withColumn("_i", F.row_number().over(ranked) - 1)
    i, n = F.col("_i"), F.count(F.lit(1)).over(whole)

    def at(k: Column) -> Column:
        return F.max(F.when(i == F.col(k) if isinstance(k, str) else i == k, F.col(value))).over(whole)

    d = d.withColumn("_n", n)
    for name, pos in (("_a", (F.col("_n") - 2) / 2), ("_b", (F.col("_n") - 1) / 2), ("_c", F.col("_n") / 2)):
        d = d.withColumn(name, F.floor(pos))
    out = {}
    a, b = F.col("_a"), F.col("_b")
    if "median" in parts:
        out[f"{value}_median"] = (at("_b") + at("_c")) / 2
        lo = F.when(i <= a, at(a + 1)).otherwise(at("_a"))
        hi = F.when(i <= b, at(b + 1)).otherwise(at("_b"))
        out[f"{value}_median_loo"] = (lo + hi) / 2
    if "min" in parts:
        out[f"{value}_min"] = at(F.lit(0))
        out[f"{value}_min_loo"] = F.when(i == 0, at(F.lit(1))).otherwise(at(F.lit(0)))
    if "max" in parts:
        out[f"{value}_max"] = at(F.col("_n") - 1)
        out[f"{value}_max_loo"] = F.when(i == F.col("_n") - 1, at(F.col("_n") - 2)).otherwise(at(F.col("_n") - 1))
    return d.withColumns(out).drop("_i", "_n", "_a", "_b", "_c")


def exclusions(pairs: DataFrame, quoted: DataFrame | None = None) -> DataFrame:
    """One row per (game, market, excluded book or null): books left and the median line left.

    Removing book B's k lines from the sorted lines moves the r-th remaining line to position
    r + #{B's lines at or before it}; ``shift`` holds position minus own index for B's lines.
    """
    by_line = Window.partitionBy(*GROUP).orderBy("line", "book")
    by_book = Window.partitionBy(*GROUP, "book").orderBy("line")
    ranked = (pairs.select(*GROUP, "book", "line")
              .withColumn("pos", F.row_number().over(by_line) - 1)
              .withColumn("idx", F.row_number().over(by_book) - 1)
              .withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*GROUP))))
    own = (ranked.groupBy(*GROUP, "book").agg(F.max("total").alias("total"), F.count("*").alias("k"),
                                               F.collect_list(F.col("pos") - F.col("idx")).alias("shift")))
    # books that quote the market but have no pair have nothing of theirs to leave out
    d = own if quoted is None else quoted.select(*GROUP, "book").distinct().join(own, [*GROUP, "book"], "left")
    group = Window.partitionBy(*GROUP)
    none = F.array().cast("array<int>")
    d = d.select(*GROUP, "book", F.max("total").over(group).alias("total"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("shift", none).alias("shift"),
                 F.array_sort(F.collect_set(F.when(F.col("k") > 0, F.col("book"))).over(group)).alias("all_books"),
                 (F.row_number().over(group.orderBy("book")) == 1).alias("_first")).filter("total is not null")
    # every book answers for its own exclusion, the first book of a group also for the full reference
    mine = F.struct(F.col("book"), F.col("k"), F.col("shift"), (F.col("k") > 0).alias("own"))
    full = F.struct(F.lit(None).cast("string").alias("book"), F.lit(0).cast("bigint").alias("k"), none.alias("shift"), F.lit(False).alias("own"))
    ex = d.select(*GROUP, "total", "all_books", F.inline(F.when(F.col("_first"), F.array(mine, full)).otherwise(F.array(mine))))
    lo, hi = F.floor((F.col("total") - F.col("k") - 1) / 2), F.floor((F.col("total") - F.col("k")) / 2)
    ex = ex.withColumn("lo", lo).withColumn("hi", hi)
    moved = [(F.col(c) + F.size(F.filter("shift", lambda s: s <= F.col(c)))).cast("int") for c in ("lo", "hi")]
    ex = (ex.withColumn("pos", F.explode(F.array(*moved)))
          .join(ranked.select(*GROUP, "pos", "line"), [*GROUP, "pos"], "left")
          .groupBy(*GROUP, F.col("book").alias("excluded"), "own")
          .agg(F.avg("line").alias("med"), F.first("all_books").alias("all_books")))
    books = F.when(F.col("own"), F.array_remove("all_books", F.col("excluded"))).otherwise(F.col("all_books"))
    return ex.select(*GROUP, "excluded", "own", F.coalesce("med", F.lit(0.0)).alias("med"),
                     F.size(books).cast("bigint").alias("n_books"), F.array_join(books, ",").alias("books"))


def chosen_pairs(pairs: DataFrame, ex: DataFrame) -> DataFrame:
    """Per (game, market, median line) and book: the pair nearest that median (earliest first side on ties).

    Leaving one book out moves the median by a few ranks, so a market has few distinct medians.
    """
    meds = ex.select(*GROUP, "med").distinct()
    near = F.struct(F.abs(F.col("line") - F.col("med")).alias("d"), "first_time", F.col("line").alias("l"))
    body = F.struct(*[c for c in pairs.columns if c not in (*GROUP, "book")])
    return (pairs.join(meds, GROUP).withColumn("near", near)
            .groupBy(*GROUP, "med", "book").agg(F.min_by(body, "near").alias("c")).select(*GROUP, "med", "book", "c.*"))


def build_references(pairs: DataFrame, min_books: int, quoted: DataFrame | None = None) -> DataFrame:
    """References per (game, market, excluded book or null).

    ``pairs`` as from ``quote_pairs``; with a ``mu`` column (see ``with_implied_mean``) spreads and
    totals also get the median implied mean.  Markets with fewer than ``min_books`` books left give no row.
    """
    has_mu = "mu" in pairs.columns
    p = pairs if has_mu else pairs.withColumn("mu", F.lit(None).cast("double"))
    p = materialise(p, "pairs")     # a few rows per market from many quotes, read several times below
    ex = materialise(exclusions(p, quoted).filter(F.col("n_books") >= min_books), "exclusions")
    c = chosen_pairs(p, ex)
    is_ml = F.col("market") == "ml"
    c = c.withColumn("x", F.when(is_ml, F.log(F.col("p") / (1 - F.col("p")))).otherwise(F.col("mu")))
    keys = [*GROUP, "med"]
    c = c.select(*keys, "book", "x", "line", F.unix_micros("oldest").alias("old"), F.unix_micros("newest").alias("new"))
    for value, parts in (("x", ("median", "min", "max")), ("line", ("median",)), ("old", ("min",)), ("new", ("max",))):
        c = _order_stats(c, keys, value, parts)
    names = ["x_median", "x_min", "x_max", "line_median", "old_min", "new_max"]
    # each chosen pair answers for its own book's exclusion; one row per group answers for the rest
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("book")) == 1
    own = F.struct(F.col("book").alias("_who"), *[F.col(f"{n}_loo").alias(n) for n in names])
    whole = F.struct(F.lit("").alias("_who"), *[F.col(n) for n in names])
    answers = (c.withColumn("_first", first)
               .select(*keys, F.inline(F.when(F.col("_first"), F.array(own, whole)).otherwise(F.array(own)))))
    ex = ex.withColumn("_who", F.when(F.col("own"), F.col("excluded")).otherwise(F.lit("")))
    r = ex.join(answers, [*keys, "_who"])
    return r.select(
        *GROUP, "excluded", "n_books", "books",
        F.when(~is_ml, F.rint(F.col("line_median") * 2) / 2).alias("line"),
        F.when(~is_ml, F.col("x_median")).alias("mu"),
        F.when(is_ml, stats.sigmoid(F.col("x_median"))).alias("p"),
        F.when(is_ml, stats.sigmoid(F.col("x_max")) - stats.sigmoid(F.col("x_min")))
         .otherwise(F.col("x_max") - F.col("x_min")).alias("spread_of_books"),
        F.timestamp_micros(F.col("old_min").cast("bigint")).alias("oldest"),
        F.timestamp_micros(F.col("new_max").cast("bigint")).alias("newest"))


def flat_distributions(d: DataFrame, margin_sd: float = 13.0, total_sd: float = 13.5) -> DataFrame:
    """Outcome distribution columns without key-number weights (normal mass on the integers)."""
    total = F.col("market") == "total"
    size = F.when(total, stats.TOTAL_HI - stats.TOTAL_LO + 1).otherwise(stats.MARGIN_HI - stats.MARGIN_LO + 1)
    return (d.withColumn("sd", F.when(total, total_sd).otherwise(margin_sd))
            .withColumn("weights", F.array_repeat(F.lit(1.0), size.cast("int"))))


def with_implied_mean(pairs: DataFrame) -> DataFrame:
    """Adds ``mu``: the mean outcome at which the pair's line has the pair's probability."""
    return pairs.withColumn("mu", udfs.implied_mean("line", "p", "sd", "weights", F.col("market") == "total"))


def with_line_probability(refs: DataFrame) -> DataFrame:
    """Fills ``p`` of spreads and totals: the reference's probability at its own line."""
    o = udfs.over_push("mu", "line", "sd", "weights", F.col("market") == "total")
    return refs.withColumn("p", F.coalesce("p", o["cond"]))


def provenance(pairs: DataFrame, ex: DataFrame) -> DataFrame:
    """JSON record of the quotes behind each reference (keys in alphabetical order).

    The output lists every contributing book once per reference, so it is as large as what it reports.
    """
    def text(t):
        return times.iso(F.col(t))
    first = F.when(F.col("market") == "total", "over").otherwise("home")
    second = F.when(F.col("market") == "total", "under").otherwise("away")
    at = F.col("line")
    quote = F.struct(F.col("book"), F.col("line"), F.array(
        F.struct(F.when(F.col("market") == "spread", -at).otherwise(at).alias("point"), F.col("first_price").alias("price"),
                 first.alias("side"), text("first_time").alias("time_utc")),
        F.struct(at.alias("point"), F.col("second_price").alias("price"), second.alias("side"),
                 text("second_time").alias("time_utc"))).alias("sides"))
    c = chosen_pairs(pairs, ex).withColumn("quote", quote)
    by_med = c.groupBy(*GROUP, "med").agg(F.array_sort(F.collect_list("quote")).alias("quotes"))
    kept = F.when(F.col("own"), F.filter("quotes", lambda q: q["book"] != F.col("excluded"))).otherwise(F.col("quotes"))
    doc = F.struct(F.split("books", ",").alias("books"), F.col("excluded").alias("excluded_book"), F.col("market"), kept.alias("quotes"))
    return (ex.join(by_med, [*GROUP, "med"])
            .select(*GROUP, "excluded", F.to_json(doc).alias("provenance")))


def attach_reference(offers: DataFrame, refs: DataFrame, quoted_key: str = "book") -> DataFrame:
    """Each offer with the reference built without its own book (columns prefixed ``ref_``), null if none."""
    r = refs.filter(F.col("excluded").isNotNull()).select(
        *GROUP, F.col("excluded").alias(quoted_key),
        *[F.col(c).alias(f"ref_{c}") for c in refs.columns if c not in (*GROUP, "excluded")])
    return offers.join(r, [*GROUP, quoted_key], "left")


def live_lines(games: DataFrame, refs: DataFrame) -> DataFrame:
    """Schedule lines replaced by the full reference's line where one exists; ``reference_kind`` says which."""
    full = refs.filter(F.col("excluded").isNull())
    wide = full.groupBy("game_id").agg(F.max(F.when(F.col("market") == "spread", F.col("line"))).alias("live_spread"),
                                       F.max(F.when(F.col("market") == "total", F.col("line"))).alias("live_total"))
    return (games.join(wide.withColumn("live", F.lit(True)), "game_id", "left")
            .withColumn("spread_line", F.coalesce("live_spread", "spread_line"))
            .withColumn("total_line", F.coalesce("live_total", "total_line"))
            .withColumn("reference_kind", F.when(F.col("live"), "live bookmaker quotes").otherwise("schedule consensus (untimed)"))
            .drop("live_spread", "live_total", "live"))
