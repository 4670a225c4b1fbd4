"""Latest quotes, contemporaneous two-sided pairs and feed summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions import prices, times
from linewell.operators.validity import MARKETS, MICROS_PER_MINUTE, rejected_quotes, valid_quotes

PAIR_GAP_MINUTES = 5.0      # fixed value: sides quoted further apart are not contemporaneous
FIRST_SIDES = ("home", "over")


def _rank() -> Column:
    """Newest first; ties by price, then by event id."""
    return F.struct("odds_time_utc", "price", "event_id")


def latest_quotes(valid: DataFrame) -> DataFrame:
    """The latest quote per (game, book, market, side, point); a null point is a group of its own."""
    return (valid.groupBy("game_id", "book", "market", "side", "point")
            .agg(F.max(_rank()).alias("q"))
            .select("game_id", "book", "market", "side", "point", "q.price", "q.odds_time_utc", "q.event_id"))


def quote_cells(valid: DataFrame) -> DataFrame:
    """Latest quote of both sides per (game, market, book, line): structs a (home / over) and b, null if unseen.

    The latest quote of each side and the matching of the sides are one grouped aggregation over the
    home/over line of the quote: no self join, and a hot game is combined on the map side.
    """
    first = F.col("side").isin(*FIRST_SIDES)
    line = (F.when(F.col("market") == "ml", F.lit(None))
            .when((F.col("market") == "spread") & first, 0.0 - F.col("point"))
            .otherwise(0.0 + F.col("point")))
    return (valid.withColumn("line", line).groupBy("game_id", "market", "book", "line")
            .agg(F.max(F.when(first, _rank())).alias("a"), F.max(F.when(~first, _rank())).alias("b")))


def pairs_of(cells: DataFrame, gap_minutes: float = PAIR_GAP_MINUTES) -> DataFrame:
    """Two-sided no-vig quotes of cells whose sides are at most ``gap_minutes`` apart.

    Output: line (null for ml), p (first side, no vig), overround, newest, oldest, both sides' facts.
    """
    ta, tb = F.col("a.odds_time_utc"), F.col("b.odds_time_utc")
    ia, ib = prices.implied(F.col("a.price")), prices.implied(F.col("b.price"))
    near = F.abs(F.unix_micros(ta) - F.unix_micros(tb)) <= int(gap_minutes * MICROS_PER_MINUTE)
    return (cells.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & near)
            .select("game_id", "market", "book", "line", (ia / (ia + ib)).alias("p"), (ia + ib - 1).alias("overround"),
                    F.greatest(ta, tb).alias("newest"), F.least(ta, tb).alias("oldest"),
                    F.col("a.price").alias("first_price"), F.col("b.price").alias("second_price"),
                    ta.alias("first_time"), tb.alias("second_time")))


def quote_pairs(valid: DataFrame, gap_minutes: float = PAIR_GAP_MINUTES) -> DataFrame:
    return pairs_of(quote_cells(valid), gap_minutes)


def reference_ready(valid: DataFrame, min_books: int) -> DataFrame:
    """Games per market where every book has ``min_books`` other books with a pair."""
    books = quote_pairs(valid).groupBy("game_id", "market").agg(F.count_distinct("book").alias("books"))
    ready = books.filter(F.col("books") >= min_books + 1).groupBy("market").agg(F.count("*").alias("games"))
    dim = valid.sparkSession.createDataFrame([(m,) for m in MARKETS], "market string")
    return dim.join(ready, "market", "left").select("market", F.coalesce("games", F.lit(0)).alias("games"))


def feed_summary(checked: DataFrame, now: Column) -> DataFrame:
    """One row of feed statistics.

    Ages have a whole-second resolution and lie within the allowed age, so the exact median works on
    at most one counter per second of that range, whatever the number of quotes.
    """
    age = (F.unix_seconds(now) - F.unix_seconds("odds_time_utc")) / 60.0
    v = valid_quotes(checked).withColumn("age", age)
    counts = v.groupBy("age").agg(F.count("*").alias("n"))
    ages = counts.agg(F.sum("n").alias("valid_quotes"), F.min("age").alias("age_min"),
                      F.expr("percentile(age, 0.5, n)").alias("age_median"), F.max("age").alias("age_max"))
    sets = v.agg(F.count_distinct("book").alias("books"), F.count_distinct("game_id").alias("games_with_quotes"))
    bad = rejected_quotes(checked).agg(F.count("*").alias("rejected_quotes"))
    one = F.lit(1)
    return (ages.withColumn("k", one).join(sets.withColumn("k", one), "k").join(bad.withColumn("k", one), "k")
            .select(F.coalesce("valid_quotes", F.lit(0)).alias("valid_quotes"), "rejected_quotes", "books",
                    "games_with_quotes", "age_min", "age_median", "age_max"))


def quote_keys(valid: DataFrame) -> DataFrame:
    return valid.select("game_id", "book", "market", "side", "point", "price", "odds_time").distinct()


def expired_quotes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Quote keys valid before and not any more (set difference, null points match)."""
    return quote_keys(before).subtract(quote_keys(after))


def collection_summary(checked: DataFrame, slate: DataFrame, injuries: DataFrame) -> DataFrame:
    """A collection run without any model: per game, quotes kept and refused and injury rows of its teams."""
    q = checked.groupBy("game_id").agg(
        F.count_if(F.col("reject_reason") == "").alias("valid_quotes"),
        F.count_if(F.col("reject_reason") != "").alias("rejected_quotes"),
        F.max(F.when(F.col("reject_reason") == "", times.iso(F.col("odds_time_utc")))).alias("newest_quote"))
    sides = slate.select("game_id", "league", "season", "week", F.explode(F.array("home_team", "away_team")).alias("team"))
    n = injuries.groupBy("league", "season", "week", "team").agg(F.count("*").alias("n"))
    inj = sides.join(n, ["league", "season", "week", "team"], "left").groupBy("game_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("injury_rows"))
    return (slate.select("game_id").join(q, "game_id", "left").join(inj, "game_id", "left")
            .select("game_id", F.coalesce("valid_quotes", F.lit(0)).alias("valid_quotes"),
                    F.coalesce("rejected_quotes", F.lit(0)).alias("rejected_quotes"), "newest_quote", "injury_rows"))
