"""Quote streams: validation on arrival, pairing, window statistics, archive."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewell.functions import times
from linewell.operators import quotes, validity
from linewell.sources import views
from linewell.streaming.sinks import new_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, name: str = "offers", files_per_trigger: int = 1) -> DataFrame:
    """A domain table that derives from ``events`` row by row, as a stream over the event files."""
    src = (spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))
    src.createOrReplaceTempView("events")
    out = spark.sql(f"{views.with_clause([name], views.SPARK)}\nSELECT * FROM {name}")
    spark.catalog.dropTempView("events")
    return out


def validate(stream: DataFrame, kickoffs: DataFrame, now: Column, settings) -> DataFrame:
    """Quotes with their reject reason as they arrive; future and stale quotes are rejected explicitly."""
    return validity.check_quotes(stream, kickoffs, now, settings)


def split_sinks(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs a validated stream into a valid and a rejected table in one pass over each micro-batch."""
    spark = checked.sparkSession
    good, bad, check = (new_folder(spark, f"quotes-{n}") for n in ("valid", "rejected", "checkpoint"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        validity.valid_quotes(batch).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        validity.rejected_quotes(batch).write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        batch.unpersist()
    q = checked.writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    valid_schema = T.StructType([f for f in checked.schema if f.name != "reject_reason"])
    return spark.read.schema(valid_schema).parquet(f"{good}/batch=*"), spark.read.schema(checked.schema).parquet(f"{bad}/batch=*")


# ---------------------------------------------------------------- two-sided pairs

PAIR_KEY = ["game_id", "market", "book", "line_key"]


def pair_matches(valid: DataFrame, gap_minutes: float = quotes.PAIR_GAP_MINUTES, late_minutes: float = 32.0) -> DataFrame:
    """First and second sides of a line that were quoted within the gap, and sides without a match, as a stream joined with itself.

    Both inputs have a watermark and the join an interval, so a quote leaves the state once the watermark is a gap past it; a side without a
    match comes out then. Quotes that are more than ``late_minutes`` behind the newest one at their arrival are dropped: valid quotes never are, their age is checked.
    (A row at the watermark counts as late, so the watermark stays a millisecond more behind.)
    """
    first = F.col("side").isin(*quotes.FIRST_SIDES)
    line = (F.when(F.col("market") == "ml", F.lit("-")).when((F.col("market") == "spread") & first, (0.0 - F.col("point")).cast("string"))
            .otherwise((0.0 + F.col("point")).cast("string")))
    d = valid.select("game_id", "market", "book", line.alias("line_key"), "side", "odds_time_utc", "price", "event_id").withWatermark("odds_time_utc", f"{late_minutes:g} minutes 1 millisecond")
    quote = F.struct(F.col("odds_time_utc").alias("t"), "price", F.col("event_id").alias("id"))
    # rows without a side only move the watermark; they have no key, so they match nothing
    a, b = (d.filter(F.coalesce(own, F.lit(True))).select(*[F.col(k).alias(f"{s}_{k}") for k in PAIR_KEY], F.col("odds_time_utc").alias(f"{s}_time"), quote.alias(s)) for s, own in (("a", first), ("b", ~first)))
    gap = F.expr(f"INTERVAL '{gap_minutes * 60:.6f}' SECOND")
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in PAIR_KEY] + [F.col("a_time") >= F.col("b_time") - gap, F.col("a_time") <= F.col("b_time") + gap]
    j = a.join(b, on, "full_outer")
    return j.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in PAIR_KEY], "a", "b")


def current_pairs(matches: DataFrame, gap_minutes: float = quotes.PAIR_GAP_MINUTES) -> DataFrame:
    """Pairs that stand after all matches: the newest quotes of both sides, if they lie within the gap."""
    d = matches.filter(F.col("game_id").isNotNull()).groupBy(*PAIR_KEY).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    d = d.filter(F.abs(F.unix_micros("a.t") - F.unix_micros("b.t")) <= int(gap_minutes * validity.MICROS_PER_MINUTE))
    return d.select("game_id", "market", "book", F.when(F.col("line_key") != "-", F.col("line_key").cast("double")).alias("line"), F.col("a.t").alias("first_time"), F.col("a.price").alias("first_price"),
                    F.col("b.t").alias("second_time"), F.col("b.price").alias("second_price"))


# ---------------------------------------------------------------- windows and archive

def quote_windows(valid: DataFrame, kind: str = "tumbling", late_minutes: float = 30.0) -> DataFrame:
    """Quotes, books and price range per market and time window (tumbling, sliding or session).

    Books are a short list of names, so the distinct count keeps a small set per window.
    """
    w = {"tumbling": F.window("odds_time_utc", "5 minutes"), "sliding": F.window("odds_time_utc", "10 minutes", "5 minutes"),
         "session": F.session_window("odds_time_utc", "5 seconds")}[kind]
    d = valid.withWatermark("odds_time_utc", f"{late_minutes:g} minutes")
    g = d.groupBy(w.alias("w"), "market").agg(F.count("*").alias("quotes"), F.size(F.collect_set("book")).cast("bigint").alias("books"),
                                              F.min("price").alias("low"), F.max("price").alias("high"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "market", F.col("quotes"), "books", "low", "high")


def archive_once(stream: DataFrame, key: list[str], event_time: str, within: str = "1 day") -> DataFrame:
    """Rows of a stream once per key, duplicates dropped within the watermark."""
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(key)


def with_event_time(stream: DataFrame, column: str = "odds_time") -> DataFrame:
    return stream.withColumn("event_time", times.parse_utc(F.col(column)))
