"""Wager intake by forecast-id prefix, voids, archives of new rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions import prices, times
from linewell.functions.joins import lookup, matched
from linewell.operators.validity import known_point, known_side

PREFIX = 6      # prefixes below this length are counted ahead, longer ones are looked up by their first characters


def match_prefixes(requests: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per request: how many forecasts its id prefix names, and the hash if exactly one.

    A short prefix may name a large part of the history, of which only the number counts: short prefixes of the hashes are
    aggregated once, length by length. A longer one meets the hashes with its first six characters. Both are equi joins on folded sides, so
    no request is compared with the whole history. An empty prefix names all forecasts, a null one none.
    """
    size = F.length("forecast_id")
    asked = requests.select("forecast_id").filter("forecast_id is not null").distinct()
    hashes = forecasts.select("hash").filter("hash is not null").distinct()
    short = (hashes.select("hash", F.explode(F.sequence(F.lit(0), F.least(F.lit(PREFIX - 1), F.length("hash")))).alias("_n")).select("hash", F.expr("left(hash, _n)").alias("forecast_id"))
             .groupBy("forecast_id").agg(F.count(F.lit(1)).alias("matches"), F.min("hash").alias("hash")))
    by_count = lookup(asked.filter(size < PREFIX), short, ["forecast_id"], "inner")
    long = asked.filter(size >= PREFIX).withColumn("_p", F.substring("forecast_id", 1, PREFIX))
    hit = long.join(hashes.withColumn("_p", F.substring("hash", 1, PREFIX)), "_p").filter(F.col("hash").startswith(F.col("forecast_id")))
    found = by_count.unionByName(hit.groupBy("forecast_id").agg(F.count(F.lit(1)).alias("matches"), F.min("hash").alias("hash")))
    return lookup(requests, found, ["forecast_id"]).withColumns(
        {"matches": F.coalesce("matches", F.lit(0)), "hash": F.when(F.col("matches") == 1, F.col("hash"))})


def bet_id(hash_: Column, when: Column, stake: Column, price: Column, point: Column) -> Column:
    body = F.concat(hash_, times.iso(when), stake.cast("string"), price.cast("string"), F.coalesce(point.cast("string"), F.lit("None")))
    return F.substring(F.sha2(body, 256), 1, 12)


def wager_intake(requests: DataFrame, forecasts: DataFrame, ledger_ids: DataFrame) -> DataFrame:
    """Wager requests with bet_id and ``reason`` ('' = accepted).

    requests: request_id, forecast_id, stake_units, placed_utc, price, point (null = the forecast's).
    """
    f = forecasts.select("hash", F.col("kickoff_utc").alias("_kick"), F.col("recorded_utc").alias("_rec"), "market", "side",
                         F.col("price").alias("_price"), F.col("point").alias("_point"))
    d = match_prefixes(requests, forecasts).join(f, "hash", "left")
    d = d.withColumns({"price": F.coalesce("price", "_price"), "point": F.coalesce("point", "_point"), "_at": times.parse_utc(F.col("placed_utc"))})
    c = F.col
    d = d.withColumn("bet_id", bet_id(c("hash"), c("_at"), c("stake_units"), c("price"), c("point")))
    first = d.filter("hash is not null").groupBy("bet_id").agg(F.min("request_id").alias("_first"))
    d = d.join(first, "bet_id", "left").join(ledger_ids.select("bet_id").distinct().withColumn("_seen", F.lit(True)), "bet_id", "left")
    kick, stake = times.parse_utc(c("_kick")), c("stake_units")
    bad_stake = stake.isNull() | F.isnan(stake) | (stake <= 0) | (stake == float("inf"))
    reason = (F.when(c("matches") != 1, F.concat(F.lit("forecast id matches "), c("matches").cast("string"), F.lit(" records")))
              .when(c("_at").isNull(), "placed time is not usable")
              .when(c("_at") >= kick, "placed time is not before kickoff")
              .when(times.parse_utc(c("_rec")) > c("_at"), "placed time is before the forecast was recorded")
              .when(bad_stake, "stake must be a positive number of units").when(~prices.is_price(c("price")), "invalid price")
              .when((c("market") != "ml") & ~known_point(c("market"), c("point")), "invalid point")
              .when(~known_side(c("market"), c("side")), "invalid market/side")
              .when(F.coalesce("_seen", F.lit(False)) | (c("request_id") > c("_first")), "bet already recorded").otherwise(""))
    return d.withColumn("reason", reason).drop("_kick", "_rec", "_price", "_point", "_at", "_first", "_seen")


def check_voids(voids: DataFrame, placed: DataFrame) -> DataFrame:
    """Void requests with ``reason``: needs a placed bet; only the first void of a bet counts."""
    first = voids.groupBy("bet_id").agg(F.min("request_id").alias("_first"))
    known = placed.select("bet_id").distinct().withColumn("_placed", F.lit(True))
    d = voids.join(first, "bet_id").join(known, "bet_id", "left")
    return d.withColumn("outcome", F.when(F.col("_placed").isNull(), "no placed bet").when(F.col("request_id") > F.col("_first"), "already voided").otherwise("")).drop("_first", "_placed")


def ledger(placed: DataFrame, voids: DataFrame) -> DataFrame:
    """Placed bets with the reason they were voided for, if any."""
    ok = check_voids(voids, placed).filter("outcome = ''").select("bet_id", F.col("note").alias("voided"))
    return placed.join(ok, "bet_id", "left")


def unseen_rows(batch: DataFrame, archive: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch whose full key (nulls match) is not archived yet; repeats inside the batch are dropped."""
    tag = F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)
    fresh = batch.dropDuplicates(key).withColumn("_key", tag)
    return matched(fresh, archive.select(*key).distinct().select(tag.alias("_key")), ["_key"], "left_anti").drop("_key")
