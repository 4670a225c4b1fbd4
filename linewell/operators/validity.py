"""Validity of quotes and user inputs: one pass, first failing rule wins, nothing is dropped."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions import prices, times
from linewell.functions.joins import lookup, once

# Markets and the sides each one has.
MARKETS = ("spread", "ml", "total")
SIDES = {"spread": ("home", "away"), "ml": ("home", "away"), "total": ("over", "under")}
MICROS_PER_MINUTE = 60_000_000


def _late(a: Column, b: Column, minutes: float) -> Column:
    """a is more than ``minutes`` after b."""
    return F.unix_micros(a) - F.unix_micros(b) > F.lit(int(minutes * MICROS_PER_MINUTE))


def known_side(market: Column, side: Column) -> Column:
    ok = F.lit(False)
    for m, sides in SIDES.items():
        ok = ok | ((market == m) & side.isin(*sides))
    return F.coalesce(ok, F.lit(False))


def known_point(market: Column, point: Column) -> Column:
    """Half-point grid; totals above zero, spreads inside 60."""
    grid = F.abs(point * 2 - F.rint(point * 2)) <= 1e-9
    size = F.when(market == "total", (point > 0) & (point < float("inf"))).otherwise(F.abs(point) < 60)
    return F.coalesce(~F.isnan(point) & grid & size, F.lit(False))


def check_quotes(offers: DataFrame, kickoffs: DataFrame, now: Column, settings) -> DataFrame:
    """Adds ``odds_time_utc``, ``kickoff`` and ``reject_reason`` ('' when valid).

    ``kickoffs``: game_id, kickoff (timestamp). Text prices and points must be cast by the reader.
    """
    t, k = F.col("odds_time_utc"), F.col("kickoff")
    d = lookup(offers, kickoffs.select("game_id", "kickoff"), ["game_id"])
    d = once(d, odds_time_utc=times.parse_utc(F.col("odds_time")))
    text = F.trim(F.col("odds_time"))
    reason = (
        F.when(k.isNull(), "game not in slate or kickoff unknown")
        .when(~known_side(F.col("market"), F.col("side")), F.concat(F.lit("invalid market/side "), F.coalesce("market", F.lit("?")), F.lit("/"), F.coalesce("side", F.lit("?"))))
        .when(~prices.is_price(F.col("price")), F.concat(F.lit("invalid price "), F.coalesce(F.col("price").cast("string"), F.lit("?"))))
        .when((F.col("market") != "ml") & ~known_point(F.col("market"), F.col("point")),
              F.concat(F.lit("invalid point "), F.coalesce(F.col("point").cast("string"), F.lit("?"))))
        .when(F.coalesce(text, F.lit("")) == "", "odds timestamp: missing timestamp")
        .when(t.isNull(), F.concat(F.lit("odds timestamp: unusable timestamp "), text))
        .when(_late(t, now, settings.clock_skew_minutes), F.concat(F.lit("odds timestamp "), times.iso(t), F.lit(" is in the future")))
        .when(_late(now, t, settings.max_odds_age_minutes),
              F.concat(F.lit("stale: quoted "), times.iso(t), F.lit(f", older than {settings.max_odds_age_minutes:g} min")))
        .when((t >= k) | (now >= k), F.concat(F.lit("at/after kickoff "), times.iso(k)))
        .otherwise(""))
    return once(d, reject_reason=reason)


def valid_quotes(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason") == "").drop("reject_reason")


def rejected_quotes(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason") != "")


def reject_counts(checked: DataFrame) -> DataFrame:
    """Rejected quotes per reason prefix (the text before the first colon)."""
    return (rejected_quotes(checked)
            .groupBy(F.substring_index("reject_reason", ":", 1).alias("reason")).agg(F.count("*").alias("quotes")))


# ---------------------------------------------------------------- user inputs

def key_reason(kickoff: Column, given_text: Column, tolerance_minutes: float) -> Column:
    """'' when a row names a known game and its kickoff agrees with the schedule."""
    given = times.parse_utc(given_text)
    off = F.abs(F.unix_micros(given) - F.unix_micros(kickoff)) > int(tolerance_minutes * MICROS_PER_MINUTE)
    return (F.when(kickoff.isNull(), "unknown game_id (not in this slate)")
            .when(given.isNull(), "kickoff_utc: unusable timestamp")
            .when(off, F.concat(F.lit("kickoff_utc "), times.iso(given), F.lit(" does not match schedule "), times.iso(kickoff)))
            .otherwise(""))


def check_game_keys(rows: DataFrame, kickoffs: DataFrame, tolerance_minutes: float) -> DataFrame:
    d = lookup(rows, kickoffs.select("game_id", "kickoff"), ["game_id"])
    return d.withColumn("reason", key_reason(F.col("kickoff"), F.col("kickoff_utc"), tolerance_minutes))


def time_reason(label: str, text: Column, decision: Column, kickoff: Column, skew: float, max_age: float | None) -> Column:
    """'' when a stated time was usable at the decision time."""
    t = times.parse_utc(text)
    c = (F.when(t.isNull(), F.lit(f"{label}: unusable timestamp"))
         .when(_late(t, decision, skew), F.concat(F.lit(f"{label} "), times.iso(t), F.lit(" is after the decision time")))
         .when(t >= kickoff, F.concat(F.lit(f"{label} "), times.iso(t), F.lit(" is at/after kickoff"))))
    if max_age is not None:
        c = c.when(_late(decision, t, max_age), F.concat(F.lit(f"{label} "), times.iso(t), F.lit(f" is stale: older than {max_age:g} min")))
    return c.otherwise("")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _first_text(*reasons: Column) -> Column:
    return F.coalesce(*[F.when(r != "", r) for r in reasons], F.lit(""))


def _keep_first(d: DataFrame, keys: list[str], order: str, note: str) -> DataFrame:
    """Accepted duplicates of a key keep the earliest row.

    The earliest accepted row per key is an aggregate with map-side combine, joined back; no group is
    sorted in one task.
    """
    firsts = d.filter(F.col("reason") == "").groupBy(*keys).agg(F.min(order).alias("_first"))
    d = lookup(d, firsts, keys)
    later = (F.col("reason") == "") & (F.col(order) > F.col("_first"))
    return d.withColumn("reason", F.when(later, note).otherwise(F.col("reason"))).drop("_first")


def check_starter_inputs(rows: DataFrame, slate: DataFrame, decision: Column, settings) -> DataFrame:
    """Starter confirmations with a ``reason`` ('' = accepted).

    rows: row_no, game_id, kickoff_utc, team, qb_name, source, confirmed_utc (text);
    slate: game_id, kickoff, home_team, away_team.
    """
    d = lookup(rows, slate.select("game_id", "kickoff", "home_team", "away_team"), ["game_id"])
    in_game = F.coalesce(F.col("team").isin(F.col("home_team"), F.col("away_team")), F.lit(False))
    reason = _first_text(
        key_reason(F.col("kickoff"), F.col("kickoff_utc"), settings.kickoff_match_minutes),
        F.when(~in_game, F.concat(F.lit("team "), F.coalesce("team", F.lit("?")), F.lit(" is not in this game"))).otherwise(""),
        F.when(_blank(F.col("qb_name")), "qb_name is blank").otherwise(""),
        F.when(_blank(F.col("source")), "source is blank").otherwise(""),
        time_reason("confirmed_utc", F.col("confirmed_utc"), decision, F.col("kickoff"),
                    settings.clock_skew_minutes, settings.qb_confirm_max_age_minutes))
    return _keep_first(once(d, reason=reason), ["game_id", "team"], "row_no", "duplicate override for this game and team")


# Plausible weather ranges.
WIND_RANGE = (0.0, 100.0)
TEMP_RANGE = (-60.0, 130.0)


def check_weather_inputs(rows: DataFrame, kickoffs: DataFrame, decision: Column, settings) -> DataFrame:
    """Weather forecasts with a ``reason`` ('' = accepted); numbers arrive as text."""
    d = lookup(rows, kickoffs.select("game_id", "kickoff"), ["game_id"])
    wind, temp = F.col("wind_mph").try_cast("double"), F.col("temp_f").try_cast("double")
    k = F.col("kickoff")
    issued, got, valid = (times.parse_utc(F.col(c)) for c in ("forecast_utc", "retrieved_utc", "valid_for_utc"))

    def outside(x, lo_hi):
        return F.isnan(x) | ~x.between(*lo_hi)
    window = int(settings.weather_valid_window_minutes * MICROS_PER_MINUTE)
    reason = _first_text(
        key_reason(k, F.col("kickoff_utc"), settings.kickoff_match_minutes),
        F.when(_blank(F.col("source")), "source is blank").otherwise(""),
        F.when(wind.isNull() | temp.isNull(), "wind_mph/temp_f not numeric").otherwise(""),
        F.when(outside(wind, WIND_RANGE), "wind_mph out of range").otherwise(""),
        F.when(outside(temp, TEMP_RANGE), "temp_f out of range").otherwise(""),
        time_reason("forecast_utc", F.col("forecast_utc"), decision, k, settings.clock_skew_minutes, settings.weather_max_age_minutes),
        time_reason("retrieved_utc", F.col("retrieved_utc"), decision, k, settings.clock_skew_minutes, None),
        F.when(got < issued, "retrieved_utc is before forecast_utc").otherwise(""),
        F.when(valid.isNull(), "valid_for_utc: unusable timestamp").otherwise(""),
        F.when(F.abs(F.unix_micros(valid) - F.unix_micros(k)) > window, "valid_for_utc is too far from kickoff").otherwise(""))
    d = once(d, reason=reason).withColumn("wind", wind).withColumn("temp", temp)
    return _keep_first(d, ["game_id"], "row_no", "duplicate forecast for this game")


def rejected_inputs(*checked: tuple[str, DataFrame]) -> DataFrame:
    """The rejected halves of several inputs with uniform columns: file, game_id, team, reason."""
    out = None
    for name, d in checked:
        team = F.col("team") if "team" in d.columns else F.lit(None).cast("string")
        part = d.filter(F.col("reason") != "").select(F.lit(name).alias("file"), "game_id", team.alias("team"), "reason")
        out = part if out is None else out.unionByName(part)
    return out
