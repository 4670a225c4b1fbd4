"""Time expressions: strict zone-aware parsing, kickoffs, formatting."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An explicit zone is required; Spark alone would also accept words and zone-less text.
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def parse_utc(text: Column) -> Column:
    """Timestamp of ISO-8601 text that names its zone; null for anything else."""
    t = F.trim(text)
    colon = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(t.rlike(ZONED), F.try_to_timestamp(F.when(t.rlike(r"[+-]\d{4}$"), colon).otherwise(t)))


def kickoff_utc(day: Column, clock: Column, zone: str = "America/New_York") -> Column:
    """UTC start of a game from its local date and wall clock; null when the clock is not listed."""
    local = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd HH:mm"))
    return F.when(clock.contains(":"), F.to_utc_timestamp(local, zone))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 6e7


def minutes(n: float) -> Column:
    """A day-time interval of ``n`` minutes."""
    return F.make_dt_interval(mins=F.lit(0), secs=F.lit(float(n) * 60))


def issue_time(recorded: Column, completed: Column) -> Column:
    """When a forecast was really available; unknown without a completion time."""
    return F.when(completed.isNotNull(), F.greatest(recorded, completed))
