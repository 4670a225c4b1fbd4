"""What reports say, in one place: texts by code, with {} for values. Operators choose codes and values; wording is changed here alone."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = {
    # risks of a bet
    "risk_key_numbers": "value rests on how often margins of 3 and 7 are modelled to occur",
    "risk_price": "value comes from the price that was found; model and market agree",
    "risk_market": "no value left at the market's own probability",
    "risk_plain": "no value left with plain outcome weights",
    "risk_early": "week {}: ratings of this season rest on a handful of games",
    # why a side isn't bet, or only on condition
    "low_value": "value {} does not exceed {}",
    "fragile": "value drops to {} once the fair line moves half a point against the bet",
    "condition": "on condition that {}",
    "untimed": "the price carries no quote time",
    "no_reference": "other books give no timed reference",
    "take_at": "{}; take it at your own book from {} on (keeps +{})",
    "also_condition": "also on condition that {}",
    "margin_gap": "own margin is {} points off the market (limit {}); look for news",
    "total_gap": "own total is {} points off the market (limit {})",
    "no_weather": "open or unknown roof and no usable forecast",
    # starters
    "starter_unnamed": "{}: no starter named",
    "starter_doubtful": "{}: expected starter {} is {}",
    "starter_condition": "{} is named as starter of {}",
    "starter_missing": "{}: starter not in the feed",
    "starter_unclear": "{} ({}): status not known, {}",
    "starter_fact": "{}: {}",
    "starter_usual": "{} with {}, the passer its ratings come from",
    "starter_other": "{} with {}, who is rated apart from its usual passer",
    # injury reports
    "report": "{} report of week {}{}: {}",
    "report_old": " (an older week)",
    "report_clear": "nobody is out or in doubt",
    "report_practice": "practice only so far, no game status",
    "report_absent": "; absent from practice: {}",
    "report_none": "{}: no injury report",
    "report_late": "{}: report of week {} not received",
    "report_unissued": "{}: game status of week {} not issued",
    # game facts and assumptions
    "venue": "roof {}, days of rest {} {} and {} {}",
    "venue_unknown": "unknown",
    "weather": "forecast: wind {} mph, {} F ({})",
    "assume_market": "injuries of others than passers are left to the market line",
    "assume_weather": "the forecast is no model input; it only opens totals for betting",
    "missing_roof": "forecast and roof status",
    "missing_weather": "forecast for an open stadium",
}


def text(code: str, *values: Column) -> Column:
    """The text of a code with its values; null if one of them is null."""
    parts = TEXTS[code].split("{}")
    if len(parts) != len(values) + 1:
        raise ValueError(f"{code} takes {len(parts) - 1} values")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [value, F.lit(part)]
    return F.concat(*out)
