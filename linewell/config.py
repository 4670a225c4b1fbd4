"""Scalar settings shared by the operators; passed into plans as literals."""
from __future__ import annotations

import math
from dataclasses import dataclass, fields

# Allowed ranges, as (lower, lower included, upper, upper included).
RANGES = {
    "max_odds_age_minutes": (0, False, 1440, True),
    "clock_skew_minutes": (0, True, 60, True),
    "kickoff_match_minutes": (0, True, 1440, True),
    "min_reference_books": (1, True, 50, True),
    "qb_confirm_max_age_minutes": (0, False, 20160, True),
    "weather_max_age_minutes": (0, False, 10080, True),
    "weather_valid_window_minutes": (0, False, 1440, True),
    "horizon_minutes": (0, False, 10080, True),
    "horizon_tolerance_minutes": (0, False, 10080, True),
    "min_edge": (0, True, 1, False),
    "gap_points": (0, False, 60, True),
    "kelly_fraction": (0, False, 1, True),
    "max_stake_units": (0, False, 100, True),
}


@dataclass(frozen=True)
class Settings:
    max_odds_age_minutes: float = 30.0
    clock_skew_minutes: float = 2.0
    kickoff_match_minutes: float = 10.0
    min_reference_books: int = 2
    qb_confirm_max_age_minutes: float = 2880.0
    weather_max_age_minutes: float = 720.0
    weather_valid_window_minutes: float = 180.0
    horizon_minutes: float = 60.0
    horizon_tolerance_minutes: float = 15.0
    min_edge: float = 0.02
    gap_points: float = 4.0
    kelly_fraction: float = 0.25
    max_stake_units: float = 2.0

    def __post_init__(self):
        for f in fields(self):
            value, (lo, lo_in, hi, hi_in) = getattr(self, f.name), RANGES[f.name]
            whole = f.name == "min_reference_books"
            if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
                raise ValueError(f"{f.name} has the wrong type: {value!r}")
            above = value >= lo if lo_in else value > lo
            below = value <= hi if hi_in else value < hi
            if not (math.isfinite(value) and above and below):
                raise ValueError(f"{f.name}={value!r} is outside its range")
