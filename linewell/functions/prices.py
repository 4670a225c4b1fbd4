"""American-price arithmetic as column expressions (all stay inside whole-stage codegen)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PRICE = -110.0      # fixed value: price assumed for a missing spread or total quote


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def decimal_odds(price: Column) -> Column:
    return F.when(price > 0, 1 + price / 100).when(price < 0, 1 + 100 / F.abs(price))


def implied_any(price: Column) -> Column:
    """Break-even probability without a range check."""
    return F.when(price < 0, -price / (100 - price)).otherwise(100 / (price + 100))


def is_price(price: Column) -> Column:
    """True for a finite price of at least 100 in size (never null)."""
    return F.coalesce(~F.isnan(price) & (F.abs(price) >= 100) & (F.abs(price) < F.lit(float("inf"))), F.lit(False))


def implied(price: Column) -> Column:
    """Break-even probability; null where the price is not a valid American price."""
    return F.when(is_price(price), implied_any(price))


def no_vig(first: Column, second: Column) -> Column:
    """Probability of the first side with the margin removed proportionally; null if a price is missing."""
    a, b = implied(first), implied(second)
    return a / (a + b)


def no_vig_or_default(first: Column, second: Column) -> Column:
    """As :func:`no_vig`, but a missing price counts as -110 and sizes are not checked."""
    a = implied_any(F.coalesce(first, F.lit(DEFAULT_PRICE)))
    b = implied_any(F.coalesce(second, F.lit(DEFAULT_PRICE)))
    return a / (a + b)


def expected_value(p_win: Column, p_push: Column, price: Column) -> Column:
    return p_win * (decimal_odds(price) - 1) - (1 - p_win - p_push)


def kelly(p_win: Column, p_push: Column, price: Column) -> Column:
    b = decimal_odds(price) - 1
    return F.greatest(F.lit(0.0), (b * p_win - (1 - p_win - p_push)) / b)


def stake_units(full_kelly: Column, settings) -> Column:
    return F.bround(F.least(full_kelly * settings.kelly_fraction * 100, F.lit(float(settings.max_stake_units))), 2)


def price_for_edge(p_win: Column, p_push: Column, edge: float) -> Column:
    """Worst price that still earns ``edge`` per unit; null when no price does."""
    b = (F.lit(edge) + 1 - p_win - p_push) / p_win
    return F.when((p_win > 0) & (b > 0), F.when(b >= 1, F.rint(b * 100)).otherwise(F.rint(-100 / b)))


def price_of_implied(prob: Column) -> Column:
    p = F.least(F.greatest(prob, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.when(p >= 0.5, -100 * p / (1 - p)).otherwise(100 * (1 - p) / p)


def revig_pair(first: Column, second: Column, overround: float) -> tuple[Column, Column]:
    """Both prices re-quoted at a fixed overround; a pair with a missing side is left alone."""
    p = no_vig_or_default(first, second)
    both = first.isNotNull() & second.isNotNull()
    return (F.when(both, F.rint(price_of_implied(p * (1 + overround)))).otherwise(first),
            F.when(both, F.rint(price_of_implied((1 - p) * (1 + overround)))).otherwise(second))


def grade(market: Column, side: Column, point: Column, home: Column, away: Column) -> Column:
    """W / L / P of a bet, null before the game has a score."""
    margin = F.when(side == "home", home - away).otherwise(away - home)
    total = F.when(side == "over", home + away - point).otherwise(point - home - away)
    v = F.when(market == "spread", margin + point).when(market == "ml", margin).otherwise(total)
    return F.when(v > 0, "W").when(v == 0, "P").when(v < 0, "L")


def profit(result: Column, price: Column) -> Column:
    return F.when(result == "W", decimal_odds(price) - 1).when(result == "P", F.lit(0.0)).when(result == "L", F.lit(-1.0))


def closing_value(market: Column, side: Column, point: Column, price: Column, spread_line: Column,
                  total_line: Column, home_ml: Column, away_ml: Column) -> Column:
    """Closing-line value: points for spreads and totals, probability for moneylines."""
    home = no_vig(home_ml, away_ml)
    return (F.when(market == "spread", point + F.when(side == "home", spread_line).otherwise(-spread_line))
            .when(market == "total", F.when(side == "over", total_line - point).otherwise(point - total_line))
            .when(market == "ml", F.when(side == "home", home).otherwise(1 - home) - implied(price)))
