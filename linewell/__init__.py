"""Forecasting, pricing and evaluation of timestamped two-sided quotes, as Spark DataFrame operators."""
from linewell.config import Settings

__all__ = ["Settings"]
