"""Operators of a training-data pipeline: filters, deduplication, extraction, scoring and mixing."""
