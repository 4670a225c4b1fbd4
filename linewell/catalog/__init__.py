"""Every registered query and its oracle."""
from __future__ import annotations

import importlib

MODULES = ("quotes", "fields", "evaluation", "files", "models", "streams")


def _collect(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"linewell.catalog.{m}"), attr))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
