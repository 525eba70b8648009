"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

MODULES = ("simhash", "licenses", "langid", "mix", "html_text", "pii", "quality", "toxicity", "media", "packing")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
