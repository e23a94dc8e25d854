"""Queries of the llm operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("q_tokens", "q_text", "q_match", "q_near")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _MODULES:
        out |= import_module(f"{__package__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out |= import_module(f"{__package__}.{m}").SQL
    return out
