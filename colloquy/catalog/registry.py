from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("work", "speech", "writing", "mining", "change", "documents", "live", "chinese")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name`` with its checking SQL."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"colloquy.catalog.{module}")
