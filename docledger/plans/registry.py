"""Queries by operator ID, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.ledger import Ledger
from .oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, more: str = ""):
    """Register ``f(ledger) -> DataFrame``."""

    def add(f: Callable[[Ledger], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle, more)
        return f

    return add
