"""Registered queries of the ledger."""

from . import io_queries, ledger_queries, process_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "io_queries", "ledger_queries", "process_queries", "text_queries"]
