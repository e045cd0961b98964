"""Runnable queries over the benchmark tables, each with the SQL it must equal."""

from tidemark.workload.registry import QUERIES, Query, run

__all__ = ["QUERIES", "Query", "run"]
