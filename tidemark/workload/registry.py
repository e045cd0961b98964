"""Query registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import configure

MODULES = ("metrics", "otlp", "logs", "aggregates", "series", "rules", "alerts", "export", "federation", "layout", "stream")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id and name, with its equivalent SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = Query(name, build, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    for module in MODULES:
        importlib.import_module(f"tidemark.workload.{module}")
    return QUERIES


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """Build one query."""
    return load_all()[name].build(spark, sf_dir)
