"""Expressions evaluated once per row.

The optimizer copies a projected expression into every filter and projection
above it, and splits a parsed struct into one parse per member that is read. A
generator is a barrier to both: what it computes is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps can use many times at the cost of one evaluation."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def parse_once(df: DataFrame, parsed: Column) -> DataFrame:
    """Add the members of a parsed struct as columns, from one parse per row."""
    return df.select("*", F.inline(F.array(parsed)))
