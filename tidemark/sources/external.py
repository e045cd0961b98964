"""Datasets that live elsewhere."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, DataFrameReader, functions as F

from tidemark.functions.timebin import in_window
from tidemark.sinks.evolving import append_evolving


def import_table(
    source: DataFrame | DataFrameReader,
    target: str,
    ts: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    columns: list[str | Column] | None = None,
) -> DataFrame:
    """Append a slice of another dataset to ``target`` and return the slice.

    ``source`` is a frame or a configured reader (Parquet, ORC, JSON, JDBC, …);
    the time slice and the column list are pushed into its scan.
    """
    df = source.load() if isinstance(source, DataFrameReader) else source
    if ts is not None:
        df = df.filter(in_window(F.col(ts), start, end))
    if columns:
        df = df.select(*columns)
    append_evolving(df, target)
    return df
