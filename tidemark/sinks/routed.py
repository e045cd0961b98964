"""Mixed rows to their own database and table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tidemark.functions.names import normalize_identifier


def with_destination(df: DataFrame) -> DataFrame:
    """Destination names reduced to identifiers; empty ones become null."""
    return df.withColumns(
        {n: F.nullif(normalize_identifier(F.coalesce(F.col(n), F.lit(""))), F.lit("")) for n in ("database", "table")}
    )


def destination_counts(df: DataFrame) -> DataFrame:
    """Rows per destination; rows without one are counted under nulls."""
    named = with_destination(df)
    ok = F.col("database").isNotNull() & F.col("table").isNotNull()
    return named.groupBy(
        F.when(ok, F.col("database")).alias("database"), F.when(ok, F.col("table")).alias("table")
    ).agg(F.count("*").alias("rows"))


def write_routed(df: DataFrame, root: str, mode: str = "append") -> dict[str, int]:
    """Write each row below ``root/database=…/table=…`` and return how many were written and dropped.

    The rebalance hint groups rows by destination, so few files are written per
    table, and splits a destination that holds most of the rows over many tasks.
    The counts are collected while writing, not by another pass.
    """
    seen = Observation()
    ok = F.col("database").isNotNull() & F.col("table").isNotNull()
    named = with_destination(df).observe(
        seen, F.count_if(ok).alias("written"), F.count_if(~ok).alias("dropped")
    )
    rows = named.filter(ok).hint("rebalance", "database", "table")
    rows.write.mode(mode).partitionBy("database", "table").parquet(root)
    return seen.get


def read_routed(spark, root: str, database: str, table: str) -> DataFrame:
    """One destination's rows; only its folder is read."""
    return spark.read.option("basePath", root).parquet(f"{root}/database={database}/table={table}")
