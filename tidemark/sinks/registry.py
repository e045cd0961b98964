"""Schema registry: one row per registered table schema, latest wins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.labels import xxhash64_seed0


def schema_rows(df: DataFrame, updated_at: str = "updated_at") -> DataFrame:
    """Registry rows of ``table, schema_id, columns (list of name, kind), updated_at`` rows.

    The version is the hash of all names and types; an empty schema id becomes ``default``.
    """
    header = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["kind"])), ",")
    signature = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], c["kind"])), "")
    return df.select(
        "table",
        F.coalesce(F.nullif("schema_id", F.lit("")), F.lit("default")).alias("schema_id"),
        xxhash64_seed0(signature).alias("version"),
        header.alias("header"),
        F.col(updated_at).alias("updated_at"),
    )


def register_schema(df: DataFrame, table: str, path: str, now: datetime | Column, schema_id: str = "") -> None:
    """Append the schema of ``df`` to the registry at ``path``."""
    columns = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("kind")) for f in df.schema.fields]
    )
    one = df.sparkSession.range(1).select(
        F.lit(table).alias("table"),
        F.lit(schema_id).alias("schema_id"),
        columns.alias("columns"),
        (now if isinstance(now, Column) else F.lit(now)).alias("updated_at"),
    )
    schema_rows(one).write.mode("append").parquet(path)


def latest_schemas(registry: DataFrame) -> DataFrame:
    """Latest row per table and schema id."""
    row = F.struct("updated_at", "version", "header")
    return (
        registry.groupBy("table", "schema_id").agg(F.max(row).alias("_r")).select("table", "schema_id", "_r.*")
    )
