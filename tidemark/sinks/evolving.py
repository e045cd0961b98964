"""Appends that add columns and never drop any."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.session import path_exists

SCHEMA_LOG = "_schema_log"  # folders starting with an underscore are not read as data


def merge_schemas(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of ``old`` followed by the columns only ``new`` has, whatever their case; a changed type is an error."""
    known = {f.name.lower(): f for f in old.fields}
    for f in new.fields:
        if f.name.lower() in known and known[f.name.lower()].dataType != f.dataType:
            raise ValueError(f"column {f.name} changes type from {known[f.name.lower()].dataType} to {f.dataType}")
    added = [f for f in new.fields if f.name.lower() not in known]
    return T.StructType([*old.fields, *added])


def current_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Schema of the table, from its schema log; null when the table does not exist.

    All entries count, the shortest first: two writers that add columns at once both keep theirs.
    """
    if not path_exists(spark, f"{path}/{SCHEMA_LOG}"):
        return None
    log = spark.read.schema("version int, schema string").json(f"{path}/{SCHEMA_LOG}")
    entries = [T.StructType.fromJson(json.loads(r["schema"])) for r in log.orderBy("version", "schema").collect()]
    return reduce(merge_schemas, entries) if entries else None


def append_evolving(df: DataFrame, path: str, partition_by: list[str] | None = None) -> T.StructType:
    """Append rows, creating the table or adding its new columns, and return the table's schema.

    The schema log saves readers from opening every file to merge schemas.
    """
    spark = df.sparkSession
    old = current_schema(spark, path)
    fresh = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    merged = fresh if old is None else merge_schemas(old, fresh)
    present = {c.lower() for c in df.columns}
    aligned = df.select(
        *[F.col(f.name).alias(f.name) if f.name.lower() in present else F.lit(None).cast(f.dataType).alias(f.name) for f in merged.fields]
    )
    writer = aligned.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if old is None or merged != old:
        version = len(merged.fields)
        entry = spark.createDataFrame([(version, merged.json())], "version int, schema string")
        entry.coalesce(1).write.mode("append").json(f"{path}/{SCHEMA_LOG}")
    return merged


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """Rows with all columns the table ever had; columns a file lacks are null."""
    schema = current_schema(spark, path)
    if schema is None:
        raise ValueError(f"no table at {path}")
    return spark.read.schema(schema).parquet(path)
