"""Many clusters as one: heartbeats, catalog and federated tables."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.labels import literal_map
from tidemark.functions.parsers import strict_json
from tidemark.operators.aggregate import latest_by, union_fuzzy
from tidemark.session import path_exists, qualified_path

SCHEMA_DOCUMENT = "array<struct<database:string,tables:array<string>,views:array<string>>>"


def live_endpoints(heartbeats: DataFrame, now: datetime, ttl_seconds: int) -> DataFrame:
    """Latest schema per endpoint among heartbeats newer than the time to live."""
    oldest = F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_seconds))
    recent = heartbeats.filter(F.col("Timestamp") > oldest)
    return latest_by(recent, ["ClusterEndpoint"], "Timestamp", ["Schema"])


def _schemas(heartbeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = heartbeats.withColumn("_json", strict_json(F.col("Schema")))
    valid = F.coalesce(F.schema_of_variant("_json").startswith("ARRAY"), F.lit(False))
    errors = parsed.filter(~valid).select(
        F.col("ClusterEndpoint").alias("endpoint"), F.lit("schema is not a valid document").alias("reason")
    )
    read = parsed.filter(valid).select(
        F.col("ClusterEndpoint").alias("endpoint"), F.explode(F.from_json("Schema", SCHEMA_DOCUMENT)).alias("s")
    )
    return read, errors


def federation_catalog(heartbeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endpoints per database and table or view, and the endpoints whose schema cannot be read.

    Rows with a null table list the endpoints of the database itself.
    """
    read, errors = _schemas(heartbeats)
    none = F.array().cast("array<string>")
    members = F.concat(
        F.array(F.lit(None).cast("string")), F.coalesce("s.tables", none), F.coalesce("s.views", none)
    )
    listed = read.select("endpoint", F.col("s.database").alias("database"), F.explode(members).alias("table"))
    catalog = (
        listed.distinct()
        .groupBy("database", "table")
        .agg(F.sort_array(F.collect_list("endpoint")).alias("endpoints"))
    )
    return catalog, errors


def federated_table(
    spark: SparkSession, members: dict[str, str], table: str, source_col: str = "endpoint"
) -> tuple[DataFrame, list[str]]:
    """Union of one table over member roots, and the members that lack it.

    ``members`` maps an endpoint to the root folder of its database. Each
    member is one scan, so filters and column lists are pushed into all of them.
    """
    found: dict[str, DataFrame | None] = {}
    skipped = []
    for endpoint, root in sorted(members.items()):
        path = f"{root.rstrip('/')}/{table}"
        if path_exists(spark, path):
            found[endpoint] = spark.read.parquet(path)
        else:
            skipped.append(endpoint)
    return union_fuzzy(found, source_col), skipped


def catalog_members(catalog: DataFrame, database: str, table: str) -> DataFrame:
    """Endpoints of a database, and whether each ``has`` the table, by the catalog."""
    own = catalog.filter(F.col("database") == database)
    listed = own.select(F.explode("endpoints").alias("endpoint"), F.coalesce(F.col("table") == table, F.lit(False)).alias("has"))
    return listed.groupBy("endpoint").agg(F.max("has").alias("has"))


def federated_relation(
    spark: SparkSession, catalog: DataFrame, roots: DataFrame, database: str, table: str, source_col: str = "endpoint"
) -> tuple[DataFrame | None, DataFrame]:
    """One table of a database over all endpoints as one scan, and the endpoints left out with the reason.

    ``catalog`` is that of :func:`federation_catalog`, ``roots`` has the folder (``root``) of
    each ``endpoint``. All member folders are one relation, so filters and columns are
    pushed down once; columns are aligned by name and null where a member lacks them, and
    a row's endpoint follows from the file it is read from. Partition folders, if any, are
    the same for all members. The driver sees one short
    row per endpoint. Without any member the relation is None. Left out are endpoints
    that lack the table, have no root, or lack the folder.
    """
    members = catalog_members(catalog, database, table).join(roots.select("endpoint", "root"), "endpoint", "left")
    folders, missing = {}, []
    for endpoint, has, root in sorted(map(tuple, members.select("endpoint", "has", "root").collect())):
        path = f"{root.rstrip('/')}/{table}" if root else None
        if not has:
            missing.append((endpoint, "table not in the schema"))
        elif not path:
            missing.append((endpoint, "no root"))
        elif not path_exists(spark, path):
            missing.append((endpoint, "no folder"))
        else:
            folders[qualified_path(spark, path)] = endpoint
    left_out = spark.createDataFrame(missing, "endpoint string, reason string")
    if not folders:
        return None, left_out
    rows = spark.read.option("mergeSchema", "true").parquet(*folders)
    return rows.withColumn(source_col, literal_map({_slashed(f): e for f, e in folders.items()})[_folder(table)]), left_out


def _slashed(path: str) -> str:
    """One spelling for file:/a and file:///a."""
    scheme, colon, rest = path.partition(":/")
    return f"{scheme}{colon}{rest.lstrip('/')}" if colon else path


def _folder(table: str) -> Column:
    """The table's folder above the file of a row, in the spelling of :func:`_slashed`."""
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    above = F.regexp_extract(name, f"^(.*?/{re.escape(table)})/[^/]*(?:=[^/]*/[^/]*)*$", 1)
    return F.regexp_replace(above, "^([^:/]+):/+", "$1:/")
