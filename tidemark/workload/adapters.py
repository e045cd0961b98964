"""Telemetry-shaped inputs derived from the benchmark tables, in Spark and as SQL text.

Each ``*_SQL`` constant is the body of a common table expression giving the same
rows as the frame of the same name, with labels as separate columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.labels import label_text
from tidemark.schemas import DEFAULT_NAMING

DB = DEFAULT_NAMING.database
PREFIX = DEFAULT_NAMING.reserved_prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table with its local times read as UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def us(c: str | Column) -> Column:
    """Microseconds since the epoch, the engine-neutral form of a time."""
    return F.unix_micros(c)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def json_k() -> Column:
    return F.get_json_object("props", "$.k")


def sql_text(*pairs: tuple[str, str]) -> str:
    """SQL giving the sorted ``name=value;`` text of label names and value expressions."""
    items = ", ".join(f"'{name}=' || {value} || ';'" for name, value in pairs)
    return f"array_to_string(list_sort([{items}]), '')"


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric samples: event_id, name, labels, ts, value."""
    e = table(spark, sf_dir, "events")
    labels = F.create_map(
        F.lit("user"),
        F.col("user_id").cast("string"),
        F.lit("k"),
        json_k(),
        F.lit("Region"),
        F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")),
        F.lit(DB),
        F.when(F.col("event_type") == "signup", F.lit("")).otherwise("Metrics"),
    )
    return e.select(
        "event_id", F.concat(F.lit("app_"), "event_type", F.lit("_total")).alias("name"), labels.alias("labels"), "ts", "value"
    )


METRIC_SQL = """metric AS (
  SELECT event_id, 'app_' || event_type || '_total' AS name, CAST(user_id AS VARCHAR) AS l_user,
         json_extract_string(props, '$.k') AS l_k, 'r' || CAST(user_id % 3 AS VARCHAR) AS l_region,
         CASE WHEN event_type = 'signup' THEN '' ELSE 'Metrics' END AS l_db, ts, value
  FROM events)"""
METRIC_LABELS = [("user", "l_user"), ("k", "l_k"), ("Region", "l_region"), (DB, "l_db")]


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter series per user: SeriesId, Timestamp, Value, Labels; the value drops at every 97th event."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 97 == 0, F.col("value")).otherwise(F.col("event_id") + F.col("value") / 1000)
    return e.select(
        F.col("user_id").alias("SeriesId"),
        F.col("ts").alias("Timestamp"),
        value.alias("Value"),
        F.create_map(F.lit("region"), (F.col("user_id") % 3).cast("string")).alias("Labels"),
    )


COUNTER_SQL = """counter AS (
  SELECT user_id AS sid, ts, CASE WHEN event_id % 97 = 0 THEN value ELSE event_id + value / 1000 END AS v,
         CAST(user_id % 3 AS VARCHAR) AS region
  FROM events)"""


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows: event_id, ts, time_ns, observed_ns, body, resource, attributes."""
    e = table(spark, sf_dir, "events")

    def v(c: Column) -> Column:
        return c.cast("variant")

    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).when(F.col("event_type") == "signup", F.lit("WARN")).otherwise("INFO")
    body = F.create_map(
        F.lit("k"), v(json_k().cast("bigint")), F.lit("lvl"), v(level), F.lit("source"), v(F.col("event_type")),
        F.lit("msg"), v(F.concat(F.lit("event "), "event_type", F.lit(" by "), F.col("user_id").cast("string"))),
        F.lit("ts"), v(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
    )
    resource = F.create_map(
        F.lit("host"), v(F.concat(F.lit("host_"), (F.col("user_id") % 5).cast("string"))),
        F.lit("label.app"), v(F.lit("web")), F.lit(PREFIX + "cursor"), v(F.lit("c")), F.lit("cpu"), v(F.col("user_id") % 4),
    )
    attributes = F.create_map(
        F.lit("dest.database"), v(F.when(F.col("event_type") != "view", F.lit("Logs")).otherwise("")),
        F.lit("dest.table"), v(F.initcap("event_type")), F.lit(PREFIX + "x"), v(F.lit("1")),
        F.lit("tag"), v(F.when(F.col("event_type") == "click", F.lit("")).otherwise(F.col("event_type"))),
    )
    return e.select(
        "event_id", "user_id", "event_type", "ts", "value", (us("ts") * 1000).alias("time_ns"),
        (us("ts") * 1000 + F.col("event_id") % 1000).alias("observed_ns"),
        body.alias("body"), resource.alias("resource"), attributes.alias("attributes"),
    )


LOG_SQL = """log AS (
  SELECT event_id, user_id, event_type, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS lvl,
         'event ' || event_type || ' by ' || CAST(user_id AS VARCHAR) AS msg,
         'host_' || CAST(user_id % 5 AS VARCHAR) AS host,
         upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS dest_table
  FROM events)"""


def node_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes: node, labels, annotations."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("bigint").alias("node"),
        F.create_map(F.lit("zone"), F.col("r_name"), F.lit("name"), F.col("n_name")).alias("labels"),
        F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("rack"), F.concat(F.lit("rack"), F.col("n_regionkey").cast("string"))))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("annotations"),
    )


def pod_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pods: file, namespace, pod, container, container_id, labels, annotations, database, table."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("/var/log/"), F.col("c_custkey").cast("string"), F.lit(".log")).alias("file"),
        F.lower("c_mktsegment").alias("namespace"),
        F.concat(F.lit("pod-"), F.col("c_custkey").cast("string")).alias("pod"),
        F.lit("main").alias("container"),
        F.when(F.col("c_custkey") % 10 == 9, F.lit("")).otherwise(F.concat(F.lit("docker://"), F.col("c_custkey").cast("string"))).alias("container_id"),
        F.create_map(F.lit("tier"), (F.col("c_nationkey") % 2).cast("string")).alias("labels"),
        F.create_map(F.lit("owner"), F.col("c_name"), F.lit("route/log-sources"), F.lit("error:Errors:App"), F.lit("route/skip"), F.lit("x")).alias("annotations"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise("Logs").alias("database"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise("Pods").alias("table"),
    )


__all__ = [n for n in dir() if not n.startswith("_")] + ["label_text"]
