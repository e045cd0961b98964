"""Sinks: routed writes, evolving tables, layout, compaction, registry, export documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.labels import label_text
from tidemark.operators import relabel
from tidemark.operators.logs import resolve_destination
from tidemark.session import scratch_path
from tidemark.sinks import layout as lay
from tidemark.sinks.documents import group_by_tag, merged_attributes, to_otlp_gauges
from tidemark.sinks.evolving import append_evolving, read_evolving
from tidemark.sinks.fan_out import fan_out
from tidemark.sinks.registry import latest_schemas, schema_rows
from tidemark.sinks.routed import destination_counts, write_routed
from tidemark.workload.adapters import LOG_SQL, METRIC_SQL, counters, log_rows, metric_samples, r6, table, us
from tidemark.workload.aggregates import bin_sql, utc
from tidemark.workload.registry import query

NOW = utc(2024, 1, 31)


def _destined(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", "value",
        F.when(F.col("event_type") == "view", F.lit("--")).when(F.col("event_type") == "click", F.lit(None).cast("string")).otherwise("My-Logs").alias("database"),
        F.concat("event_type", F.lit("_tab")).alias("table"),
    )


@query(
    "K1_write_routed",
    "SELECT 'MyLogs' AS database, event_type || 'tab' AS table_name, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 2",
)
def k1(spark, d):
    root = scratch_path(spark, "routed")
    write_routed(_destined(spark, d), root)
    out = spark.read.parquet(root).groupBy("database", F.col("table").alias("table_name"))
    return out.agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "K1_destination_counts",
    """SELECT CASE WHEN event_type NOT IN ('view', 'click') THEN 'MyLogs' END AS database, CASE WHEN event_type NOT IN ('view', 'click') THEN event_type || 'tab' END AS table_name,
      count(*) AS n FROM events GROUP BY 1, 2""",
)
def k1_counts(spark, d):
    return destination_counts(_destined(spark, d)).select("database", F.col("table").alias("table_name"), F.col("rows").alias("n"))


@query("K2_append_evolving", "SELECT o_orderkey AS id, o_totalprice AS price, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS status FROM orders")
def k2(spark, d):
    o, path = table(spark, d, "orders"), scratch_path(spark, "evolving")
    even, odd = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1
    append_evolving(o.filter(even).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), path)
    append_evolving(o.filter(odd).select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), path)
    return read_evolving(spark, path)


@query("K3_write_layout", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS series, CAST(0 AS BIGINT) AS out_of_order FROM events GROUP BY 1")
def k3(spark, d):
    path = scratch_path(spark, "layout")
    lay.write_layout(counters(spark, d).drop("Labels"), path)
    # Rows of a file that come before an earlier row of their series, or of an earlier series.
    file = Window.partitionBy("_metadata.file_path").orderBy("_metadata.row_index")
    before, now = F.lag(F.struct("SeriesId", "Timestamp")).over(file), F.struct("SeriesId", "Timestamp")
    rows = spark.read.parquet(path).withColumn("wrong", F.coalesce(before > now, F.lit(False)))
    out = rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("SeriesId").alias("series"), F.count_if("wrong").alias("out_of_order"))


@query("K4_compact", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def k4(spark, d):
    src, out = scratch_path(spark, "small"), scratch_path(spark, "compacted")
    table(spark, d, "lineitem").repartition(16).write.partitionBy("l_returnflag").parquet(src)
    lay.compact(spark, src, out, ["l_returnflag"])
    return spark.read.parquet(out).groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"))


@query("K4_plan_compaction")
def k4_plan(spark, d):
    src = scratch_path(spark, "small")
    table(spark, d, "lineitem").repartition(40).write.partitionBy("l_returnflag").parquet(src)
    plan = lay.plan_compaction(lay.list_files(spark, src), target_bytes=100_000)
    return plan.groupBy(F.regexp_extract("folder", "[^/]*$", 0).alias("folder"), "batch").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).drop("batch")


@query(
    "K6_latest_schemas",
    """SELECT event_type AS table_name, CASE WHEN user_id % 3 = 0 THEN 'default' ELSE 's' || CAST(user_id % 3 AS VARCHAR) END AS schema_id, epoch_us(max(ts)) AS updated_us,
      'Timestamp:datetime,C' || json_extract_string(arg_max(props, ts), '$.k') || ':long' AS header FROM events GROUP BY 1, 2""",
)
def k6(spark, d):
    e = table(spark, d, "events")
    column = lambda n, k: F.struct(n.alias("name"), F.lit(k).alias("kind"))
    rows = e.select(
        F.col("event_type").alias("table"), F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))).alias("schema_id"),
        F.array(column(F.lit("Timestamp"), "datetime"), column(F.concat(F.lit("C"), F.get_json_object("props", "$.k")), "long")).alias("columns"), F.col("ts").alias("updated_at"),
    )
    out = latest_schemas(schema_rows(rows))
    return out.select(F.col("table").alias("table_name"), "schema_id", us("updated_at").alias("updated_us"), "header")


@query(
    "K7_otlp_gauges",
    f"""WITH {METRIC_SQL}, g AS (SELECT name, l_user, l_region, {bin_sql("ts", 3600)} AS slice_us, count(*) AS points,
      string_agg('{{"attributes":[{{"key":"Region","value":{{"stringValue":"' || l_region || '"}}}},{{"key":"user","value":{{"stringValue":"' || l_user || '"}}}}],"timeUnixNano":"'
        || CAST(epoch_us(ts) // 1000 * 1000000 AS VARCHAR) || '","asDouble":' || CAST(value AS VARCHAR) || '}}', ',' ORDER BY epoch_us(ts) // 1000, value) AS pts FROM metric GROUP BY 1, 2, 3, 4)
    SELECT name, slice_us, points, '{{"resourceMetrics":[{{"resource":{{"attributes":[{{"key":"cluster","value":{{"stringValue":"c2"}}}},{{"key":"env","value":{{"stringValue":"prod"}}}}]}},"scopeMetrics":[{{"metrics":[{{"name":"'
      || name || '","gauge":{{"dataPoints":[' || pts || ']}}}}]}}]}}]}}' AS doc FROM g""",
)
def k7(spark, d):
    samples = relabel.drop_labels(metric_samples(spark, d), [("", "^k$")])
    out = to_otlp_gauges(samples, merged_attributes({"cluster": "c1", "env": "prod"}, {"cluster": "c2"}))
    return out.select("name", us("slice_start").alias("slice_us"), "points", "doc")


@query(
    "K8_group_by_tag",
    f"""WITH {LOG_SQL} SELECT event_type AS tag, {bin_sql("ts", 86400)} AS slice_us, count(*) AS n, string_agg(CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || CAST(epoch_us(ts) % 1000000 * 1000 AS VARCHAR)
      || '{{"k":' || CAST(k AS VARCHAR) || '}}', ',' ORDER BY ts) AS entries FROM log WHERE event_type <> 'click' GROUP BY 1, 2""",
)
def k8(spark, d):
    rows = log_rows(spark, d).withColumn("body", F.map_filter("body", lambda k, _: k == "k"))
    out = group_by_tag(rows, "tag", slice_seconds=86_400)
    text = F.transform("entries", lambda e: F.concat(e["seconds"].cast("string"), F.lit("."), e["nanos"].cast("string"), e["body"]))
    return out.select("tag", us("slice_start").alias("slice_us"), F.size("entries").alias("n"), F.array_join(text, ",").alias("entries"))


@query("K9_fan_out", "SELECT 'a' AS sink, count(*) AS n, round(sum(value), 6) AS total FROM events UNION ALL SELECT 'b', count(*), round(sum(value), 6) FROM events")
def k9(spark, d):
    a, b = scratch_path(spark, "sink-a"), scratch_path(spark, "sink-b")

    def broken(_: DataFrame) -> None:
        raise OSError("sink is down")

    result = fan_out(
        table(spark, d, "events").select("event_id", "value"),
        {"a": lambda df: df.write.parquet(a), "broken": broken, "b": lambda df: df.write.parquet(b)},
    )
    if result != {"a": None, "broken": "sink is down", "b": None}:
        raise RuntimeError(str(result))
    totals = [spark.read.parquet(p).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total")).select(F.lit(n).alias("sink"), "n", "total") for n, p in (("a", a), ("b", b))]
    return totals[0].unionByName(totals[1])


def in_files(df: DataFrame, files: int) -> DataFrame:
    """Rows in parts for this number of files: the parts the table is read in put together, if each file gets some, else shuffled."""
    together = df.coalesce(files)
    filled = together.groupBy(F.spark_partition_id().alias("part")).count()
    return together if filled.count() == files else df.repartition(files)


@query(
    "Q8_table_details",
    """SELECT 'orders' AS table_name, count(*) AS n, CAST(3 AS BIGINT) AS extents, TRUE AS sized FROM orders
    UNION ALL SELECT 'lineitem', count(*), CAST(5 AS BIGINT), TRUE FROM lineitem""",
)
def q8(spark, d):
    root = scratch_path(spark, "inventory")
    for name, files in (("orders", 3), ("lineitem", 5)):
        in_files(table(spark, d, name), files).write.parquet(f"{root}/{name}")
    out = lay.table_details(spark, root, NOW, ["orders", "lineitem"])
    # A row takes at least a byte and less than its columns as text.
    sized = (F.col("bytes") > F.col("rows")) & (F.col("bytes") < 500 * F.col("rows"))
    return out.select(F.col("table").alias("table_name"), F.col("rows").alias("n"), "extents", sized.alias("sized"))


@query(
    "metrics_ingest_path",
    f"""WITH {METRIC_SQL} SELECT l_db AS database, upper(substr(name, 1, 1)) || substr(name, 2, 2) || upper(substr(name, 5, 1)) || substr(name, 6, length(name) - 11) || 'Total' AS table_name,
      l_region AS region, count(*) AS n, round(sum(value), 6) AS total FROM metric WHERE l_db <> '' AND name NOT LIKE '%error%' GROUP BY 1, 2, 3""",
)
def ingest_path(spark, d):
    kept = relabel.filter_metrics(metric_samples(spark, d), relabel.MetricFilter(drop=["error"]))
    labelled = relabel.add_labels(relabel.drop_labels(kept, [("", "^k$")]), {"env": "prod"})
    routed, _ = relabel.route_metrics(labelled, ["Region"])
    stored = relabel.to_metrics_table(routed, ["Region"])
    root = scratch_path(spark, "ingest")
    write_routed(stored.drop("schema_id"), root)
    out = spark.read.parquet(root).groupBy("database", F.col("table").alias("table_name"), F.col("Region").alias("region"))
    return out.agg(F.count("*").alias("n"), r6(F.sum("Value")).alias("total"))


__all__ = ["label_text", "resolve_destination"]
