"""Query results as metrics, over line item summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.labels import label_text
from tidemark.operators.export import MetricExport, to_metrics, to_series
from tidemark.sinks.documents import merged_attributes, to_otlp_gauges
from tidemark.sources.otlp_metrics import flatten_otlp_metrics
from tidemark.workload.adapters import table, us
from tidemark.workload.aggregates import utc
from tidemark.workload.registry import query

NOW = utc(2024, 1, 31)
CONFIG = MetricExport(
    value_columns=["TotalQuantity", "AvgDISCOUNTRate", "Lines"], metric_name_column="Name", prefix="TeamA", global_prefix="prod",
    timestamp_column="At", label_columns=["l_returnflag", "l_linestatus", "absent"],
)


def wide_results(spark, d) -> DataFrame:
    """Line item sums per supplier, flag and status with a text time and a text count."""
    li = table(spark, d, "lineitem")
    grouped = li.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 6).alias("TotalQuantity"), F.round(F.avg("l_discount"), 6).alias("AvgDISCOUNTRate"), F.count("*").cast("string").alias("Lines"),
        F.max("l_shipdate").alias("At"),
    )
    return grouped.withColumns(
        {"Name": F.concat(F.lit("lineItem-"), F.col("l_suppkey").cast("string")), "At": F.date_format("At", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    )


WIDE_SQL = """wide AS (SELECT l_suppkey, l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS q, round(avg(l_discount), 6) AS a, count(*) AS n, max(l_shipdate) AS at_ts FROM lineitem GROUP BY 1, 2, 3),
  long AS (SELECT 'prod_team_a_line_item_' || CAST(l_suppkey AS VARCHAR) || '_' || m AS name, CASE m WHEN 'total_quantity' THEN q WHEN 'avg_discount_rate' THEN a ELSE n END AS value,
    epoch_us(at_ts) AS ts_us, l_linestatus, l_returnflag FROM wide, (VALUES ('total_quantity'), ('avg_discount_rate'), ('lines')) AS t(m))"""


@query("X1_to_metrics", f"WITH {WIDE_SQL} SELECT name, value, ts_us, 'l_linestatus=' || l_linestatus || ';l_returnflag=' || l_returnflag || ';' AS labels FROM long")
def x1(spark, d):
    out = to_metrics(wide_results(spark, d), CONFIG, NOW)
    return out.select("name", "value", us("ts").alias("ts_us"), label_text(F.col("labels")).alias("labels"))


def _mixed(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    kind = F.col("o_orderkey") % 8
    return o.select(
        F.when(kind == 1, F.lit("12x")).when(kind == 2, F.lit(None).cast("string")).when(kind == 3, F.lit("1e3")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(kind == 4, F.lit("soon")).when(kind == 5, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 6, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"),
        F.when(kind == 7, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("priority"), F.col("o_orderkey").cast("string").alias("key"),
    )


MIXED = MetricExport(value_columns=["price"], default_metric_name="Order", timestamp_column="at", label_columns=["priority", "key"])


@query(
    "X3_value_coercion",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, 'order_price' AS name, CASE o_orderkey % 8 WHEN 3 THEN 1000 ELSE o_totalprice END AS value,
      epoch_us(o_orderdate) - CASE o_orderkey % 8 WHEN 6 THEN 7200000000 ELSE 0 END AS ts_us FROM orders WHERE o_orderkey % 8 IN (0, 3, 5, 6)""",
)
def x3(spark, d):
    good, _ = to_metrics(_mixed(spark, d), MIXED, NOW, strict=False)
    return good.select(F.col("labels")["key"].alias("key"), "name", "value", us("ts").alias("ts_us"))


@query(
    "X4_rejected_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderkey % 8 WHEN 4 THEN 'timestamp is null or unreadable' WHEN 7 THEN 'label column contains null value: priority'
      ELSE 'value is null or not a number' END AS reason FROM orders WHERE o_orderkey % 8 IN (1, 2, 4, 7)""",
)
def x4(spark, d):
    _, bad = to_metrics(_mixed(spark, d), MIXED, NOW, strict=False)
    return bad.select(F.col("labels")["key"].alias("key"), "reason")


@query(
    "X4_timestamp_default_now",
    "SELECT 'order_o_totalprice' AS name, o_totalprice AS value, epoch_us(TIMESTAMP '2024-01-31') AS ts_us FROM orders",
)
def x4_now(spark, d):
    cfg = MetricExport(value_columns=["o_totalprice"], default_metric_name="order")
    return to_metrics(table(spark, d, "orders"), cfg, NOW).select("name", "value", us("ts").alias("ts_us"))


@query(
    "X5_labels",
    "SELECT 'c_acctbal' AS name, c_acctbal AS value, 'c_mktsegment=' || c_mktsegment || ';c_name=' || c_name || ';' AS labels FROM customer",
)
def x5(spark, d):
    cfg = MetricExport(value_columns=["c_acctbal"], default_metric_name="c", label_columns=["c_name", "not_there", "c_mktsegment"])
    out = to_metrics(table(spark, d, "customer").withColumnRenamed("c_acctbal", "acctbal"), MetricExport(["acctbal"], default_metric_name="c", label_columns=cfg.label_columns), NOW)
    return out.select("name", "value", label_text(F.col("labels")).alias("labels"))


@query(
    "X7_to_series",
    f"WITH {WIDE_SQL} SELECT '__name__=' || name || ';l_linestatus=' || l_linestatus || ';l_returnflag=' || l_returnflag || ';' AS labels, ts_us // 1000 AS ts_ms, value FROM long",
)
def x7(spark, d):
    out = to_series(to_metrics(wide_results(spark, d), CONFIG, NOW))
    text = F.array_join(F.transform("labels", lambda e: F.concat(e["name"], F.lit("="), e["value"], F.lit(";"))), "")
    sample = F.col("samples")[0]
    return out.select(text.alias("labels"), sample["timestamp"].alias("ts_ms"), sample["value"].alias("value"))


@query(
    "exporter_chain",
    f"WITH {WIDE_SQL} SELECT name, count(*) AS points, round(sum(value), 4) AS total, 'c1' AS cluster, 'blue' AS stage FROM long GROUP BY 1",
)
def exporter_chain(spark, d):
    """Query result to metrics to gauge documents, the explicit attributes over the cluster's labels; read back from the documents."""
    metrics = to_metrics(wide_results(spark, d), CONFIG, NOW)
    attributes = merged_attributes({"cluster": "c1", "stage": "green"}, {"stage": "blue"})
    documents = to_otlp_gauges(metrics, attributes)
    samples, _ = flatten_otlp_metrics(documents.select("doc"))
    names = documents.select("name", *[F.get_json_object("doc", f"$.resourceMetrics[0].resource.attributes[{i}].value.stringValue").alias(n) for i, n in enumerate(("cluster", "stage"))])
    totals = samples.groupBy("name").agg(F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("total"))
    return totals.join(names.distinct(), "name")
