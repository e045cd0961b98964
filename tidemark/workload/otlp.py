"""OpenTelemetry metric and log documents built from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.labels import label_text
from tidemark.operators.logs import encode_otlp_logs
from tidemark.schemas import DEFAULT_NAMING
from tidemark.session import spread
from tidemark.sources.otlp_logs import flatten_otlp_logs, log_records
from tidemark.sources.otlp_metrics import (
    exp_histogram_points,
    flatten_otlp_metrics,
    histogram_points,
    metric_rows,
    number_points,
    summary_points,
)
from tidemark.workload.adapters import r6, table
from tidemark.workload.registry import query


def _attrs(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])


def _string(c: Column) -> Column:
    return F.struct(c.alias("stringValue"))


def metric_documents(spark, d) -> DataFrame:
    """One document per event holding a gauge, a sum, a histogram, a summary and an exponential histogram."""
    e = spread(table(spark, d, "events").select("event_id", "user_id", "ts", "value"))  # before the documents are made
    ns = (F.unix_micros("ts") * 1000).cast("string")
    attrs = _attrs(user=_string(F.col("user_id").cast("string"))).alias("attributes")
    text = lambda c: c.cast("string")
    number = F.struct(attrs, ns.alias("timeUnixNano"), F.col("value").alias("asDouble"))
    whole = F.struct(attrs, ns.alias("timeUnixNano"), text(F.col("event_id")).alias("asInt"))
    histogram = F.struct(
        attrs, ns.alias("timeUnixNano"), text(F.col("event_id") + 6).alias("count"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("sum"),
        F.array(text(F.lit(1)), text(F.lit(2)), text(F.lit(3)), text(F.col("event_id"))).alias("bucketCounts"),
        F.array(F.lit(0.5), F.lit(1.0), F.col("user_id") + 10.25).alias("explicitBounds"),
    )
    summary = F.struct(
        attrs, ns.alias("timeUnixNano"), text(F.col("event_id")).alias("count"), F.col("value").alias("sum"),
        F.array(
            F.struct(F.lit(0.5).alias("quantile"), F.col("value").alias("value")),
            F.struct(F.lit(0.99).alias("quantile"), (F.col("value") * 2).alias("value")),
        ).alias("quantileValues"),
    )
    side = lambda *c: F.struct(F.lit(0).alias("offset"), F.array(*[text(x) for x in c]).alias("bucketCounts"))
    exp = F.struct(
        attrs, ns.alias("timeUnixNano"), text(F.col("event_id")).alias("count"), F.col("value").alias("sum"),
        F.lit(0).alias("scale"), text(F.lit(7)).alias("zeroCount"),
        side(F.col("event_id"), F.lit(2)).alias("positive"), side(F.lit(5)).alias("negative"),
    )

    def metric(name: str, kind: str, point: Column) -> Column:
        kinds = ("gauge", "sum", "histogram", "summary", "exponentialHistogram")
        shapes = {"gauge": number, "sum": whole, "histogram": histogram, "summary": summary, "exponentialHistogram": exp}
        fields = [
            F.when(F.lit(k == kind), F.struct(F.array(shapes[k]).alias("dataPoints"))).alias(k) for k in kinds
        ]
        return F.struct(F.lit(name).alias("name"), *fields)

    metrics = F.array(
        metric("temp", "gauge", number), metric("seen", "sum", whole), metric("lat", "histogram", histogram),
        metric("size", "summary", summary), metric("exp", "exponentialHistogram", exp),
    )
    doc = F.struct(
        F.array(F.struct(F.array(F.struct(metrics.alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics")
    )
    return e.select("event_id", F.to_json(doc).alias("doc"))


POINT_SQL = "e AS (SELECT event_id, 'user=' || CAST(user_id AS VARCHAR) || ';' AS l, user_id, epoch_us(ts) // 1000 AS ts_ms, value, CAST(event_id AS DOUBLE) AS n FROM events)"
NUMBER_SQL = """SELECT event_id, 'temp' AS name, l AS labels, ts_ms, value FROM e
    UNION ALL SELECT event_id, 'seen', l, ts_ms, n FROM e"""
HISTOGRAM_SQL = """SELECT event_id, 'lat_count' AS name, l AS labels, ts_ms, n + 6 AS value FROM e
    UNION ALL SELECT event_id, 'lat_sum', l, ts_ms, value FROM e WHERE event_id % 3 <> 0
    UNION ALL SELECT event_id, 'lat_bucket', 'le=' || b || ';' || l, ts_ms, CASE i WHEN 4 THEN {last} ELSE {own} END
      FROM (SELECT *, CASE i WHEN 1 THEN '0.500000' WHEN 2 THEN '1.000000' WHEN 3 THEN CAST(user_id + 10 AS VARCHAR) || '.250000' ELSE '+Inf' END AS b
            FROM e, (VALUES (1), (2), (3), (4)) AS t(i))"""
RAW_HISTOGRAM_SQL = HISTOGRAM_SQL.format(last="n", own="i")
CUMULATIVE_SQL = HISTOGRAM_SQL.format(last="n + 6", own="i * (i + 1) / 2")
SUMMARY_SQL = """SELECT event_id, 'size_count' AS name, l AS labels, ts_ms, n AS value FROM e
    UNION ALL SELECT event_id, 'size_sum', l, ts_ms, value FROM e
    UNION ALL SELECT event_id, 'size', 'quantile=0.500000;' || l, ts_ms, value FROM e
    UNION ALL SELECT event_id, 'size', 'quantile=0.990000;' || l, ts_ms, value * 2 FROM e"""


def _shown(samples: DataFrame) -> DataFrame:
    return samples.select(
        "event_id", "name", label_text(F.col("labels")).alias("labels"), F.unix_millis("ts").alias("ts_ms"), "value"
    )


@query("S4_flatten_otlp_metrics", f"WITH {POINT_SQL} {NUMBER_SQL} UNION ALL {RAW_HISTOGRAM_SQL} UNION ALL {SUMMARY_SQL}")
def s4(spark, d):
    return _shown(flatten_otlp_metrics(metric_documents(spark, d))[0])


@query("M1_number_points", f"WITH {POINT_SQL} {NUMBER_SQL}")
def m1(spark, d):
    return _shown(number_points(metric_rows(metric_documents(spark, d))))


@query("M2_histogram_points", f"WITH {POINT_SQL} {RAW_HISTOGRAM_SQL}")
def m2(spark, d):
    return _shown(histogram_points(metric_rows(metric_documents(spark, d))))


@query("M2_histogram_points_cumulative", f"WITH {POINT_SQL} {CUMULATIVE_SQL}")
def m2_cumulative(spark, d):
    return _shown(histogram_points(metric_rows(metric_documents(spark, d)), cumulative=True))


@query("M3_summary_points", f"WITH {POINT_SQL} {SUMMARY_SQL}")
def m3(spark, d):
    return _shown(summary_points(metric_rows(metric_documents(spark, d))))


@query("M4_rejected_points", "SELECT 'unsupported type ExponentialHistogram' AS reason, count(*) AS points FROM events")
def m4(spark, d):
    rejects = flatten_otlp_metrics(metric_documents(spark, d))[1]
    return rejects.groupBy("reason").agg(F.sum("points").alias("points"))


@query(
    "M5_exp_histogram_points",
    f"""WITH {POINT_SQL} SELECT event_id, name, labels, ts_ms, value FROM (
      SELECT event_id, 'exp_count' AS name, l AS labels, ts_ms, n AS value FROM e
      UNION ALL SELECT event_id, 'exp_sum', l, ts_ms, value FROM e
      UNION ALL SELECT event_id, 'exp_bucket', 'le=' || b || ';' || l, ts_ms, CASE i WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN n ELSE 2 END
        FROM e, (VALUES (1, '-1.000000'), (2, '0.000000'), (3, '2.000000'), (4, '4.000000')) AS t(i, b))""",
)
def m5(spark, d):
    return _shown(exp_histogram_points(metric_rows(metric_documents(spark, d))))


def log_documents(spark, d) -> DataFrame:
    """One document per event: text, map and nested bodies, mixed attribute types, some without a destination."""
    e = table(spark, d, "events")
    eid = F.col("event_id").cast("string")

    def q(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    def kv(k: str, kind: str, v: Column) -> Column:
        return F.concat(F.lit(f'{{"key":"{k}","value":{{"{kind}":'), v, F.lit("}}"))

    destination = F.when(
        F.col("event_type") != "view",
        F.concat(kv("dest.database", "stringValue", F.lit('"Logs"')), F.lit(","), kv("dest.table", "stringValue", q(F.col("event_type")))),
    ).otherwise(kv("dest.database", "stringValue", F.lit('"Logs"')))
    attributes = F.concat(
        destination, F.lit(","), kv("n", "intValue", q(eid)), F.lit(","), kv("ok", "boolValue", (F.col("event_id") % 2 == 0).cast("string"))
    )
    nested = F.concat(
        F.lit('{"kvlistValue":{"values":['), kv("u", "intValue", q(F.col("user_id").cast("string"))), F.lit(","),
        F.lit('{"key":"list","value":{"arrayValue":{"values":[{"stringValue":"a"},{"intValue":"'), eid, F.lit('"}]}}}]}}'),
    )
    flat = F.concat(
        F.lit('{"kvlistValue":{"values":['), kv("u", "intValue", q(F.col("user_id").cast("string"))), F.lit(","),
        kv("m", "stringValue", F.lit('"hi"')), F.lit("]}}"),
    )
    body = (
        F.when(F.col("event_id") % 4 == 0, nested)
        .when(F.col("event_id") % 4 == 1, flat)
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"intValue":"'), eid, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"stringValue":"line '), eid, F.lit('"}')))
    )
    record = F.concat(
        F.lit('{"timeUnixNano":"'), (F.unix_micros("ts") * 1000).cast("string"), F.lit('","severityNumber":9,"severityText":"INFO","body":'),
        body, F.lit(',"attributes":['), attributes, F.lit('],"traceId":"'), F.lpad(F.hex("event_id"), 32, "0"), F.lit('","spanId":"s"}'),
    )
    doc = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":['), kv("host", "stringValue", q(F.concat(F.lit("h"), F.col("user_id").cast("string")))),
        F.lit(']},"scopeLogs":[{"logRecords":['), record, F.lit("]}]}]}"),
    )
    return e.select("event_id", doc.alias("doc"))


@query(
    "S5_flatten_otlp_logs",
    """SELECT event_id, epoch_us(ts) * 1000 AS time_ns, 'Logs' AS database, event_type AS table_name,
      CASE event_id % 4 WHEN 0 THEN 'list=["a",' || CAST(event_id AS VARCHAR) || '];u=' || CAST(user_id AS VARCHAR) || ';'
        WHEN 1 THEN 'm=hi;u=' || CAST(user_id AS VARCHAR) || ';' WHEN 2 THEN 'message=' || CAST(event_id AS VARCHAR) || ';'
        ELSE 'message=line ' || CAST(event_id AS VARCHAR) || ';' END AS body,
      'host=h' || CAST(user_id AS VARCHAR) || ';' AS resource,
      'dest.database=Logs;dest.table=' || event_type || ';n=' || CAST(event_id AS VARCHAR) || ';ok=' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
        || ';sys_database=Logs;sys_table=' || event_type || ';' AS attributes
    FROM events WHERE event_type <> 'view'""",
)
def s5(spark, d):
    logs, _ = flatten_otlp_logs(log_documents(spark, d))

    def shown(c: str) -> Column:
        pairs = F.transform(
            F.map_entries(c),
            lambda e: F.concat(e["key"], F.lit("="), F.regexp_replace(F.to_json(e["value"]), '^"(.*)"$', "$1"), F.lit(";")),
        )
        return F.array_join(F.sort_array(pairs), "").alias(c)

    return logs.select(
        "event_id", "time_ns", "database", F.col("table").alias("table_name"), shown("body"), shown("resource"), shown("attributes")
    )


@query(
    "S5_flatten_otlp_logs_rejects",
    "SELECT event_id, 'destination database and table are missing' AS reason FROM events WHERE event_type = 'view'",
)
def s5_rejects(spark, d):
    return flatten_otlp_logs(log_documents(spark, d))[1].select("event_id", "reason")


@query(
    "L1_encode_otlp_logs",
    """SELECT epoch_us(ts) AS ts_us, 1706745600000000 AS observed_us, lower(lpad(printf('%x', event_id), 32, '0')) AS trace_id, 9 AS severity,
      CASE event_id % 4 WHEN 0 THEN '{"u":"' || CAST(user_id AS VARCHAR) || '","list":["a","' || CAST(event_id AS VARCHAR) || '"]}'
        WHEN 1 THEN '{"u":"' || CAST(user_id AS VARCHAR) || '","m":"hi"}' WHEN 2 THEN '"' || CAST(event_id AS VARCHAR) || '"'
        ELSE 'line ' || CAST(event_id AS VARCHAR) END AS body,
      '{"host":"h' || CAST(user_id AS VARCHAR) || '"}' AS resource,
      CASE WHEN event_type = 'view' THEN '{"dest.database":"Logs","n":"","ok":""}'
        ELSE '{"dest.database":"Logs","dest.table":"' || event_type || '","n":"","ok":""}' END AS attributes
    FROM events""",
)
def l1(spark, d):
    out = encode_otlp_logs(log_records(log_documents(spark, d)), now_ns=1_706_745_600_000_000_000)
    return out.select(
        F.unix_micros("Timestamp").alias("ts_us"), F.unix_micros("ObservedTimestamp").alias("observed_us"),
        F.lower("TraceId").alias("trace_id"), F.col("SeverityNumber").alias("severity"), F.col("Body").alias("body"),
        F.col("Resource").alias("resource"), F.col("Attributes").alias("attributes"),
    )


__all__ = ["log_documents", "metric_documents", "r6"]


def broken_documents(spark, d, document: str) -> DataFrame:
    """A document per event: sound ones, and each kind of unreadable one; ``document`` holds TIME for the event's time."""
    e = table(spark, d, "events")
    kind = F.col("event_id") % 6
    ns = (F.unix_micros("ts") * 1000).cast("string")
    good = F.replace(F.lit(document), F.lit("TIME"), ns)
    return e.select(
        "event_id",
        F.when(kind == 0, good)
        .when(kind == 1, F.substring_index(good, ":", 4))
        .when(kind == 2, F.lit(None).cast("string"))
        .when(kind == 3, F.concat(F.lit("["), good, F.lit("]")))
        .when(kind == 4, F.replace(F.lit(document), F.lit("TIME"), F.lit("noon")))
        .otherwise("{}")
        .alias("doc"),
    )


METRIC_DOCUMENT = (
    '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"level","gauge":{"dataPoints":[{"timeUnixNano":"TIME","asDouble":1.5,'
    '"attributes":[{"key":"berths","value":{"arrayValue":{"values":[{"stringValue":"a"},{"intValue":"2"}]}}}]}]}}]}]}]}'
)
LOG_DOCUMENT = (
    '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"TIME","body":{"stringValue":"x"},"attributes":['
    '{"key":"DATABASE","value":{"stringValue":"Db"}},{"key":"TABLE","value":{"stringValue":"Tab"}}]}]}]}]}'
).replace("DATABASE", DEFAULT_NAMING.dest_database).replace("TABLE", DEFAULT_NAMING.dest_table)
BROKEN_SQL = """SELECT CASE event_id % 6 WHEN 0 THEN 'read' WHEN 4 THEN 'time is not a number' ELSE 'document is not readable' END AS outcome, count(*) AS n
    FROM events WHERE event_id % 6 <> 5 GROUP BY 1"""


def _outcomes(read: DataFrame, rejects: DataFrame) -> DataFrame:
    both = read.select(F.lit("read").alias("outcome")).unionByName(rejects.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query("S4_unreadable_metrics", BROKEN_SQL)
def s4_unreadable(spark, d):
    return _outcomes(*flatten_otlp_metrics(broken_documents(spark, d, METRIC_DOCUMENT)))


@query("S5_unreadable_logs", BROKEN_SQL)
def s5_unreadable(spark, d):
    return _outcomes(*flatten_otlp_logs(broken_documents(spark, d, LOG_DOCUMENT)))


@query(
    "S4_nested_labels",
    """SELECT event_id, '{"values":[{"stringValue":"a"},{"intValue":"2"}]}' AS berths FROM events WHERE event_id % 6 = 0""",
)
def s4_nested(spark, d):
    samples, _ = flatten_otlp_metrics(broken_documents(spark, d, METRIC_DOCUMENT))
    return samples.select("event_id", F.col("labels")["berths"].alias("berths"))
