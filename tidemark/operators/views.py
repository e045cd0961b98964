"""Custom-schema views over log tables and trace views over span logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.once import compute_once, parse_once
from tidemark.functions.timebin import in_window, rfc3339_to_timestamp
from tidemark.operators.aggregate import project_paths


def _sql_text(text: str) -> str:
    """SQL literal of a text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_log_view(
    spark: SparkSession, name: str, logs: DataFrame, mapping: dict[str, tuple[str, str, str]], catalog_schema: str | None = None
) -> DataFrame:
    """Register a view that reads columns from JSON members of a log table.

    ``mapping`` is ``{column: (log column, path, type)}``. With ``catalog_schema``
    ``logs`` must be backed by a table and the view is stored in that schema
    under the table's own name; otherwise it is a session view.
    """
    view = project_paths(logs, mapping)
    if catalog_schema is None:
        view.createOrReplaceTempView(name)
        return spark.table(name)
    columns = ", ".join(
        f"try_cast(try_variant_get(try_parse_json({column}), {_sql_text(path)}, 'string') AS {kind}) AS `{out}`"
        for out, (column, path, kind) in mapping.items()
    )
    spark.sql(f"CREATE OR REPLACE VIEW {catalog_schema}.`{name}` AS SELECT {columns} FROM `{name}`")
    return spark.table(f"{catalog_schema}.`{name}`")


# Members of a span document. Fixed values.
SPAN_DOCUMENT = (
    "struct<Name:string,SpanContext:struct<TraceID:string,SpanID:string>,Parent:struct<SpanID:string>,"
    "StartTime:string,EndTime:string,Attributes:string,Resource:map<string,string>>"
)
TRACE_ID_PATH = "$.SpanContext.TraceID"


def trace_spans(
    logs: DataFrame, trace_id: str | None = None, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Spans of a trace: ids, service, operation, start, duration in microseconds and tags.

    The log table's own TraceId column, when filled, narrows the scan before any
    JSON is read.
    """
    rows = logs
    if start is not None and end is not None:
        rows = rows.filter(in_window(F.col("Timestamp"), start, end))
    if trace_id is not None:
        own = F.col("TraceId")  # plain comparisons reach the file filters
        rows = rows.filter((own == trace_id) | (own == "") | own.isNull())
    read = parse_once(rows.select("Timestamp", "Body"), F.from_json("Body", SPAN_DOCUMENT))
    if trace_id is not None:
        read = read.filter(F.col("SpanContext.TraceID") == trace_id)
    timed = compute_once(
        read, _start=rfc3339_to_timestamp(F.col("StartTime")), _end=rfc3339_to_timestamp(F.col("EndTime"))
    )
    return timed.select(
        F.col("Timestamp").alias("timestamp"),
        F.col("SpanContext.TraceID").alias("traceID"),
        F.col("SpanContext.SpanID").alias("spanID"),
        F.col("Parent.SpanID").alias("parentSpanID"),
        F.col("Resource")["service.name"].alias("serviceName"),
        F.col("Name").alias("operationName"),
        F.col("_start").alias("startTime"),
        (F.unix_micros("_end") - F.unix_micros("_start")).alias("duration"),
        F.col("Attributes").alias("tags"),
    )


def trace_ids(logs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Distinct trace ids of the spans in a time range."""
    trace = F.get_json_object("Body", TRACE_ID_PATH)
    return logs.filter(in_window(F.col("Timestamp"), start, end)).select(trace.alias("traceID")).distinct()
