"""Trace spans as log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.timebin import nanos_to_rfc3339, nanos_to_timestamp
from tidemark.schemas import DEFAULT_NAMING, Naming

# Ids of an absent parent.
NO_TRACE = "0" * 32
NO_SPAN = "0" * 16


def hex_id(c, width: int):
    """Lower-case hexadecimal id of fixed width; texts are padded, numbers converted."""
    return F.lpad(F.lower(c), width, "0")


def spans_to_logs(spans: DataFrame, database: str = "Logs", table: str = "Traces", naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Log rows whose body is the span document.

    ``spans``: trace_id, span_id, parent_span_id (hex texts, parent may be null),
    name, kind, start_ns, end_ns, attributes, resource (string maps),
    status_code, status_description, events (list of name, time_ns, attributes).
    """
    trace_id = hex_id(F.col("trace_id"), 32)
    span_id = hex_id(F.col("span_id"), 16)
    has_parent = F.col("parent_span_id").isNotNull()
    event = F.transform(
        "events",
        lambda e: F.struct(
            F.when(F.size(e["attributes"]) > 0, e["attributes"]).alias("Attributes"),
            e["name"].alias("Name"),
            nanos_to_rfc3339(e["time_ns"]).alias("Time"),
        ),
    )
    flags = F.lit("01")
    document = F.struct(
        F.when(F.size("attributes") > 0, F.col("attributes")).alias("Attributes"),
        nanos_to_rfc3339(F.col("end_ns")).alias("EndTime"),
        F.when(F.size("events") > 0, event).alias("Events"),
        F.col("name").alias("Name"),
        F.struct(
            F.when(has_parent, hex_id(F.col("parent_span_id"), 16)).otherwise(NO_SPAN).alias("SpanID"),
            F.when(has_parent, flags).otherwise("00").alias("TraceFlags"),
            F.when(has_parent, trace_id).otherwise(NO_TRACE).alias("TraceID"),
        ).alias("Parent"),
        F.when(F.size("resource") > 0, F.col("resource")).alias("Resource"),
        F.struct(span_id.alias("SpanID"), flags.alias("TraceFlags"), trace_id.alias("TraceID")).alias("SpanContext"),
        F.col("kind").alias("SpanKind"),
        nanos_to_rfc3339(F.col("start_ns")).alias("StartTime"),
        F.struct(
            F.col("status_code").alias("Code"), F.coalesce("status_description", F.lit("")).alias("Description")
        ).alias("Status"),
    )
    attributes = F.create_map(
        F.lit(naming.dest_database),
        F.lit(database),
        F.lit(naming.dest_table),
        F.lit(table),
        F.lit("span.id"),
        span_id,
        F.lit("span.kind"),
        F.col("kind"),
        F.lit("span.name"),
        F.col("name"),
        F.lit("trace.id"),
        trace_id,
    )
    return spans.select(
        nanos_to_timestamp(F.col("end_ns")).alias("Timestamp"),
        F.col("end_ns").alias("time_ns"),
        trace_id.alias("TraceId"),
        span_id.alias("SpanId"),
        F.lit("INFO").alias("SeverityText"),
        F.lit(9).alias("SeverityNumber"),
        F.to_json(document).alias("Body"),
        F.to_json(F.coalesce("resource", F.create_map().cast("map<string,string>"))).alias("Resource"),
        F.to_json(attributes).alias("Attributes"),
        F.lit(database).alias("database"),
        F.lit(table).alias("table"),
    )
