"""Table shapes shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())
BODY = T.MapType(T.StringType(), T.VariantType())

# Stored column names and types, in stored order. Fixed values.
METRICS_COLUMNS = [
    ("Timestamp", "datetime"),
    ("SeriesId", "long"),
    ("Labels", "dynamic"),
    ("Value", "real"),
]
LOGS_COLUMNS = [
    ("Timestamp", "datetime"),
    ("ObservedTimestamp", "datetime"),
    ("TraceId", "string"),
    ("SpanId", "string"),
    ("SeverityText", "string"),
    ("SeverityNumber", "int"),
    ("Body", "dynamic"),
    ("Resource", "dynamic"),
    ("Attributes", "dynamic"),
]

# Column types a typed header may name, with the Spark type and the value of an empty cell.
HEADER_TYPES = {
    "datetime": ("timestamp", "timestamp_micros(0)"),
    "long": ("bigint", "0L"),
    "int": ("int", "0"),
    "real": ("double", "0D"),
    "string": ("string", "''"),
    "dynamic": ("string", "''"),
}

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("SeriesId", T.LongType()),
        T.StructField("Labels", LABELS),
        T.StructField("Value", T.DoubleType()),
    ]
)
LOGS_SCHEMA = T.StructType(
    [
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("ObservedTimestamp", T.TimestampType()),
        T.StructField("TraceId", T.StringType()),
        T.StructField("SpanId", T.StringType()),
        T.StructField("SeverityText", T.StringType()),
        T.StructField("SeverityNumber", T.IntegerType()),
        T.StructField("Body", T.StringType()),
        T.StructField("Resource", T.StringType()),
        T.StructField("Attributes", T.StringType()),
    ]
)
NOTIFICATION_SCHEMA = T.StructType(
    [
        T.StructField("destination", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("custom_fields", LABELS),
    ]
)


@dataclass(frozen=True)
class Naming:
    """Names a deployment chooses for routing and internal labels.

    ``reserved_prefix`` marks labels and attributes that steer routing and are
    never stored. ``dest_*`` are the attribute names senders use to name the
    target database and table.
    """

    name_label: str = "__name__"
    reserved_prefix: str = "sys_"
    dest_database: str = "dest.database"
    dest_table: str = "dest.table"
    log_sources: str = "route/log-sources"
    log_keys: str = "route/log-keys"
    message_key: str = "message"

    @property
    def database(self) -> str:
        return self.reserved_prefix + "database"

    @property
    def namespace(self) -> str:
        return self.reserved_prefix + "namespace"

    @property
    def pod(self) -> str:
        return self.reserved_prefix + "pod"

    @property
    def container(self) -> str:
        return self.reserved_prefix + "container"

    @property
    def identity(self) -> list[str]:
        return [self.namespace, self.pod, self.container]


DEFAULT_NAMING = Naming()


def header_of(columns: list[tuple[str, str]]) -> str:
    """Typed header line of a table: ``Name:type,Name:type``."""
    return ",".join(f"{name}:{kind}" for name, kind in columns)


def with_lifted(columns: list[tuple[str, str]], lifted: list[str]) -> list[tuple[str, str]]:
    """Core columns followed by one string column per lifted field, in name order."""
    return columns + [(name, "string") for name in sorted(lifted, key=str.lower)]
