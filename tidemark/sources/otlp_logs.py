"""OpenTelemetry log documents (JSON form) to log rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tidemark.functions.once import compute_once
from tidemark.schemas import DEFAULT_NAMING, Naming
from tidemark.sources.otlp_metrics import unreadable

SCALARS = "stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string"
# Values inside an attribute list: scalars are typed, nested values stay variants.
ANY_VALUE = f"struct<{SCALARS},arrayValue:variant,kvlistValue:variant>"
KEY_VALUES = f"array<struct<key:string,value:{ANY_VALUE}>>"
BODY_VALUE = f"struct<{SCALARS},arrayValue:variant,kvlistValue:struct<values:{KEY_VALUES}>>"
LOG_RECORD = (
    "struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,"
    f"body:{BODY_VALUE},attributes:{KEY_VALUES},traceId:string,spanId:string>"
)
LOGS_DOCUMENT = (
    f"struct<resourceLogs:array<struct<resource:struct<attributes:{KEY_VALUES}>,"
    f"scopeLogs:array<struct<logRecords:array<{LOG_RECORD}>>>>>>"
)
BODY_TYPE = "map<string,variant>"

# Nesting kept when flattening and when encoding text.
FLATTEN_DEPTH = 20
ENCODE_DEPTH = 100


def log_records(df: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per log record, with the attributes of its resource copied onto it."""
    carried = [c for c in df.columns if c != doc]
    parsed = F.from_json(F.col(doc), LOGS_DOCUMENT)
    per_resource = df.select(*carried, F.explode(parsed["resourceLogs"]).alias("rl"))
    records = F.flatten(F.transform(F.col("rl.scopeLogs"), lambda s: s["logRecords"]))
    per_record = per_resource.select(
        *carried, F.col("rl.resource.attributes").alias("resource_attributes"), F.explode(records).alias("r")
    )
    return per_record.select(*carried, "resource_attributes", "r.*")


def unreadable_documents(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows whose document cannot be read, without it, in the form of the other rejects."""
    content = F.from_json(F.col(doc), "resourceLogs variant")["resourceLogs"]
    carried = [c for c in df.columns if c != doc]
    return df.filter(unreadable(F.col(doc), content)).select(
        *carried, F.lit(None).cast("string").alias("timeUnixNano"), F.lit("document is not readable").alias("reason")
    )


def bad_time() -> Column:
    """Whether a time of a record is given but is not a number."""
    return (F.col("timeUnixNano").isNotNull() & F.col("timeUnixNano").try_cast("bigint").isNull()) | (
        F.col("observedTimeUnixNano").isNotNull() & F.col("observedTimeUnixNano").try_cast("bigint").isNull()
    )


def _is_nested(value: Column) -> Column:
    return value["kvlistValue"].isNotNull() | value["arrayValue"].isNotNull()


def _scalar(value: Column) -> Column:
    """Variant of a scalar any-value, null for nested and empty ones."""
    return F.coalesce(
        value["stringValue"].cast("variant"),
        value["boolValue"].cast("variant"),
        value["intValue"].try_cast("bigint").cast("variant"),
        value["doubleValue"].cast("variant"),
        value["bytesValue"].cast("variant"),
    )


@pandas_udf(T.StringType())
def _flatten_nested(values: pd.Series) -> pd.Series:
    """Plain JSON of nested any-values; rows with scalar values arrive as nulls and cost nothing."""

    def plain(value, depth=0):
        if depth > FLATTEN_DEPTH:
            return "..."
        if "kvlistValue" in value:
            pairs = value["kvlistValue"].get("values", [])
            return {p["key"]: plain(p["value"], depth + 1) for p in pairs if p.get("value")}
        if "arrayValue" in value:
            return [plain(v, depth + 1) for v in value["arrayValue"].get("values", []) if v]
        for kind, scalar in value.items():
            return int(scalar) if kind == "intValue" else scalar
        return None

    return values.map(lambda v: v if v is None else json.dumps(plain(json.loads(v)), ensure_ascii=False))


@pandas_udf(T.StringType())
def _encode_nested(values: pd.Series) -> pd.Series:
    """JSON text of nested any-values with scalar members in text form."""

    def text(value, depth=0):
        if depth > ENCODE_DEPTH:
            return "..."
        if "kvlistValue" in value:
            pairs = value["kvlistValue"].get("values", [])
            return {p["key"]: text(p.get("value", {}), depth + 1) for p in pairs}
        if "arrayValue" in value:
            return [text(v, depth + 1) for v in value["arrayValue"].get("values", [])]
        for kind, scalar in value.items():
            if kind == "boolValue":
                return "true" if scalar else "false"
            return str(scalar)
        return ""

    def encoded(v):
        return json.dumps(text(json.loads(v)), ensure_ascii=False, separators=(",", ":"))

    return values.map(lambda v: v if v is None else encoded(v))


def _listed(pairs: Column) -> Column:
    return F.coalesce(pairs, F.array().cast(KEY_VALUES))


def _any_nested(pairs: Column) -> Column:
    return F.exists(_listed(pairs), lambda a: _is_nested(a["value"]))


def _wrapped(pairs: Column) -> Column:
    """Attribute list in the text form of one key-value any-value, when any member is nested."""
    body = F.struct(F.struct(pairs.alias("values")).alias("kvlistValue"))
    return F.when(_any_nested(pairs), F.to_json(body))


def _scalar_map(pairs: Column) -> Column:
    converted = F.transform(
        _listed(pairs), lambda a: F.struct(a["key"].alias("key"), _scalar(a["value"]).alias("value"))
    )
    return F.map_from_entries(F.filter(converted, lambda e: e["value"].isNotNull()))


def _as_map(json_text: Column) -> Column:
    return F.parse_json(json_text).cast(BODY_TYPE)


def _string_member(pairs: Column, key: str) -> Column:
    """Last non-empty string value of a key in an attribute list."""
    found = F.filter(
        _listed(pairs), lambda a: (a["key"] == key) & (F.coalesce(a["value"]["stringValue"], F.lit("")) != "")
    )
    return F.get(found, F.size(found) - 1)["value"]["stringValue"]


def record_destination(df: DataFrame, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Add ``database`` and ``table`` of raw records: attributes first, then a map body."""
    pairs, body = F.col("attributes"), F.col("body.kvlistValue.values")

    def found(key: str) -> Column:
        return F.coalesce(_string_member(pairs, key), _string_member(body, key))

    return compute_once(df, database=found(naming.dest_database), table=found(naming.dest_table))


def flatten_otlp_logs(
    df: DataFrame, doc: str = "doc", naming: Naming = DEFAULT_NAMING
) -> tuple[DataFrame, DataFrame]:
    """Log rows with flattened body, attributes and resource, and what was not read: documents, and
    records without a destination or with a bad time.

    Scalar values are converted natively. Rows with nested values send only
    those to a small Arrow function; the others send nulls.
    """
    records = record_destination(log_records(df, doc), naming)
    routed = F.col("database").isNotNull() & F.col("table").isNotNull()
    ok = routed & ~bad_time()
    carried = [c for c in df.columns if c != doc]
    body, pairs = F.col("body"), F.col("body.kvlistValue.values")
    is_map = F.col("body.kvlistValue").isNotNull()
    nested_body = F.when(F.col("body.arrayValue").isNotNull() | (is_map & _any_nested(pairs)), F.to_json(body))
    flat = records.filter(ok).withColumns(
        {
            "_body": _flatten_nested(nested_body),
            "_attributes": _flatten_nested(_wrapped(F.col("attributes"))),
            "_resource": _flatten_nested(_wrapped(F.col("resource_attributes"))),
        }
    )

    def flat_map(nested: str, source: str) -> Column:
        return F.when(F.col(nested).isNotNull(), _as_map(F.col(nested))).otherwise(_scalar_map(F.col(source)))

    message = F.coalesce(F.parse_json("_body"), _scalar(body))
    flat_body = (
        F.when(is_map & F.col("_body").isNotNull(), _as_map(F.col("_body")))
        .when(is_map, _scalar_map(pairs))
        .when(message.isNotNull(), F.create_map(F.lit(naming.message_key), message))
        .otherwise(F.create_map().cast(BODY_TYPE))
    )
    routing = F.create_map(
        F.lit(naming.database),
        F.col("database").cast("variant"),
        F.lit(naming.reserved_prefix + "table"),
        F.col("table").cast("variant"),
    )
    logs = flat.select(
        *carried,
        F.col("timeUnixNano").try_cast("bigint").alias("time_ns"),
        F.coalesce(F.col("observedTimeUnixNano").try_cast("bigint"), F.lit(0).cast("bigint")).alias("observed_ns"),
        flat_body.alias("body"),
        F.map_concat(flat_map("_attributes", "attributes"), routing).alias("attributes"),
        flat_map("_resource", "resource_attributes").alias("resource"),
        "database",
        "table",
    )
    rejects = records.filter(~ok).select(
        *carried,
        "timeUnixNano",
        F.when(~routed, F.lit("destination database and table are missing")).otherwise(F.lit("time is not a number")).alias("reason"),
    )
    return logs, rejects.unionByName(unreadable_documents(df, doc))


def _quoted(c: Column) -> Column:
    """JSON string literal of a text."""
    listed = F.to_json(F.array(c))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def encoded_body(body: Column) -> Column:
    """Text of an any-value body: strings verbatim, maps and lists as JSON, other scalars quoted."""
    nested = _encode_nested(F.when(_is_nested(body), F.to_json(body)))
    other = F.coalesce(body["boolValue"].cast("string"), body["intValue"], body["doubleValue"].cast("string"), F.lit(""))
    return F.coalesce(nested, body["stringValue"], _quoted(other))


def string_pairs(pairs: Column) -> Column:
    """JSON object of an attribute list keeping string values; others become empty texts."""
    texts = F.transform(
        _listed(pairs), lambda a: F.struct(a["key"], F.coalesce(a["value"]["stringValue"], F.lit("")))
    )
    return F.to_json(F.map_from_entries(texts))
