"""Grouped export documents: OpenTelemetry gauges and tagged forward batches.

A group never becomes one unbounded document. It is cut into time slices, and a
slice into chunks of at most ``max_entries`` entries and some ``max_bytes`` bytes,
before its rows are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timebin import MICROS, bin_micros, floor_div
from tidemark.operators.slices import with_running_count
from tidemark.schemas import DEFAULT_NAMING, Naming

SLICE_SECONDS = 3600
MAX_ENTRIES = 10_000
MAX_BYTES = 16 * 1024 * 1024
POINT_BYTES = 96  # of a point besides its attributes


SUB_SLICES = 60


def _chunked(
    df: DataFrame, keys: list[str], order: list[str], micros: Column, slice_seconds: int, max_entries: int | Column,
    size: Column | None = None, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Add the time slice of each row and its chunk inside the slice.

    The position inside a slice is counted per sub-slice, so a tag or series
    that fills a whole slice is still numbered by many tasks. With ``size`` the bytes
    before a row are counted as well; a chunk ends where either count fills up.
    """
    sliced = df.withColumn("_begin", bin_micros(micros, slice_seconds))
    sub = floor_div(micros, max(1, slice_seconds * MICROS // SUB_SLICES))
    numbered = with_running_count(sliced, [*keys, "_begin"], order, F.lit(True), sub)
    numbered = numbered.withColumn("chunk", floor_div(F.col("_before"), max_entries).cast("int")).drop("_before", "_all")
    if size is None:
        return numbered
    weighed = with_running_count(numbered, [*keys, "_begin"], order, size, sub)
    full = floor_div(F.col("_before"), max_bytes).cast("int")
    return weighed.withColumn("chunk", F.col("chunk") + full).drop("_before", "_all")


def merged_attributes(cluster_labels: dict[str, str], added: dict[str, str]) -> dict[str, str]:
    """Resource attributes: cluster labels, overridden by the explicit ones."""
    return {**cluster_labels, **added}


def _attribute_list(pairs: Column) -> Column:
    return F.transform(
        pairs, lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value"))
    )


def to_otlp_gauges(
    samples: DataFrame, resource_attrs: dict[str, str], naming: Naming = DEFAULT_NAMING,
    slice_seconds: int = SLICE_SECONDS, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Gauge documents per metric and label set: ``name, slice_start, chunk, points, doc``.

    Internal labels are removed and milliseconds become nanoseconds.
    """
    public = F.map_filter(
        "labels", lambda k, _: (k != naming.name_label) & ~k.startswith(naming.reserved_prefix)
    )
    pairs = F.sort_array(F.map_entries(public))
    rows = samples.select("name", pairs.alias("_attrs"), F.unix_millis("ts").alias("_ms"), "value")
    # All points of a document carry the same attributes, so a count bounds its bytes.
    point_bytes = F.octet_length(F.to_json(_attribute_list(F.col("_attrs")))) + POINT_BYTES
    entries = F.greatest(F.lit(1), F.least(F.lit(max_entries), floor_div(F.lit(max_bytes), point_bytes)))
    micros = F.col("_ms") * F.lit(1000)
    chunked = _chunked(rows, ["name", "_attrs"], ["_ms", "value"], micros, slice_seconds, entries)
    grouped = chunked.groupBy("name", "_attrs", "_begin", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("_ms", "value"))).alias("_points")
    )
    points = F.transform(
        "_points",
        lambda p: F.struct(
            _attribute_list(F.col("_attrs")).alias("attributes"),
            (p["_ms"] * F.lit(1_000_000)).cast("string").alias("timeUnixNano"),
            p["value"].alias("asDouble"),
        ),
    )
    shared = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.struct(F.lit(v).alias("stringValue")).alias("value"))
            for k, v in sorted(resource_attrs.items())
        ]
    )
    metric = F.struct(F.col("name").alias("name"), F.struct(points.alias("dataPoints")).alias("gauge"))
    scope = F.struct(F.array(metric).alias("metrics"))
    resource = F.struct(F.struct(shared.alias("attributes")).alias("resource"), F.array(scope).alias("scopeMetrics"))
    document = F.struct(F.array(resource).alias("resourceMetrics"))
    return grouped.select(
        "name",
        F.timestamp_micros("_begin").alias("slice_start"),
        "chunk",
        F.size("_points").alias("points"),
        F.to_json(document).alias("doc"),
    )


def group_by_tag(
    logs: DataFrame, tag_attr: str, slice_seconds: int = SLICE_SECONDS, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Forward batches per tag: ``tag, slice_start, chunk, entries``; rows without the tag are ignored.

    An entry is (seconds, nanoseconds, body as JSON).
    """
    tag = F.coalesce(F.col("attributes")[tag_attr].cast("string"), F.lit(""))
    nanos = F.pmod("time_ns", F.lit(1_000_000_000).cast("bigint"))
    rows = logs.select(
        tag.alias("tag"),
        "time_ns",
        F.call_function("div", F.col("time_ns") - nanos, F.lit(1_000_000_000).cast("bigint")).alias("seconds"),
        nanos.alias("nanos"),
        F.to_json("body").alias("body"),
    ).filter(F.col("tag") != "")
    micros = F.col("seconds") * F.lit(1_000_000)
    size = F.octet_length("body")
    chunked = _chunked(rows, ["tag"], ["time_ns", "body"], micros, slice_seconds, max_entries, size, max_bytes)
    return (
        chunked.groupBy("tag", "_begin", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("seconds", "nanos", "body"))).alias("entries"))
        .select("tag", F.timestamp_micros("_begin").alias("slice_start"), "chunk", "entries")
    )
