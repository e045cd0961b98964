"""Log shaping: encoding, destinations, routing, enrichment, reassembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.labels import literal_map, put_labels
from tidemark.functions.parsers import BODY_TYPE, body_text, parse_message
from tidemark.functions.timebin import epoch_to_nanos, epoch_to_timestamp
from tidemark.operators.slices import number_slice, with_running_count
from tidemark.schemas import DEFAULT_NAMING, Naming
from tidemark.sources.otlp_logs import encoded_body, record_destination, string_pairs

# Resource keys with these prefixes steer collection and are not stored. Fixed values.
UNSTORED_PREFIXES = ("label.", "annotation.")


def _observed(value: Column, now_ns: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(0)) > 0, value).otherwise(now_ns)


def _now(now_ns: int | Column | None) -> Column:
    if now_ns is None:
        return F.unix_micros(F.current_timestamp()) * F.lit(1000)
    return now_ns if isinstance(now_ns, Column) else F.lit(now_ns).cast("bigint")


def encode_otlp_logs(records: DataFrame, now_ns: int | Column | None = None, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Stored log rows of raw OpenTelemetry records (see ``log_records``)."""
    observed = _observed(F.col("observedTimeUnixNano").cast("bigint"), _now(now_ns))
    routed = record_destination(records, naming)
    return routed.select(
        epoch_to_timestamp(F.col("timeUnixNano").cast("bigint")).alias("Timestamp"),
        epoch_to_timestamp(observed).alias("ObservedTimestamp"),
        F.coalesce("traceId", F.lit("")).alias("TraceId"),
        F.coalesce("spanId", F.lit("")).alias("SpanId"),
        F.coalesce("severityText", F.lit("")).alias("SeverityText"),
        F.coalesce("severityNumber", F.lit(0)).alias("SeverityNumber"),
        encoded_body(F.col("body")).alias("Body"),
        string_pairs(F.col("resource_attributes")).alias("Resource"),
        string_pairs(F.col("attributes")).alias("Attributes"),
        epoch_to_nanos(F.col("timeUnixNano").cast("bigint")).alias("time_ns"),
        "database",
        "table",
    )


def encode_native_logs(
    df: DataFrame, lifted: list[str] | None = None, now_ns: int | Column | None = None, naming: Naming = DEFAULT_NAMING
) -> DataFrame:
    """Stored log rows of ``time_ns, observed_ns, body, attributes, resource`` rows.

    Internal and lifted keys leave the maps; lifted resources become string
    columns, empty when absent or not a text.
    """
    lifted = lifted or []
    names = F.array(*[F.lit(n) for n in lifted]) if lifted else F.array().cast("array<string>")

    def stored(key: Column) -> Column:
        keep = ~key.startswith(naming.reserved_prefix) & ~F.array_contains(names, key)
        for prefix in UNSTORED_PREFIXES:
            keep = keep & ~key.startswith(prefix)
        return keep

    def lifted_text(name: str) -> Column:
        value = F.col("resource")[name]
        is_text = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))
        return F.when(is_text, value.cast("string")).otherwise("").alias(name)

    kept = [c for c in ("database", "table") if c in df.columns]
    return df.select(
        epoch_to_timestamp(F.col("time_ns")).alias("Timestamp"),
        epoch_to_timestamp(_observed(F.col("observed_ns"), _now(now_ns))).alias("ObservedTimestamp"),
        *[F.lit("").alias(n) for n in ("TraceId", "SpanId", "SeverityText")],
        F.lit(None).cast("int").alias("SeverityNumber"),
        F.to_json("body").alias("Body"),
        F.to_json(F.map_filter("resource", lambda k, _: stored(k))).alias("Resource"),
        F.to_json(F.map_filter("attributes", lambda k, _: ~k.startswith(naming.reserved_prefix))).alias("Attributes"),
        epoch_to_nanos(F.col("time_ns")).alias("time_ns"),
        *[lifted_text(n) for n in sorted(lifted, key=str.lower)],
        *kept,
    )


def resolve_destination(
    df: DataFrame, naming: Naming = DEFAULT_NAMING, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Add ``database, table`` from the attributes, else from the body; rows lacking either are rejected.

    ``strict`` raises when every row is rejected, at the cost of running the job once for the check.
    """

    def found(key: str) -> Column:
        return F.coalesce(
            F.nullif(F.col("attributes")[key].cast("string"), F.lit("")),
            F.nullif(F.col("body")[key].cast("string"), F.lit("")),
        )

    resolved = df.withColumns({"database": found(naming.dest_database), "table": found(naming.dest_table)})
    ok = F.col("database").isNotNull() & F.col("table").isNotNull()
    accepted = resolved.filter(ok)
    if strict and accepted.isEmpty() and not df.isEmpty():
        raise ValueError("all log rows lack a destination database and table")
    return accepted, resolved.filter(~ok).withColumn("reason", F.lit("destination is missing"))


def parse_messages(
    df: DataFrame, parsers: list[str], message: str = "message", naming: Naming = DEFAULT_NAMING
) -> DataFrame:
    """Add ``body`` from the first parser of the list that accepts the message."""
    return df.withColumn("body", parse_message(F.col(message), parsers, naming))


def route_logs(df: DataFrame, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Set ``database, table`` from routing annotations in the resource.

    ``source:database:table`` entries match the body's source; after them
    ``key:value:database:table`` entries match a body member. The first match
    wins; entries with another number of parts are skipped. Rows without a match
    keep their destination.
    """

    def listed(key: str, size: int) -> Column:
        text = F.coalesce(F.col("resource")[key].cast("string"), F.lit(""))
        parts = F.transform(F.split(text, ","), lambda e: F.transform(F.split(e, ":"), lambda p: F.trim(p)))
        return F.filter(parts, lambda p: F.size(p) == size)

    body = F.col("body")
    by_source = F.filter(listed(naming.log_sources, 3), lambda p: F.get(p, F.lit(0)) == body_text(body, "source"))
    by_key = F.filter(
        listed(naming.log_keys, 4), lambda p: F.get(p, F.lit(1)) == body_text(body, F.get(p, F.lit(0)))
    )
    first = F.coalesce(F.get(by_source, F.lit(0)), F.slice(F.get(by_key, F.lit(0)), 2, 3))
    routed = df.withColumn("_dest", first)
    current = {n: (F.col(n) if n in df.columns else F.lit(None).cast("string")) for n in ("database", "table")}
    return routed.withColumns(
        {
            "database": F.coalesce(F.get("_dest", F.lit(1)), current["database"]),
            "table": F.coalesce(F.get("_dest", F.lit(2)), current["table"]),
        }
    ).drop("_dest")


def add_resources(
    df: DataFrame,
    values: dict[str, str],
    node_meta: DataFrame | None = None,
    label_mapping: dict[str, str] | None = None,
    annotation_mapping: dict[str, str] | None = None,
    key: str = "node",
) -> DataFrame:
    """Set resource values from node metadata, then static ones over them."""
    from tidemark.operators.relabel import enrich_labels

    if node_meta is not None:
        df = enrich_labels(df, node_meta, label_mapping or {}, annotation_mapping, key, "resource")
    if values:
        added = literal_map(values).cast(dict(df.dtypes)["resource"])
        df = df.withColumn("resource", put_labels(F.col("resource"), added))
    return df


def pod_targets(pods: DataFrame, static_targets: DataFrame | None = None, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Log files of pods with their destination and resource values.

    ``pods``: file, namespace, pod, container, container_id, labels, annotations,
    database, table. Pods without a destination of their own take the first
    static target (``id, namespace, name, labels, database, table``; empty fields
    match all) that fits. Static targets are matched by an equi-join on
    namespace, with the wildcard namespace as its own value.
    """
    routing = F.array(F.lit(naming.log_sources), F.lit(naming.log_keys))
    prefix = naming.log_sources.split("/")[0] + "/"
    annotations = F.map_filter("annotations", lambda k, _: ~k.startswith(prefix))
    resource = F.map_concat(
        F.create_map(
            F.lit("pod"), F.col("pod"), F.lit("namespace"), F.col("namespace"),
            F.lit("container"), F.col("container"), F.lit("containerID"), F.col("container_id"),
        ),
        F.map_filter("annotations", lambda k, _: F.array_contains(routing, k)),
        F.transform_keys(annotations, lambda k, _: F.concat(F.lit("annotation."), k)),
        F.transform_keys("labels", lambda k, _: F.concat(F.lit("label."), k)),
    )
    base = pods.filter(F.coalesce("container_id", F.lit("")) != "").withColumn("resource", resource)
    if static_targets is not None:
        wanted = static_targets.select(
            F.col("id").alias("_id"),
            F.col("namespace").alias("_ns"),
            F.col("name").alias("_name"),
            F.col("labels").alias("_labels"),
            F.struct("database", "table").alias("_dest"),
        )
        candidates = base.withColumn("_ns", F.explode(F.array(F.col("namespace"), F.lit(""))))
        fits = ((F.col("_name") == "") | (F.col("_name") == F.col("pod"))) & F.forall(
            F.map_entries("_labels"), lambda e: F.coalesce(F.col("labels")[e["key"]], F.lit("")) == e["value"]
        )
        matched = (
            candidates.join(wanted, "_ns").filter(fits).groupBy("file").agg(F.min_by("_dest", "_id").alias("_static"))
        )
        base = base.join(matched, "file", "left").withColumns(
            {
                "database": F.coalesce(F.nullif("database", F.lit("")), "_static.database"),
                "table": F.coalesce(F.nullif("table", F.lit("")), "_static.table"),
            }
        )
    return base.filter(F.col("database").isNotNull() & F.col("table").isNotNull()).select(
        "file", "database", "table", "resource"
    )


def enrich_pods(
    logs: DataFrame, pods: DataFrame, static_targets: DataFrame | None = None, naming: Naming = DEFAULT_NAMING
) -> DataFrame:
    """Log lines with the destination and resource values of the pod that owns their file."""
    return logs.join(pod_targets(pods, static_targets, naming), "file")


def apply_transforms(df: DataFrame, transforms: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User transforms in order; each maps a frame to a frame.

    A transform may be any DataFrame code, or ``df.mapInPandas`` / ``mapInArrow``
    for arbitrary batch functions.
    """
    for fn in transforms:
        df = df.transform(fn)
    return df


def _line_groups(df: DataFrame, keys: list[str], order: str, message: str, slice_width: int) -> DataFrame:
    numbered = with_running_count(df, keys, [order], ~F.col("is_partial"), number_slice(F.col(order), slice_width))
    return numbered.withColumn("_complete", F.col("_before") < F.col("_all"))


def _joined_text(group: DataFrame, keys: list[str], order: str, message: str, final: Column) -> DataFrame:
    grouped = group.groupBy(*keys, "_before").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(message).alias("m")))).alias("_parts"),
        F.max_by(final, order).alias("_final"),
    )
    text = F.array_join(F.transform("_parts", lambda p: p["m"]), "")
    return grouped.select(*keys, "_final.*", text.alias(message), F.size("_parts").alias("parts"))


def reassemble_lines(
    df: DataFrame, keys: list[str], order: str = "offset", message: str = "message", slice_width: int = 100_000
) -> DataFrame:
    """Join partial lines of a stream to the complete line that ends them.

    Lines after the last complete line of a stream are withheld. Each group is
    one message; its number is the count of complete lines before it, which is
    computed per slice of the stream, so a long stream is spread over tasks.
    """
    groups = _line_groups(df, keys, order, message, slice_width).filter("_complete")
    carried = [c for c in df.columns if c not in (*keys, message, "is_partial")]
    return _joined_text(groups, keys, order, message, F.struct(*carried))


def withheld_lines(
    df: DataFrame, keys: list[str], order: str = "offset", message: str = "message", slice_width: int = 100_000
) -> DataFrame:
    """The unfinished last message of each stream, with the position of its last part."""
    groups = _line_groups(df, keys, order, message, slice_width).filter("NOT _complete")
    return _joined_text(groups, keys, order, message, F.struct(order))


__all__ = [
    "BODY_TYPE",
    "add_resources",
    "apply_transforms",
    "encode_native_logs",
    "encode_otlp_logs",
    "enrich_pods",
    "parse_messages",
    "pod_targets",
    "reassemble_lines",
    "resolve_destination",
    "route_logs",
    "withheld_lines",
]
