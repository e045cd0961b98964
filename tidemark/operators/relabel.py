"""Metric relabelling and routing over ``name, labels, value, ts`` rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.labels import any_regex, ascii_lower, entries, label_text, literal_map, put_labels, series_id
from tidemark.functions.names import metric_table_name, normalize_identifier
from tidemark.schemas import DEFAULT_NAMING, METRICS_COLUMNS, Naming, header_of, with_lifted


@dataclass(frozen=True)
class MetricFilter:
    """Drop and keep rules. Patterns match anywhere in the text."""

    default_drop: bool = False
    drop: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    keep_by_label: list[tuple[str, str]] = field(default_factory=list)


def metric_kept(cfg: MetricFilter, name: Column, labels: Column) -> Column:
    """Predicate of the rules.

    Drop rules always win. The keep lists matter only when metrics are dropped by default.
    """
    kept = ~any_regex(name, cfg.drop)
    if not cfg.default_drop:
        return kept
    wanted = any_regex(name, cfg.keep)
    if cfg.keep_by_label:

        def label_matches(e: Column) -> Column:
            found = F.lit(False)
            for label_pattern, value_pattern in cfg.keep_by_label:
                found = found | (e["key"].rlike(label_pattern) & e["value"].rlike(value_pattern))
            return found

        wanted = wanted | F.exists(F.map_entries(labels), label_matches)
    return kept & wanted


def filter_metrics(df: DataFrame, cfg: MetricFilter) -> DataFrame:
    """Rows the rules keep."""
    return df.filter(metric_kept(cfg, F.col("name"), F.col("labels")))


def allow_databases(df: DataFrame, databases: list[str], naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Rows whose database label is listed; an empty list allows all."""
    if not databases:
        return df
    return df.filter(F.coalesce(F.col("labels")[naming.database], F.lit("")).isin(databases))


def drop_labels(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Remove labels whose name matches a rule's label pattern when the metric matches its metric pattern."""

    def survives(key: Column, _: Column) -> Column:
        dropped = F.lit(False)
        for metric_pattern, label_pattern in rules:
            dropped = dropped | (F.col("name").rlike(metric_pattern) & key.rlike(label_pattern))
        return ~dropped

    return df.withColumn("labels", F.map_filter("labels", survives)) if rules else df


def add_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Set static labels."""
    return df.withColumn("labels", put_labels(F.col("labels"), literal_map(labels))) if labels else df


def enrich_labels(
    df: DataFrame,
    node_meta: DataFrame,
    label_mapping: dict[str, str],
    annotation_mapping: dict[str, str] | None = None,
    key: str = "node",
    column: str = "labels",
) -> DataFrame:
    """Set labels from node metadata (``node, labels, annotations``); missing values become empty.

    The metadata side is broadcast by the planner while its size allows; beyond
    that the join shuffles and the adaptive skew join splits hot nodes.
    """
    meta = node_meta.select(F.col(key), F.col("labels").alias("_nl"), F.col("annotations").alias("_na"))
    pairs: list[Column] = []
    for source, mapping in (("_nl", label_mapping), ("_na", annotation_mapping or {})):
        for src, dest in sorted(mapping.items()):
            pairs += [F.lit(dest), F.coalesce(F.col(source)[src], F.lit(""))]
    if not pairs:
        return df
    joined = df.join(meta, key, "left")
    value_type = dict(df.dtypes)[column]
    added = F.create_map(*pairs).cast(value_type)
    return joined.withColumn(column, put_labels(F.col(column), added)).drop("_nl", "_na")


def attach_target(df: DataFrame, targets: DataFrame, key: str = "target", naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Set the namespace, pod and container labels of the scraped target.

    Incoming labels with those reserved names, or the database label, are
    discarded; empty target fields set no label.
    """
    reserved = F.array(*[F.lit(n) for n in naming.identity + [naming.database]])
    sides = targets.select(
        key, F.col("namespace").alias("_ns"), F.col("pod").alias("_pod"), F.col("container").alias("_ctr")
    )
    joined = df.join(sides, key, "left")
    identity = F.create_map(
        F.lit(naming.namespace), F.col("_ns"), F.lit(naming.pod), F.col("_pod"), F.lit(naming.container), F.col("_ctr")
    )
    present = F.map_filter(identity, lambda _, v: F.coalesce(v, F.lit("")) != "")
    own = F.map_filter("labels", lambda k, _: ~F.array_contains(reserved, k))
    return joined.withColumn("labels", F.map_concat(own, present)).drop("_ns", "_pod", "_ctr")


def with_series_id(df: DataFrame, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Add ``series_id`` over the name and all labels in canonical order."""
    return df.withColumn("series_id", series_id(entries(F.col("name"), F.col("labels"), naming)))


def lift_labels(df: DataFrame, fields: list[str], naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Promote labels to string columns and remove them, and internal labels, from the map.

    Matching ignores case; an absent label gives an empty text.
    """
    lowered = [f.lower() for f in fields]
    lifted = F.array(*[F.lit(f) for f in lowered]) if fields else F.array().cast("array<string>")
    folded = F.transform_keys("labels", lambda k, _: ascii_lower(k))
    columns = {f: F.coalesce(folded[low], F.lit("")) for f, low in zip(fields, lowered)}
    columns["labels"] = F.map_filter(
        "labels",
        lambda k, _: ~F.array_contains(lifted, ascii_lower(k))
        & ~k.startswith(naming.reserved_prefix)
        & (k != naming.name_label),
    )
    return df.withColumns(columns)


def schema_id(columns: list[tuple[str, str]]) -> Column:
    """Identity of a column list: unsigned xxHash64 of names and types, in base 36."""
    from tidemark.functions.labels import xxhash64_seed0

    text = "".join(name + kind for name, kind in columns)
    unsigned = F.conv(F.hex(xxhash64_seed0(F.lit(text))), 16, 36)
    return F.lower(unsigned)


def route_metrics(
    df: DataFrame, lifted: list[str] | None = None, naming: Naming = DEFAULT_NAMING
) -> tuple[DataFrame, DataFrame]:
    """Add ``database, table, schema_id``; rows without a database label or name are rejected."""
    database = F.coalesce(F.col("labels")[naming.database], F.lit(""))
    name = F.coalesce(F.col("name"), F.lit(""))
    ok = (database != "") & (name != "")
    columns = with_lifted(METRICS_COLUMNS, lifted or [])
    routed = df.filter(ok).withColumns(
        {
            "database": normalize_identifier(database),
            "table": metric_table_name(name),
            "schema_id": schema_id(columns),
        }
    )
    rejects = df.filter(~ok).withColumn(
        "reason",
        F.when(database == "", F.lit("database label not found")).otherwise(F.lit("name label not found")),
    )
    return routed, rejects


def drop_destinations(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Remove rows whose ``database_table`` starts with a prefix."""
    target = F.concat_ws("_", "database", "table")
    dropped = F.lit(False)
    for prefix in prefixes:
        dropped = dropped | target.startswith(prefix)
    return df.filter(~dropped)


def to_metrics_table(df: DataFrame, lifted: list[str] | None = None, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Stored shape: ``Timestamp, SeriesId, Labels, Value`` plus lifted columns."""
    shaped = lift_labels(with_series_id(df, naming), lifted or [], naming)
    keep = [c for c in ("database", "table", "schema_id") if c in df.columns]
    return shaped.select(
        F.col("ts").alias("Timestamp"),
        F.col("series_id").alias("SeriesId"),
        F.col("labels").alias("Labels"),
        F.col("value").alias("Value"),
        *sorted(lifted or [], key=str.lower),
        *keep,
    )


__all__ = [
    "MetricFilter",
    "add_labels",
    "allow_databases",
    "attach_target",
    "drop_destinations",
    "drop_labels",
    "enrich_labels",
    "filter_metrics",
    "header_of",
    "label_text",
    "lift_labels",
    "metric_kept",
    "route_metrics",
    "schema_id",
    "to_metrics_table",
    "with_series_id",
]
