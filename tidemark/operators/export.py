"""Query results to metrics and series."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.labels import entries
from tidemark.functions.names import metric_name, normalize_metric_name
from tidemark.functions.once import compute_once
from tidemark.functions.timebin import rfc3339_to_timestamp
from tidemark.schemas import DEFAULT_NAMING, Naming

NUMERIC_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)inf(inity)?|(?i)nan)$"


@dataclass(frozen=True)
class MetricExport:
    """How the columns of a query result become metrics."""

    value_columns: list[str]
    metric_name_column: str = ""
    default_metric_name: str = ""
    prefix: str = ""
    global_prefix: str = ""
    timestamp_column: str = ""
    label_columns: list[str] = field(default_factory=list)

    @property
    def effective_prefix(self) -> str:
        return "_".join(p for p in (self.global_prefix, self.prefix) if p)


def check_export(df: DataFrame, cfg: MetricExport) -> None:
    """Check the configuration against the result's schema before any row is read."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not cfg.value_columns:
        raise ValueError("at least one value column must be specified")
    for column in cfg.value_columns:
        if column not in kinds:
            raise ValueError(f"value column {column!r} not found in query results")
        if not isinstance(kinds[column], (T.NumericType, T.StringType)):
            raise ValueError(f"value column {column!r} contains non-numeric type {kinds[column].simpleString()}")
    if cfg.metric_name_column:
        if cfg.metric_name_column not in kinds:
            raise ValueError(f"metric name column {cfg.metric_name_column!r} not found in query results")
        if not isinstance(kinds[cfg.metric_name_column], T.StringType):
            raise ValueError(f"metric name column {cfg.metric_name_column!r} contains non-string values")
    elif not cfg.default_metric_name:
        raise ValueError("neither a metric name column nor a default metric name is set")
    if cfg.timestamp_column:
        if cfg.timestamp_column not in kinds:
            raise ValueError(f"timestamp column {cfg.timestamp_column!r} not found in query results")
        if not isinstance(kinds[cfg.timestamp_column], (T.TimestampType, T.TimestampNTZType, T.StringType)):
            raise ValueError(f"timestamp column {cfg.timestamp_column!r} is not a time")
    for column in cfg.label_columns:
        if column in kinds and not isinstance(kinds[column], T.StringType):
            raise ValueError(f"label column {column!r} contains unsupported type {kinds[column].simpleString()}")


def export_timestamp(df: DataFrame, column: str, now: datetime | Column) -> Column:
    """Time of a row: the column, read from RFC 3339 or plain text when needed, or ``now``."""
    if not column:
        return now if isinstance(now, Column) else F.lit(now)
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.StringType):
        plain = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"), value.try_cast("timestamp"))
        return F.coalesce(rfc3339_to_timestamp(value), plain)
    return value.cast("timestamp")


def to_metrics(
    df: DataFrame, cfg: MetricExport, now: datetime | Column, strict: bool = True, limit: int | None = None
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """One metric row (``name, value, ts, labels``) per value column of each result row.

    Names are ``[prefix_]base_column``. With ``strict`` a bad row fails the job;
    otherwise the result is ``(metrics, rejects)``. A result with more than ``limit``
    rows, when one is set, is an error; no row is left out.
    """
    check_export(df, cfg)
    if limit is not None and df.limit(limit + 1).count() > limit:
        raise ValueError(f"the query result has more than {limit} rows")
    present = [c for c in cfg.label_columns if c in df.columns]
    base = F.col(f"`{cfg.metric_name_column}`") if cfg.metric_name_column else F.lit(cfg.default_metric_name)
    prefix = F.lit(cfg.effective_prefix) if cfg.effective_prefix else None
    labels = (
        F.create_map(*[x for c in present for x in (F.lit(c), F.col(f"`{c}`"))])
        if present
        else F.create_map().cast("map<string,string>")
    )

    def number(column: str) -> Column:
        value = F.col(f"`{column}`")
        if isinstance(df.schema[column].dataType, T.StringType):
            return F.when(value.rlike(NUMERIC_TEXT), value.try_cast("double"))
        return value.cast("double")

    ts = export_timestamp(df, cfg.timestamp_column, now)
    df = compute_once(df, _base=base, _norm=normalize_metric_name(base), _ts=ts)
    base, norm, ts = F.col("_base"), F.col("_norm"), F.col("_ts")
    measures = F.array(
        *[
            F.struct(metric_name(prefix, base, F.lit(c), norm).alias("name"), number(c).alias("value"))
            for c in cfg.value_columns
        ]
    )
    null_label = F.coalesce(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in present], F.lit(None).cast("string"))
    reason = (
        F.when(base.isNull() | (base == ""), F.lit("metric name is null or empty"))
        .when(ts.isNull(), F.lit("timestamp is null or unreadable"))
        .when(null_label.isNotNull(), F.concat(F.lit("label column contains null value: "), null_label))
        .when(F.exists("_m", lambda m: m["value"].isNull()), F.lit("value is null or not a number"))
        .when(F.exists("_m", lambda m: m["name"].isNull()), F.lit("metric name cannot be normalised"))
    )
    named = compute_once(df, _m=measures, labels=labels)
    staged = named.select("_m", ts.alias("ts"), "labels", reason.alias("reason"))
    if strict:
        checked = staged.withColumn(
            "_m", F.when(F.col("reason").isNull(), F.col("_m")).otherwise(F.raise_error(F.col("reason")))
        )
        return checked.select("ts", "labels", F.inline("_m")).select("name", "value", "ts", "labels")
    good = staged.filter("reason IS NULL").select("ts", "labels", F.inline("_m")).select("name", "value", "ts", "labels")
    return good, staged.filter("reason IS NOT NULL").select("ts", "labels", "reason")


def to_series(metrics: DataFrame, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Series rows: labels with the metric name first and the rest sorted, one millisecond sample each."""
    return metrics.select(
        entries(F.col("name"), F.col("labels"), naming).alias("labels"),
        F.array(F.struct(F.unix_millis("ts").alias("timestamp"), F.col("value"))).alias("samples"),
    )


__all__ = ["MetricExport", "check_export", "normalize_metric_name", "to_metrics", "to_series"]
