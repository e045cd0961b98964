"""Alert evaluation: query rows to notifications, throttling, incidents, outcomes."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.plans.rules import select_rules
from tidemark.schemas import NOTIFICATION_SCHEMA
from tidemark.session import stored

# Result columns with a meaning of their own, and the default notification cap. Fixed values.
RESERVED_COLUMNS = ("title", "description", "severity", "recipient", "summary", "correlationid")
MAX_TITLE = 512
DEFAULT_CAP = 25
# Spark's default for the largest rank that it filters before a shuffle; salts beyond it.
GROUP_LIMIT, SALTS = 1000, 64


@dataclass(frozen=True)
class AlertRule:
    """An alert query: Spark SQL text with named parameters, or a function of (spark, parameters)."""

    namespace: str
    name: str
    query: str | Callable[[SparkSession, dict], DataFrame]
    interval: timedelta = timedelta(hours=1)
    destination: str = ""
    database: str = ""
    auto_mitigate_after: timedelta | None = None
    criteria: dict[str, list[str]] = field(default_factory=dict)
    criteria_expression: str = ""

    @property
    def source(self) -> str:
        return f"{self.namespace}/{self.name}"


def evaluate_alert(spark: SparkSession, rule: AlertRule, now: datetime, region: str = "") -> DataFrame:
    """Rows of the rule's query over ``[now - interval, now)``.

    The query sees ``:_startTime``, ``:_endTime`` and ``:_region`` as parameters.
    """
    params = {"_startTime": now - rule.interval, "_endTime": now, "_region": region}
    if callable(rule.query):
        return rule.query(spark, params)
    return spark.sql(rule.query, args=params)


def check_columns(columns: list[str]) -> None:
    """Reject results that spell a reserved column in more than one way."""
    seen: dict[str, str] = {}
    for column in columns:
        key = column.lower()
        if key in RESERVED_COLUMNS:
            if key in seen:
                raise ValueError(f"multiple columns for reserved alert field {key}: {seen[key]}, {column}")
            seen[key] = column


def _whole_severity(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("bigint"))
    if isinstance(kind, (T.IntegralType, T.FractionalType, T.DecimalType)):
        return value.try_cast("bigint")
    return F.lit(None).cast("bigint")


def to_notifications(df: DataFrame, rule: AlertRule) -> tuple[DataFrame, DataFrame]:
    """Notifications of query rows, and the rows that are not valid ones with the reason."""
    judged = judge_notifications(df, rule)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def judge_notifications(df: DataFrame, rule: AlertRule) -> DataFrame:
    """Query rows as notifications, with the ``reason`` why a row is not a valid one, null for valid ones.

    Reserved columns match in any case; all others become custom fields as text.
    Severity accepts whole numbers, decimals (cut to the whole part) and numeric
    texts. The rule's destination wins over the recipient column.
    """
    check_columns(df.columns)
    by_name = {c.lower(): c for c in df.columns if c.lower() in RESERVED_COLUMNS}
    custom = [c for c in df.columns if c.lower() not in RESERVED_COLUMNS]

    def text(key: str) -> Column:
        return F.col(f"`{by_name[key]}`").cast("string") if key in by_name else F.lit("")

    severity = _whole_severity(df, by_name["severity"]) if "severity" in by_name else F.lit(None).cast("bigint")
    correlation = text("correlationid")
    prefix = F.lit(rule.source + "://")
    fields = (
        F.create_map(*[x for c in custom for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
        if custom
        else F.create_map().cast("map<string,string>")
    )
    null_column = F.coalesce(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in df.columns])
    title_bytes = F.octet_length(text("title"))
    reason = (
        F.when(null_column.isNotNull(), F.concat(F.lit("query result column has nil value: "), null_column))
        .when(F.lit("severity" in by_name) & severity.isNull(), F.lit("failed to convert severity to int"))
        .when((title_bytes == 0) | (title_bytes > MAX_TITLE), F.lit("title must be between 1 and 512 chars"))
        .when(severity.isNull() | (severity == F.lit(-(1 << 63))), F.lit("severity must be specified"))
    )
    return df.select(
        (F.lit(rule.destination) if rule.destination else text("recipient")).alias("destination"),
        text("title").alias("title"),
        text("summary").alias("summary"),
        text("description").alias("description"),
        severity.alias("severity"),
        F.lit(rule.source).alias("source"),
        F.when((correlation == "") | correlation.startswith(prefix), correlation)
        .otherwise(F.concat(prefix, correlation))
        .alias("correlation_id"),
        fields.alias("custom_fields"),
        reason.alias("reason"),
    )


def throttle(
    notifications: DataFrame, cap: int = DEFAULT_CAP, order: list[str | Column] | None = None, rule: str = "source", region: str = ""
) -> tuple[DataFrame, DataFrame]:
    """First ``cap`` notifications per rule, and one synthetic notification per rule that had more.

    The rank filter runs on the map side too, so a flooding rule ships at most
    ``cap`` rows per task. Above the cap up to which Spark does that, rows are ranked
    per (rule, salt) first.
    """
    order = order or ["correlation_id", "title"]
    per_rule = Window.partitionBy(rule).orderBy(*order)
    few = notifications
    if cap > GROUP_LIMIT:
        salted = notifications.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        few = salted.withColumn("_n", F.row_number().over(Window.partitionBy(rule, "_salt").orderBy(*order)))
        few = few.filter(F.col("_n") <= cap).drop("_n", "_salt")
    ranked = few.withColumn("_n", F.row_number().over(per_rule))
    emitted = ranked.filter(F.col("_n") <= cap).drop("_n")
    flooded = notifications.groupBy(rule).agg(F.count("*").alias("_count")).filter(F.col("_count") > cap)
    owners = ranked.filter(F.col("_n") <= 1).select(rule, F.col("destination").alias("_d"))
    over = flooded.join(owners, rule)
    failure = F.concat(F.lit("notification-failure/"), F.col(rule))
    flags = over.select(
        F.col("_d").alias("destination"),
        F.concat(F.lit("Alert "), F.col(rule), F.lit(f" has too many notifications in {region}")).alias("title"),
        F.lit("This alert has been throttled due to too many notifications.").alias("summary"),
        F.lit("").alias("description"),
        F.lit(3).cast("bigint").alias("severity"),
        failure.alias("source"),
        failure.alias("correlation_id"),
        F.create_map().cast("map<string,string>").alias("custom_fields"),
    )
    return emitted, flags


def correlate(notifications: DataFrame, ts: str = "ts") -> DataFrame:
    """Incidents: rows sharing a correlation id are one, rows without an id are each their own.

    Severity and title are those of the latest hit.
    """
    has_id = F.coalesce("correlation_id", F.lit("")) != ""
    latest = F.max_by(F.struct("title", "severity", "destination"), F.struct(ts, "title", "severity"))
    grouped = (
        notifications.filter(has_id)
        .groupBy("source", "correlation_id")
        .agg(
            F.count("*").alias("hits"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), latest.alias("_l")
        )
        .select("source", "correlation_id", "hits", "first_seen", "last_seen", "_l.*")
    )
    single = notifications.filter(~has_id).select(
        "source",
        F.lit("").alias("correlation_id"),
        F.lit(1).cast("bigint").alias("hits"),
        F.col(ts).alias("first_seen"),
        F.col(ts).alias("last_seen"),
        "title",
        "severity",
        "destination",
    )
    return grouped.unionByName(single)


def mitigate(incidents: DataFrame, rules: DataFrame, now: datetime) -> DataFrame:
    """Add ``mitigated``: no hit for the rule's ``auto_mitigate_s``; rules without one never close incidents."""
    limits = rules.select("source", "auto_mitigate_s")
    idle = (F.unix_micros(F.lit(now)) - F.unix_micros("last_seen")) / F.lit(1e6)
    joined = incidents.join(limits, "source", "left")
    return joined.withColumn(
        "mitigated", F.coalesce((F.col("auto_mitigate_s") > 0) & (idle >= F.col("auto_mitigate_s")), F.lit(False))
    ).drop("auto_mitigate_s")


# Outcome names. Fixed values.
SUCCESS, USER_ERROR, SERVICE_ERROR, SETUP_ERROR, THROTTLED = (
    "success",
    "user_error",
    "service_error",
    "setup_error",
    "throttled",
)


def matching_rules(spark: SparkSession, rules: list[AlertRule], labels: dict[str, str]) -> list[AlertRule]:
    """The rules whose criteria hold for the labels of this place."""
    rows = [(i, r.criteria or None, r.criteria_expression) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule int, criteria map<string,array<string>>, expression string")
    chosen = select_rules(table, labels).filter("selected").select("rule").collect()
    return [rules[i] for i in sorted(r["rule"] for r in chosen)]


def _run_alert(
    spark: SparkSession, rule: AlertRule, now: datetime, sink: Callable[[DataFrame], None], cap: int, region: str
) -> tuple[str, int, int, str]:
    """Outcome, valid rows, notifications sent and message of one rule; its query runs once."""
    if not rule.name or not rule.namespace or rule.interval <= timedelta(0):
        return SETUP_ERROR, 0, 0, "a rule needs a namespace, a name and an interval"
    try:
        judged = stored(judge_notifications(evaluate_alert(spark, rule, now, region), rule), "alert-rows")
        found = judged.agg(F.count_if(F.col("reason").isNull()).alias("rows"), F.min("reason").alias("reason")).first()
        if found["reason"]:
            raise ValueError(found["reason"])
    except (AnalysisException, ValueError) as error:
        sink(failure_notification(spark, rule, str(error)))
        return USER_ERROR, 0, 0, str(error)
    emitted, flags = throttle(judged.drop("reason"), cap, region=region)
    sink(emitted.unionByName(flags))
    if found["rows"] > cap:
        return THROTTLED, found["rows"], cap, "Too many notifications sent"
    return SUCCESS, found["rows"], found["rows"], ""


def run_alerts(
    spark: SparkSession, rules: list[AlertRule], now: datetime, sink: Callable[[DataFrame], None], cap: int = DEFAULT_CAP,
    region: str = "", labels: dict[str, str] | None = None, at_once: int = 5,
) -> DataFrame:
    """Evaluate the rules whose criteria match ``labels``, hand their notifications to ``sink``, return one outcome row each.

    ``at_once`` rules are evaluated side by side; the sink is called by one at a time, as
    appends to one folder must be. Whatever fails in one rule, its query, its code or
    the sink, is that rule's outcome and does not stop the others; a query in error sends
    one notification to the rule's own destination. Outcomes are in the order of the rules.
    """
    turn = Lock()

    def in_turn(notifications: DataFrame) -> None:
        with turn:
            sink(notifications)

    def run(rule: AlertRule) -> tuple:
        started = time.monotonic()
        try:
            result = _run_alert(spark, rule, now, in_turn, cap, region)
        except Exception as error:
            result = SERVICE_ERROR, 0, 0, f"{type(error).__name__}: {error}"
        outcome, rows, alerts, message = result
        return rule.namespace, rule.name, outcome, rows, alerts, time.monotonic() - started, message

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        outcomes = list(pool.map(run, matching_rules(spark, rules, labels or {})))
    return spark.createDataFrame(
        outcomes,
        "namespace string, name string, outcome string, rows long, alerts long, duration_s double, message string",
    )


def failure_notification(spark: SparkSession, rule: AlertRule, message: str) -> DataFrame:
    """The one notification a rule's owner gets when its query fails."""
    row = (
        rule.destination,
        f"Alert {rule.source} has query errors",
        f"This query is failing to execute: {message}",
        "",
        3,
        rule.source,
        f"alert-failure/{rule.source}",
        {},
    )
    return spark.createDataFrame([row], NOTIFICATION_SCHEMA)


def evaluation_report(runs: DataFrame) -> DataFrame:
    """Evaluations per rule by outcome, with rows, alerts and average duration."""
    outcome = F.col("outcome")
    counts = [F.count_if(outcome == o).alias(o) for o in (SUCCESS, USER_ERROR, SERVICE_ERROR, SETUP_ERROR, THROTTLED)]
    return runs.groupBy("namespace", "name").agg(
        F.count("*").alias("evaluations"),
        *counts,
        F.sum("rows").alias("rows"),
        F.sum("alerts").alias("alerts"),
        F.avg("duration_s").alias("average_duration_s"),
    )
