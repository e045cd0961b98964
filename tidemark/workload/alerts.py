"""Alerts over hourly error counts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.labels import label_text
from tidemark.functions.timebin import time_bin
from tidemark.session import scratch_path
from tidemark.operators import alerts as ops
from tidemark.workload.adapters import table, us
from tidemark.workload.aggregates import bin_sql, utc
from tidemark.workload.registry import query

NOW = utc(2024, 1, 31)
RULE = ops.AlertRule(
    "ops",
    "noisy-users",
    """SELECT concat('User ', user_id, ' is noisy') AS Title, count(*) AS Severity, concat('u', user_id) AS CorrelationId, 'more than expected' AS Summary,
      max(event_type) AS LastType, cast(user_id AS string) AS UserId FROM alert_events WHERE ts >= :_startTime AND ts < :_endTime AND value > 10 GROUP BY user_id HAVING count(*) > 4""",
    interval=timedelta(days=10),
    destination="team-a",
)
NOISY_SQL = """noisy AS (SELECT user_id, count(*) AS n, max(event_type) AS last_type FROM events
  WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-31' AND value > 10 GROUP BY 1 HAVING count(*) > 4)"""


def _events_view(spark, d) -> None:
    table(spark, d, "events").createOrReplaceTempView("alert_events")


@query(
    "N1_evaluate_alert",
    f"WITH {NOISY_SQL} SELECT 'User ' || CAST(user_id AS VARCHAR) || ' is noisy' AS title, n AS severity, last_type FROM noisy",
)
def n1(spark, d):
    _events_view(spark, d)
    out = ops.evaluate_alert(spark, RULE, NOW)
    return out.select(F.col("Title").alias("title"), F.col("Severity").alias("severity"), F.col("LastType").alias("last_type"))


@query(
    "N2_to_notifications",
    f"""WITH {NOISY_SQL} SELECT 'team-a' AS destination, 'User ' || CAST(user_id AS VARCHAR) || ' is noisy' AS title, 'more than expected' AS summary, '' AS description, n AS severity,
      'ops/noisy-users' AS source, 'ops/noisy-users://u' || CAST(user_id AS VARCHAR) AS correlation_id, 'LastType=' || last_type || ';UserId=' || CAST(user_id AS VARCHAR) || ';' AS custom_fields FROM noisy""",
)
def n2(spark, d):
    _events_view(spark, d)
    ok, _ = ops.to_notifications(ops.evaluate_alert(spark, RULE, NOW), RULE)
    return ok.withColumn("custom_fields", label_text(F.col("custom_fields")))


def _raw_rows(spark, d) -> DataFrame:
    """Alert rows of every document: long titles, text severities and nulls among them."""
    docs = table(spark, d, "documents")
    kind = F.col("doc_id") % 6
    return docs.select(
        F.when(kind == 1, F.lit("")).when(kind == 5, F.lit(None).cast("string")).otherwise(F.col("text")).alias("TITLE"),
        F.when(kind == 2, F.lit("high")).when(kind == 3, F.lit("2.5")).otherwise(F.col("n_chars").cast("string")).alias("severity"),
        F.when(kind == 4, F.lit("")).when(kind == 0, F.lit("ops/docs://d")).otherwise(F.col("doc_id").cast("string")).alias("correlationId"),
        F.col("source").alias("recipient"), F.col("doc_id").cast("string").alias("doc"),
    )


DOC_RULE = ops.AlertRule("ops", "docs", "SELECT 1")
DOC_SQL = """alert AS (SELECT *, doc_id % 6 AS kind, CASE WHEN doc_id % 6 = 1 THEN '' ELSE text END AS title FROM documents),
  judged AS (SELECT *, CASE WHEN kind = 5 THEN 'query result column has nil value: TITLE' WHEN kind IN (2, 3) THEN 'failed to convert severity to int'
    WHEN strlen(title) = 0 OR strlen(title) > 512 THEN 'title must be between 1 and 512 chars' END AS reason FROM alert)"""


@query(
    "N3_validation_rejects",
    f"WITH {DOC_SQL} SELECT 'doc=' || CAST(doc_id AS VARCHAR) || ';' AS fields, reason FROM judged WHERE reason IS NOT NULL",
)
def n3(spark, d):
    _, bad = ops.to_notifications(_raw_rows(spark, d), DOC_RULE)
    return bad.select(label_text(F.col("custom_fields")).alias("fields"), "reason")


@query(
    "N4_correlation_prefix",
    f"""WITH {DOC_SQL} SELECT source AS destination, n_chars AS severity, CASE kind WHEN 4 THEN '' WHEN 0 THEN 'ops/docs://d' ELSE 'ops/docs://' || CAST(doc_id AS VARCHAR) END AS correlation_id
    FROM judged WHERE reason IS NULL""",
)
def n4(spark, d):
    ok, _ = ops.to_notifications(_raw_rows(spark, d), DOC_RULE)
    return ok.select("destination", "severity", "correlation_id")


def notifications(spark, d) -> DataFrame:
    """A notification per event, one rule per event type, one incident per user and hour; clicks have no id."""
    e = table(spark, d, "events")
    source = F.concat(F.lit("ops/"), "event_type")
    hour = us(time_bin(F.col("ts"), 3600)).cast("string")
    return e.select(
        F.lit("team").alias("destination"), F.concat(F.lit("value "), F.col("value").cast("string")).alias("title"), F.lit("").alias("summary"), F.lit("").alias("description"),
        (F.col("event_id") % 5).alias("severity"), source.alias("source"),
        F.when(F.col("event_type") == "click", F.lit("")).otherwise(F.concat_ws("/", F.col("user_id").cast("string"), hour)).alias("correlation_id"),
        F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("custom_fields"), "ts", "event_id",
    )


@query(
    "N5_throttle",
    """SELECT 'ops/' || event_type AS source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 25""",
)
def n5(spark, d):
    value = F.substring("title", 7, 30).cast("double")
    emitted, _ = ops.throttle(notifications(spark, d), order=[value.desc(), F.col("event_id")])
    return emitted.select("source", "event_id")


@query(
    "N5_throttle_flags",
    """SELECT 'Alert ops/' || event_type || ' has too many notifications in eastus' AS title, 'notification-failure/ops/' || event_type AS correlation_id, CAST(3 AS BIGINT) AS severity
    FROM events GROUP BY event_type HAVING count(*) > 25""",
)
def n5_flags(spark, d):
    _, flags = ops.throttle(notifications(spark, d), region="eastus")
    return flags.select("title", "correlation_id", "severity")


INCIDENT_SQL = f"""inc AS (SELECT 'ops/' || event_type AS source, CAST(user_id AS VARCHAR) || '/' || CAST({bin_sql("ts", 3600)} AS VARCHAR) AS correlation_id, count(*) AS hits,
    epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(event_id % 5, ts) AS severity FROM events WHERE event_type <> 'click' GROUP BY 1, 2
  UNION ALL SELECT 'ops/click', '', 1, epoch_us(ts), epoch_us(ts), event_id % 5 FROM events WHERE event_type = 'click')"""


@query("N6_correlate", f"WITH {INCIDENT_SQL} SELECT * FROM inc")
def n6(spark, d):
    out = ops.correlate(notifications(spark, d))
    return out.select("source", "correlation_id", "hits", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "severity")


@query(
    "N7_mitigate",
    f"""WITH {INCIDENT_SQL} SELECT source, correlation_id, last_us, CASE source WHEN 'ops/error' THEN epoch_us(TIMESTAMP '2024-01-31') - last_us >= 864000000000
      WHEN 'ops/view' THEN epoch_us(TIMESTAMP '2024-01-31') - last_us >= 86400000000 ELSE false END AS mitigated FROM inc""",
)
def n7(spark, d):
    kinds = table(spark, d, "events").select("event_type").distinct()
    limits = kinds.select(
        F.concat(F.lit("ops/"), "event_type").alias("source"),
        F.when(F.col("event_type") == "error", 864_000).when(F.col("event_type") == "view", 86_400).otherwise(0).alias("auto_mitigate_s"),
    )
    out = ops.mitigate(ops.correlate(notifications(spark, d)), limits, NOW)
    return out.select("source", "correlation_id", us("last_seen").alias("last_us"), "mitigated")


@query(
    "N8_evaluation_report",
    """SELECT 'ops' AS namespace, CAST(user_id AS VARCHAR) AS name, count(*) AS evaluations, count(*) FILTER (event_type = 'click') AS success, count(*) FILTER (event_type = 'error') AS user_error,
      count(*) FILTER (event_type = 'view') AS service_error, count(*) FILTER (event_type = 'signup') AS setup_error, count(*) FILTER (event_type = 'purchase') AS throttled,
      CAST(sum(event_id % 7) AS BIGINT) AS row_count, CAST(sum(event_id % 3) AS BIGINT) AS alerts, round(avg(value), 6) AS average_duration_s FROM events GROUP BY 2""",
)
def n8(spark, d):
    kind = F.col("event_type")
    outcome = (
        F.when(kind == "click", F.lit("success")).when(kind == "error", F.lit("user_error")).when(kind == "view", F.lit("service_error"))
        .when(kind == "signup", F.lit("setup_error")).otherwise("throttled")
    )
    runs = table(spark, d, "events").select(
        F.lit("ops").alias("namespace"), F.col("user_id").cast("string").alias("name"), outcome.alias("outcome"), (F.col("event_id") % 7).alias("rows"),
        (F.col("event_id") % 3).alias("alerts"), F.col("value").alias("duration_s"),
    )
    out = ops.evaluation_report(runs).withColumn("average_duration_s", F.round("average_duration_s", 6))
    return out.withColumnRenamed("rows", "row_count")


@query(
    "N8_run_alerts",
    f"""WITH {NOISY_SQL} SELECT 'noisy-users' AS name, CASE WHEN count(*) > 25 THEN 'throttled' ELSE 'success' END AS outcome, count(*) AS row_count, least(count(*), 25) AS alerts FROM noisy
    UNION ALL SELECT 'broken', 'user_error', 0, 0 UNION ALL SELECT 'flood', CASE WHEN count(*) > 25 THEN 'throttled' ELSE 'success' END, count(*), least(count(*), 25) FROM events""",
)
def n8_run(spark, d):
    _events_view(spark, d)
    broken = ops.AlertRule("ops", "broken", "SELECT nothing FROM alert_events", destination="team-b")
    flood = ops.AlertRule("ops", "flood", lambda s, p: s.table("alert_events").select(F.lit("t").alias("title"), F.lit(1).alias("severity")))
    sent: list[DataFrame] = []
    out = ops.run_alerts(spark, [RULE, broken, flood], NOW, sent.append)
    return out.select("name", "outcome", F.col("rows").alias("row_count"), "alerts")


@query(
    "N8_sent",
    f"""WITH {NOISY_SQL}, n AS (SELECT count(*) AS n FROM noisy), f AS (SELECT count(*) AS n FROM events)
    SELECT 'ops/noisy-users' AS source, least(n, 25) AS n FROM n WHERE n > 0
    UNION ALL SELECT 'notification-failure/ops/noisy-users', 1 FROM n WHERE n > 25
    UNION ALL SELECT 'ops/flood', least(n, 25) FROM f UNION ALL SELECT 'notification-failure/ops/flood', 1 FROM f WHERE n > 25
    UNION ALL SELECT 'ops/broken', 1""",
)
def n8_sent(spark, d):
    """What arrives at the sink: rules that fail in their code, or whose criteria say no, send nothing and stop nobody."""
    _events_view(spark, d)
    one = lambda s, p: s.table("alert_events").select(F.lit("t").alias("title"), F.lit(1).alias("severity"))
    rules = [
        ops.AlertRule("ops", "crash", lambda s, p: 1 // 0), ops.AlertRule("ops", "elsewhere", one, criteria={"region": ["west"]}),
        ops.AlertRule("ops", "never", one, criteria_expression="region = 'north'"), RULE,
        ops.AlertRule("ops", "broken", "SELECT nothing FROM alert_events", destination="team-b"), ops.AlertRule("ops", "flood", one, criteria={"region": ["EAST"]}),
    ]
    path = scratch_path(spark, "sent")
    ops.run_alerts(spark, rules, NOW, lambda df: df.write.mode("append").parquet(path), labels={"region": "east"})
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "N8_outcomes",
    """SELECT * FROM (VALUES ('crash', 'service_error'), ('lost', 'service_error'), ('idle', 'setup_error')) t(name, outcome)
    UNION ALL SELECT 'fine', 'success' FROM events HAVING count(*) > 0""",
)
def n8_outcomes(spark, d):
    """A rule whose code fails, one whose notifications cannot be delivered, one that cannot be set up, and a sound one."""
    _events_view(spark, d)
    few = lambda s, p: s.table("alert_events").groupBy(F.lit("t").alias("title")).agg(F.max(F.lit(1)).alias("severity"))

    def sink(df: DataFrame) -> None:
        if not df.filter("source = 'ops/lost'").isEmpty():
            raise OSError("no route")

    rules = [
        ops.AlertRule("ops", "crash", lambda s, p: 1 // 0), ops.AlertRule("ops", "lost", few),
        ops.AlertRule("ops", "idle", few, interval=NOW - NOW), ops.AlertRule("ops", "fine", few),
    ]
    return ops.run_alerts(spark, rules, NOW, sink).select("name", "outcome")
