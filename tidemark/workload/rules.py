"""Rollup rules with windows, ledgers and requests derived from the benchmark tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.timebin import time_bin
from tidemark.operators.aggregate import latest_by
from tidemark.plans import rules as plans
from tidemark.plans.windows import backfill_windows, missing_windows, newest_windows
from tidemark.session import scratch_path
from tidemark.workload.adapters import r6, table, us
from tidemark.workload.aggregates import bin_sql, utc
from tidemark.workload.registry import query

NOW = utc(2024, 1, 31, 0, 30, 7)
NOW_SQL = "epoch_us(TIMESTAMP '2024-01-31 00:30:07')"


def rule_table(spark, d) -> DataFrame:
    """One rule per user: interval 1-4 h, delay 0-30 min, last end at the user's first event hour, every tenth never ran."""
    e = table(spark, d, "events")
    user = F.col("user_id")
    return e.groupBy("user_id").agg(F.date_trunc("hour", F.min("ts")).alias("first")).select(
        F.concat(F.lit("rule_"), user.cast("string")).alias("rule"), ((user % 4 + 1) * 3600).cast("int").alias("interval_s"),
        (user % 3 * 900).cast("int").alias("delay_s"), F.when(user % 10 != 0, F.col("first")).alias("last_end"),
        (user % 13 != 0).alias("managed"), (user % 11 != 0).alias("selected"), "first",
    )


def ledger_table(spark, d) -> DataFrame:
    """A tracked window per user and interval that had an event, its state by the latest event's type."""
    e = table(spark, d, "events").withColumn("rule", F.concat(F.lit("rule_"), F.col("user_id").cast("string")))
    r = rule_table(spark, d).select("rule", "interval_s", "first")
    step = F.col("interval_s").cast("bigint") * 1_000_000
    since = us("ts") - us("first")
    placed = e.join(r, "rule").withColumn("window_start", F.timestamp_micros(us("first") + since - F.pmod(since, step)))
    state = (
        F.when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type") == "signup", F.lit("backlog"))
        .when(F.col("event_type") == "view", F.lit("running")).when(F.col("event_type") == "click", F.lit("retry")).otherwise("completed")
    )
    latest = latest_by(placed.withColumns({"state": state, "one": F.lit(1)}), ["rule", "window_start"], "ts", ["state", "event_id"])
    return latest.select(
        "rule", "window_start", "state", (F.col("event_id") % 3 + 1).alias("attempts"), F.concat(F.lit("req_"), "rule").alias("request_id")
    )


RULE_SQL = f"""rule AS (SELECT 'rule_' || CAST(user_id AS VARCHAR) AS rule, user_id, (user_id % 4 + 1) * 3600 AS interval_s, user_id % 3 * 900 AS delay_s,
    {bin_sql("min(ts)", 3600)} AS first_us, CASE WHEN user_id % 10 <> 0 THEN {bin_sql("min(ts)", 3600)} END AS last_us FROM events GROUP BY user_id),
  placed AS (SELECT rule, event_id, event_type, ts, first_us + (epoch_us(ts) - first_us) // (interval_s * 1000000) * (interval_s * 1000000) AS start_us
    FROM events JOIN rule USING (user_id)),
  ledger AS (SELECT rule, start_us, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'backlog' WHEN 'view' THEN 'running' WHEN 'click' THEN 'retry' ELSE 'completed' END AS state,
    event_id % 3 + 1 AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY rule, start_us ORDER BY ts DESC) AS n FROM placed) WHERE n = 1)"""


TRACKED_SQL = f"""WITH {RULE_SQL}, eff AS (SELECT *, {NOW_SQL} - delay_s * 1000000 AS eff_us, interval_s * 1000000 AS step FROM rule),
      gen AS (SELECT rule, step, unnest(CASE WHEN last_us IS NULL THEN [eff_us // step * step - step] ELSE list_filter(range(last_us, eff_us, step), lambda s: s + step < eff_us) END) AS start_us FROM eff),
      fresh AS (SELECT gen.* FROM gen LEFT JOIN ledger USING (rule, start_us) WHERE ledger.rule IS NULL),
      every AS (SELECT rule, start_us, step, true AS new FROM fresh UNION ALL SELECT rule, start_us, NULL, false FROM ledger),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY start_us DESC) AS n FROM every)"""


def in_us(windows: DataFrame) -> DataFrame:
    return windows.select("rule", us("window_start").alias("start_us"), us("window_end").alias("end_us"))


@query("W2_missing_windows", f"{TRACKED_SQL} SELECT rule, start_us, start_us + step AS end_us FROM ranked WHERE n <= 200 AND new")
def w2(spark, d):
    return in_us(newest_windows(rule_table(spark, d), ledger_table(spark, d), NOW, 200)[0])


@query("W2_left_out_windows", f"{TRACKED_SQL} SELECT rule, start_us, start_us + step AS end_us FROM ranked WHERE n > 200 AND new")
def w2_left_out(spark, d):
    return in_us(newest_windows(rule_table(spark, d), ledger_table(spark, d), NOW, 200)[1])


@query("W2_all_missing_windows", f"{TRACKED_SQL} SELECT rule, start_us, start_us + step AS end_us FROM ranked WHERE new")
def w2_all(spark, d):
    return in_us(missing_windows(rule_table(spark, d), ledger_table(spark, d), NOW))


def request_table(spark, d) -> DataFrame:
    """One backfill request per rule: mostly whole ranges, some broken in each way."""
    r = rule_table(spark, d)
    user = F.regexp_extract("rule", r"(\d+)$", 1).cast("int")
    step = F.col("interval_s").cast("bigint") * 1_000_000
    end = F.timestamp_micros(us("first") + step * (user % 40) + F.when(user % 7 == 0, 1_000_000).otherwise(0))
    return r.select(
        "rule", F.when(user % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("req_"), "rule")).alias("request_id"), F.col("first").alias("start"),
        end.alias("end"), (user % 25).alias("max_in_flight"),
    )


REQUEST_SQL = f"""{RULE_SQL}, req AS (SELECT rule, user_id, CASE WHEN user_id % 17 = 0 THEN '' ELSE 'req_' || rule END AS request_id, first_us AS start_us, interval_s * 1000000 AS step,
      first_us + interval_s * 1000000 * (user_id % 40) + CASE WHEN user_id % 7 = 0 THEN 1000000 ELSE 0 END AS end_us, user_id % 25 AS flight FROM rule),
    checked AS (SELECT *, CASE WHEN request_id = '' THEN 'no request id' WHEN end_us <= start_us THEN 'range is empty or reversed'
      WHEN (end_us - start_us) % step <> 0 THEN 'range is not a whole number of intervals' END AS error FROM req)"""


@query(
    "W3_backfill_windows",
    f"""WITH {REQUEST_SQL}, gen AS (SELECT rule, request_id, step, least(greatest(flight, 1), 20) AS budget, unnest(range(start_us, end_us, step)) AS w_us FROM checked WHERE error IS NULL),
      busy AS (SELECT rule, count(*) AS n FROM ledger WHERE state = 'running' GROUP BY 1),
      open AS (SELECT gen.*, row_number() OVER (PARTITION BY gen.rule ORDER BY w_us) AS k FROM gen LEFT JOIN (SELECT * FROM ledger WHERE state <> 'retry') l ON l.rule = gen.rule AND l.start_us = w_us WHERE l.rule IS NULL)
    SELECT open.rule, request_id, w_us AS start_us, w_us + step AS end_us FROM open LEFT JOIN busy ON busy.rule = open.rule WHERE k <= budget - coalesce(n, 0)""",
)
def w3(spark, d):
    out, _ = backfill_windows(rule_table(spark, d), ledger_table(spark, d), request_table(spark, d))
    return out.select("rule", "request_id", us("window_start").alias("start_us"), us("window_end").alias("end_us"))


@query("W3_backfill_errors", f"WITH {REQUEST_SQL} SELECT rule, request_id, error FROM checked WHERE error IS NOT NULL")
def w3_errors(spark, d):
    return backfill_windows(rule_table(spark, d), ledger_table(spark, d), request_table(spark, d))[1]


def offset_windows(spark, d) -> DataFrame:
    """Windows of six hours starting 17 minutes past, for the quarter days that had an error event."""
    e = table(spark, d, "events").filter(F.col("event_type") == "error")
    start = time_bin(F.col("ts"), 21_600) + F.expr("INTERVAL '17' MINUTE")
    return e.select(start.alias("window_start")).distinct().withColumn("window_end", F.col("window_start") + F.expr("INTERVAL '6' HOUR"))


def _totals(df: DataFrame) -> DataFrame:
    return df.groupBy("window_start", "event_type").agg(r6(F.sum("value")).alias("total"), F.count("*").alias("n"))


@query(
    "W4_run_rollup",
    f"""WITH w AS (SELECT DISTINCT {bin_sql("ts", 21600)} + 1020000000 AS s FROM events WHERE event_type = 'error')
    SELECT s AS start_us, event_type, round(sum(value), 6) AS total, count(*) AS n FROM events JOIN w ON epoch_us(ts) >= s AND epoch_us(ts) < s + 21600000000 GROUP BY 1, 2""",
)
def w4(spark, d):
    e, windows = table(spark, d, "events"), offset_windows(spark, d)
    target, ledger = scratch_path(spark, "rollup"), scratch_path(spark, "ledger")
    for _ in range(2):  # the second run replaces the first one's output
        plans.run_rollup(e, windows, _totals, target, ledger, "quarter-day")
    out = spark.read.parquet(target)
    return out.select(us(F.col("window_start").cast("timestamp")).alias("start_us"), "event_type", "total", "n")


@query(
    "W4_ledger_state",
    f"""SELECT 'quarter-day' AS rule, s AS start_us, 'completed' AS state FROM (SELECT DISTINCT {bin_sql("ts", 21600)} + 1020000000 AS s FROM events WHERE event_type = 'error')""",
)
def w4_ledger(spark, d):
    e, windows = table(spark, d, "events"), offset_windows(spark, d)
    target, ledger = scratch_path(spark, "rollup"), scratch_path(spark, "ledger")
    plans.run_rollup(e, windows, _totals, target, ledger, "quarter-day")
    return plans.ledger_state(spark.read.parquet(ledger)).select("rule", us("window_start").alias("start_us"), "state")


@query(
    "W7_rule_health",
    f"""WITH {RULE_SQL}, c AS (SELECT rule, count(*) FILTER (state <> 'backlog') AS submitted, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'running') AS in_flight,
        count(*) FILTER (state = 'backlog') AS backlog, CAST(sum(attempts - 1) AS BIGINT) AS retried, min(start_us) FILTER (state = 'running') AS oldest FROM ledger GROUP BY 1),
      x AS (SELECT rule.*, c.*, interval_s * 1000000 AS step, {NOW_SQL} AS now_us, {NOW_SQL} - delay_s * 1000000 - last_us AS elapsed FROM rule LEFT JOIN c ON c.rule = rule.rule),
      f AS (SELECT *, CASE WHEN last_us IS NULL THEN true ELSE elapsed >= step END AS due, coalesce(elapsed < step // 2, false) AS just_run,
        coalesce(now_us - oldest > greatest(step, 1800000000), false) AS stale, coalesce(elapsed > step AND elapsed // step - backlog > 1, false) AS gap FROM x)
    SELECT rule, submitted, completed, in_flight, backlog, retried, due, stale, gap,
      CASE WHEN user_id % 13 = 0 THEN 'unmanaged_database' WHEN user_id % 11 = 0 THEN 'criteria_mismatch' WHEN due AND NOT just_run THEN 'submission_missed' WHEN stale THEN 'async_stale' WHEN gap THEN 'backlog_gap' END AS reason FROM f""",
)
def w7(spark, d):
    out = plans.rule_health(rule_table(spark, d), ledger_table(spark, d), NOW)
    return out.drop("failed", "working")


@query(
    "W7_backfill_progress",
    f"""WITH {REQUEST_SQL}, c AS (SELECT rule, count(*) FILTER (state <> 'retry') AS submitted, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, CAST(sum(attempts - 1) AS BIGINT) AS retried FROM ledger GROUP BY 1)
    SELECT req.rule, req.request_id, (end_us - start_us) // step AS windows, coalesce(submitted, 0) AS submitted, coalesce(completed, 0) AS completed, coalesce(retried, 0) AS retried,
      CASE WHEN coalesce(failed, 0) > 0 THEN 'Failed' WHEN coalesce(completed, 0) >= (end_us - start_us) // step THEN 'Completed' WHEN coalesce(submitted, 0) > 0 THEN 'Running' ELSE 'Pending' END AS phase
    FROM req LEFT JOIN c ON c.rule = req.rule AND req.request_id <> ''""",
)
def w7_backfill(spark, d):
    return plans.backfill_progress(request_table(spark, d), rule_table(spark, d), ledger_table(spark, d))


@query(
    "W9_select_rules",
    """WITH r AS (SELECT s_suppkey, s_nationkey % 4 = 0 OR s_nationkey % 4 = 1 OR s_nationkey % 4 = 3 AND s_suppkey % 2 = 0 AS by_map, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'error' ELSE '' END AS ex FROM supplier)
    SELECT s_suppkey AS rule, by_map AND ex IN ('', 'true') AS selected, CASE WHEN ex = 'error' THEN 'criteria expression error' WHEN by_map AND ex IN ('', 'true') THEN 'criteria matched'
      WHEN NOT by_map AND ex IN ('', 'true') THEN 'criteria map did not match' WHEN by_map THEN 'criteria expression evaluated to false' ELSE 'criteria map did not match and expression false' END AS reason FROM r""",
)
def w9(spark, d):
    s = table(spark, d, "supplier")
    none = F.create_map().cast("map<string,array<string>>")
    kind = F.col("s_nationkey") % 4
    criteria = (
        F.when(kind == 0, none)
        .when(kind == 1, F.create_map(F.lit("Region"), F.array(F.lit("WESTUS"), F.lit("EastUS")), F.lit("other"), F.array(F.lit("x"))))
        .when(kind == 2, F.create_map(F.lit("region"), F.array(F.lit("north"))))
        .otherwise(F.create_map(F.lit("absent"), F.array(F.lit("a")), F.lit("ENV"), F.array(F.when(F.col("s_suppkey") % 2 == 0, F.lit("Prod")).otherwise("dev"))))
    )
    expressions = F.array(F.lit(""), F.lit("region = 'eastus' AND env IN ('prod', 'x')"), F.lit("env = 'dev'"), F.lit("nonsense("), F.lit("  "))
    rules = s.select(F.col("s_suppkey").alias("rule"), criteria.alias("criteria"), F.get(expressions, (F.col("s_suppkey") % 5).cast("int")).alias("expression"))
    return plans.select_rules(rules, {"region": "eastus", "env": "prod"}).select("rule", "selected", "reason")


@query(
    "W10_run_rules",
    f"""SELECT 'totals' AS rule, {bin_sql("ts", 86400)} AS start_us, round(sum(value), 6) AS v FROM events GROUP BY 2
    UNION ALL SELECT 'errors', {bin_sql("ts", 86400)}, CAST(count(*) AS DOUBLE) FROM events WHERE event_type = 'error' GROUP BY 2""",
)
def w10(spark, d):
    e = table(spark, d, "events")
    days = e.select(F.date_trunc("day", "ts").alias("window_start")).distinct().withColumn("window_end", F.col("window_start") + F.expr("INTERVAL '1' DAY"))
    windows = days.withColumn("rule", F.explode(F.array(F.lit("totals"), F.lit("errors"))))
    paths = {n: scratch_path(spark, f"rule-{n}") for n in ("totals", "errors", "ledger")}
    rules = [
        plans.RollupRule("totals", "events", lambda df: df.groupBy("window_start").agg(r6(F.sum("value")).alias("v")), paths["totals"]),
        plans.RollupRule(
            "errors", "events", lambda df: df.filter(F.col("event_type") == "error").groupBy("window_start").agg(F.count("*").cast("double").alias("v")), paths["errors"],
        ),
    ]
    problems = {k: v for k, v in plans.run_rules(rules, {"events": e}, windows, paths["ledger"]).items() if v}
    if problems:
        raise RuntimeError(str(problems))
    outs = [spark.read.parquet(paths[n]).select(F.lit(n).alias("rule"), us(F.col("window_start").cast("timestamp")).alias("start_us"), "v") for n in ("totals", "errors")]
    return outs[0].unionByName(outs[1])


DAY_SQL = bin_sql("ts", 86400)


def days_of(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    days = e.select(F.date_trunc("day", "ts").alias("window_start")).distinct()
    return days.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL '1' DAY"))


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("window_start").agg(F.count("*").alias("n"))


@query(
    "W4_emptied_rerun",
    f"""SELECT {DAY_SQL} AS start_us, count(*) FILTER (value > 20) AS n FROM events GROUP BY 1 HAVING count(*) FILTER (value > 20) > 0""",
)
def w4_emptied(spark, d):
    """All days are rolled up, then again from fewer rows: days that lost all rows are cleared."""
    e, days = table(spark, d, "events"), days_of(spark, d)
    target, ledger = scratch_path(spark, "rollup"), scratch_path(spark, "ledger")
    for rows in (e, e.filter("value > 20")):
        plans.run_rollup(rows, days, _counted, target, ledger, "daily")
    return spark.read.parquet(target).select(us(F.col("window_start").cast("timestamp")).alias("start_us"), "n")


@query(
    "W4_shared_target",
    f"""SELECT 'all' AS rule, {DAY_SQL} AS start_us, count(*) AS n FROM events GROUP BY 2
    UNION ALL SELECT 'errors', {DAY_SQL}, count(*) FROM events WHERE event_type = 'error' GROUP BY 2""",
)
def w4_shared(spark, d):
    e, days = table(spark, d, "events"), days_of(spark, d)
    target, ledger = scratch_path(spark, "rollup"), scratch_path(spark, "ledger")
    for name, rows in (("all", e), ("errors", e.filter("event_type = 'error'"))):
        plans.run_rollup(rows, days, _counted, target, ledger, name)
    return spark.read.parquet(target).select("rule", us(F.col("window_start").cast("timestamp")).alias("start_us"), "n")


@query(
    "W4_mixed_lengths",
    f"""WITH w AS (SELECT DISTINCT {DAY_SQL} AS s, {DAY_SQL} + 86400000000 AS e FROM events
      UNION SELECT DISTINCT {bin_sql("ts", 600)}, {bin_sql("ts", 600)} + 600000000 FROM events WHERE event_type = 'error'
      UNION SELECT min({DAY_SQL}), min({DAY_SQL}) + 30 * 86400000000 FROM events)
    SELECT s AS start_us, e AS end_us, count(*) AS n FROM w JOIN events ON epoch_us(ts) >= s AND epoch_us(ts) < e GROUP BY 1, 2""",
)
def w4_mixed(spark, d):
    """Windows of ten minutes, a day and thirty days in one run."""
    e = table(spark, d, "events")
    short = e.filter("event_type = 'error'").select(time_bin(F.col("ts"), 600).alias("window_start")).distinct()
    days = days_of(spark, d)
    long = days.agg(F.min("window_start").alias("window_start")).withColumn("window_end", F.col("window_start") + F.expr("INTERVAL '30' DAY"))
    windows = days.unionByName(short.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL '10' MINUTE"))).unionByName(long)
    out = plans.rollup_windows(e, windows, lambda df: df.groupBy("window_start", "window_end").agg(F.count("*").alias("n")))
    return out.select(us("window_start").alias("start_us"), us("window_end").alias("end_us"), "n")


@query(
    "W10_time_columns",
    f"""WITH t AS (SELECT *, ts + INTERVAL 40 DAY AS seen FROM events)
    SELECT 'by_ts' AS rule, {DAY_SQL} AS start_us, count(*) AS n FROM t GROUP BY 2
    UNION ALL SELECT 'by_seen', {bin_sql("seen", 86400)}, count(*) FROM t GROUP BY 2""",
)
def w10_time_columns(spark, d):
    """Two rules of one source, each with a time column of its own."""
    e = table(spark, d, "events").withColumn("seen", F.col("ts") + F.expr("INTERVAL '40' DAY"))
    days = days_of(spark, d).withColumn("rule", F.lit("by_ts"))
    moved = days.select(*[(F.col(c) + F.expr("INTERVAL '40' DAY")).alias(c) for c in ("window_start", "window_end")], F.lit("by_seen").alias("rule"))
    target = scratch_path(spark, "rollup")
    rules = [plans.RollupRule("by_ts", "events", _counted, target), plans.RollupRule("by_seen", "events", _counted, target, ts="seen")]
    problems = {k: v for k, v in plans.run_rules(rules, {"events": e}, days.unionByName(moved), scratch_path(spark, "ledger")).items() if v}
    if problems:
        raise RuntimeError(str(problems))
    return spark.read.parquet(target).select("rule", us(F.col("window_start").cast("timestamp")).alias("start_us"), "n")


@query(
    "W10_outcomes",
    """WITH n AS (SELECT count(DISTINCT date_trunc('day', ts)) AS days FROM events)
    SELECT rule, CAST(submitted AS BIGINT) AS submitted, CAST(completed AS BIGINT) AS completed, CAST(failed AS BIGINT) AS failed, CAST(retried AS BIGINT) AS retried, CAST(rows AS BIGINT) AS rows FROM (
      SELECT 'broken' AS rule, days AS submitted, 0 AS completed, days AS failed, days AS retried, 0 AS rows FROM n
      UNION ALL SELECT 'good', days, days, 0, days, days FROM n
      UNION ALL SELECT 'labelled', days, days, 0, days, (SELECT count(DISTINCT date_trunc('day', ts)) FROM events WHERE event_type = 'error') FROM n)""",
)
def w10_outcomes(spark, d):
    """A sound rule, one that fails at run time and one in SQL with a label, run twice; what their health then says."""
    e, days = table(spark, d, "events"), days_of(spark, d)
    e.createOrReplaceTempView("events_of_rules")
    names = ("good", "broken", "labelled")
    paths = {n: scratch_path(spark, f"rule-{n}") for n in (*names, "ledger")}
    text = """SELECT count(*) AS n FROM events_of_rules WHERE ts >= :_startTime AND ts < :_endTime AND event_type = :_kind HAVING count(*) > 0"""
    bodies = {"good": _counted, "broken": lambda df: _counted(df.filter(F.raise_error(F.lit("broken")).cast("boolean"))), "labelled": text}
    rules = [plans.RollupRule(n, "events", bodies[n], paths[n], labels={"kind": "error"}, reads={"events_of_rules": "ts"}) for n in names]
    windows = days.withColumn("rule", F.explode(F.array(*[F.lit(n) for n in names])))
    for _ in range(2):
        plans.run_rules(rules, {"events": e}, windows, paths["ledger"])
    state = plans.ledger_state(spark.read.parquet(paths["ledger"]))
    known = spark.createDataFrame([(n, 86_400, 0) for n in names], "rule string, interval_s int, delay_s int")
    known = known.withColumns({"last_end": F.lit(None).cast("timestamp"), "managed": F.lit(True), "selected": F.lit(True)})
    health = plans.rule_health(known, state, NOW)
    rows = None
    for n in ("good", "labelled"):
        part = spark.read.parquet(paths[n]).select("rule")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.groupBy("rule").agg(F.count("*").alias("rows"))
    return health.join(rows, "rule", "left").fillna(0, ["rows"]).select("rule", "submitted", "completed", "failed", "retried", "rows")


@query(
    "W4_sql_windows",
    """WITH w AS (SELECT unnest(range((SELECT min(epoch_us(ts)) // 600000000 * 600000000 FROM events), (SELECT max(epoch_us(ts)) FROM events) + 1, 600000000)) AS s),
      counted AS (SELECT epoch_us(ts) // 600000000 * 600000000 AS s, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 6) AS total FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT w.s AS start_us, coalesce(n, 0) AS n, coalesce(users, 0) AS users, total FROM w LEFT JOIN counted USING (s)""",
)
def w4_sql_windows(spark, d):
    """A body in SQL for every ten minutes of the table, empty ones included, in one plan."""
    e = table(spark, d, "events")
    e.createOrReplaceTempView("events_of_windows")
    ends = e.agg(time_bin(F.min("ts"), 600).alias("lo"), time_bin(F.max("ts"), 600).alias("hi"))
    starts = ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL '10' MINUTE"))).alias("window_start"))
    windows = starts.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL '10' MINUTE"))
    body = """SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 6) AS total
    FROM events_of_windows WHERE ts >= :_startTime AND ts < :_endTime AND event_type <> :_kind -- ':_endTime' is open"""
    out = plans.rollup_windows_sql(spark, body, windows, {"kind": "error"}, {"events_of_windows": "ts"})
    return out.select(us("window_start").alias("start_us"), "n", "users", "total")


SHARED = {
    "all": plans.Totals({"n": "count(*)", "total": "sum(value)"}),
    "by_type": plans.Totals({"n": "count(*)", "total": "sum(value)"}, ("event_type",)),
    "errors": plans.Totals({"n": "count(*)", "total": "max(value)"}, where="event_type = 'error'"),
    "by_user": plans.Totals({"n": "count(*)", "total": "min(value)"}, ("user_id", "event_type"), "value > 20"),
}


@query(
    "W10_shared_scan",
    f"""SELECT 'all' AS rule, {DAY_SQL} AS start_us, NULL AS event_type, NULL AS user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 2
    UNION ALL SELECT 'by_type', {DAY_SQL}, event_type, NULL, count(*), round(sum(value), 6) FROM events GROUP BY 2, 3
    UNION ALL SELECT 'errors', {DAY_SQL}, NULL, NULL, count(*), round(max(value), 6) FROM events WHERE event_type = 'error' GROUP BY 2
    UNION ALL SELECT 'by_user', {bin_sql("ts", 21600)}, event_type, user_id, count(*), round(min(value), 6) FROM events WHERE value > 20 GROUP BY 2, 3, 4""",
)
def w10_shared(spark, d):
    """Four rules of one source, one with windows of its own length, from one scan."""
    e, days = table(spark, d, "events"), days_of(spark, d)
    quarters = e.select(time_bin(F.col("ts"), 21_600).alias("window_start")).distinct().withColumn("window_end", F.col("window_start") + F.expr("INTERVAL '6' HOUR"))
    daily = days.withColumn("rule", F.explode(F.array(*[F.lit(n) for n in SHARED if n != "by_user"])))
    paths = {n: scratch_path(spark, f"rule-{n}") for n in (*SHARED, "ledger")}
    rules = [plans.RollupRule(n, "events", body, paths[n]) for n, body in SHARED.items()]
    problems = {k: v for k, v in plans.run_rules(rules, {"events": e}, daily.unionByName(quarters.withColumn("rule", F.lit("by_user"))), paths["ledger"]).items() if v}
    if problems:
        raise RuntimeError(str(problems))
    outs = []
    for n, body in SHARED.items():
        rows = spark.read.parquet(paths[n])
        dims = [(F.col(c) if c in body.by else F.lit(None)).cast(t).alias(c) for c, t in (("event_type", "string"), ("user_id", "bigint"))]
        outs.append(rows.select(F.lit(n).alias("rule"), us(F.col("window_start").cast("timestamp")).alias("start_us"), *dims, "n", r6(F.col("total")).alias("total")))
    return reduce(DataFrame.unionByName, outs)
