"""Rollups, percentiles, latest rows, dense series, views over the benchmark tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.timebin import in_window
from tidemark.operators import aggregate as agg
from tidemark.operators.views import create_log_view, trace_ids, trace_spans
from tidemark.operators.logs import encode_native_logs
from tidemark.session import stored
from tidemark.sources.spans import spans_to_logs
from tidemark.workload.adapters import COUNTER_SQL, LOG_SQL, METRIC_SQL, counters, log_rows, metric_samples, r6, table, us
from tidemark.workload.logs import SPAN_SQL, spans
from tidemark.workload.registry import query


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def bin_sql(ts: str, step: int) -> str:
    return f"(epoch_us({ts}) // {step * 1_000_000} * {step * 1_000_000})"


@query(
    "Q1_in_window",
    "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'",
)
def q1(spark, d):
    e = table(spark, d, "events")
    return e.filter(in_window(F.col("ts"), utc(2024, 1, 5), utc(2024, 1, 12))).select("event_id", "value")


HOURLY_SQL = f"""SELECT {bin_sql("ts", 3600)} AS bin_us, event_type, round(avg(value), 6) AS avg_value, max(value) AS max_value,
      min(value) AS min_value, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY 1, 2"""


@query("Q2_rollup_hourly", HOURLY_SQL)
def q2(spark, d):
    v = F.col("value")
    aggs = {"avg_value": r6(F.avg(v)), "max_value": F.max(v), "min_value": F.min(v), "total": r6(F.sum(v)), "n": F.count("*")}
    out = agg.rollup(table(spark, d, "events"), 3600, ["event_type"], aggs)
    return out.withColumn("bin_us", us("bin")).drop("bin")


@query(
    "Q2_rollup_daily_facts",
    f"""SELECT {bin_sql("l_shipdate", 86400)} AS bin_us, l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS quantity,
      round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, max(l_extendedprice) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
)
def q2_facts(spark, d):
    aggs = {
        "quantity": r6(F.sum("l_quantity")), "revenue": F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4),
        "high": F.max("l_extendedprice"), "n": F.count("*"),
    }
    out = agg.rollup(table(spark, d, "lineitem"), 86400, ["l_returnflag", "l_linestatus"], aggs, ts="l_shipdate")
    return out.withColumn("bin_us", us("bin")).drop("bin")


@query(
    "Q3_error_rate",
    """SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors,
      round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6) AS error_rate FROM events GROUP BY 1""",
)
def q3(spark, d):
    out = agg.error_rate(table(spark, d, "events"), F.col("event_type") == "error", ["user_id"])
    return out.withColumn("error_rate", r6(F.col("error_rate")))


@query(
    "Q4_service_health",
    f"""WITH m AS (SELECT {bin_sql("ts", 300)} AS b, 's' || CAST(user_id % 5 AS VARCHAR) AS service, value FROM events WHERE event_type IN ('click', 'purchase')),
      l AS (SELECT {bin_sql("ts", 300)} AS b, 's' || CAST(user_id % 5 AS VARCHAR) AS service, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2)
    SELECT m.service, m.b AS bin_us, round(sum(value), 6) AS request_count, round(avg(value / 2), 6) AS avg_duration, CAST(coalesce(sum(n), 0) AS BIGINT) AS error_count, coalesce(max(n), 0) AS errors
    FROM m LEFT JOIN l ON l.b = m.b AND l.service = m.service GROUP BY 1, 2""",
)
def q4(spark, d):
    e = table(spark, d, "events").withColumn("service", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")))
    metrics = e.filter(F.col("event_type").isin("click", "purchase")).withColumn("duration", F.col("value") / 2)
    logs = e.filter(F.col("event_type").isin("error", "signup"))
    out = agg.service_health(metrics, logs, 300)
    return out.select(
        "service", us("bin").alias("bin_us"), r6(F.col("request_count")).alias("request_count"), r6(F.col("avg_duration")).alias("avg_duration"),
        "error_count", "errors",
    )


def _delays(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    late = (F.col("l_extendedprice") * 1000).cast("bigint")
    return li.select(F.col("l_shipdate").alias("observed_ts"), F.timestamp_micros(us("l_shipdate") + late).alias("ingested_ts"))


@query(
    "Q5_ingestion_delay_exact",
    """SELECT CAST(p AS DOUBLE) AS percentile, CAST(CASE p WHEN 50 THEN a WHEN 90 THEN b WHEN 99 THEN c ELSE m END AS DOUBLE) AS delay_us
    FROM (SELECT quantile_disc(x, 0.5) AS a, quantile_disc(x, 0.9) AS b, quantile_disc(x, 0.99) AS c, max(x) AS m
          FROM (SELECT CAST(trunc(l_extendedprice * 1000) AS BIGINT) AS x FROM lineitem)), (VALUES (50.0), (90.0), (99.0), (100.0)) AS t(p)""",
)
def q5(spark, d):
    out = agg.ingestion_delay_percentiles(_delays(spark, d), exact=True)
    return out.withColumn("percentile", F.round("percentile", 3))


@query("Q5_ingestion_delay_sketch")
def q5_sketch(spark, d):
    return agg.ingestion_delay_percentiles(_delays(spark, d))


@query(
    "Q6_latest_by",
    """SELECT o_custkey, epoch_us(o_orderdate) AS ts_us, o_totalprice, o_orderstatus FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderstatus DESC) AS n FROM orders) WHERE n = 1""",
)
def q6(spark, d):
    out = agg.latest_by(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", ["o_totalprice", "o_orderstatus"])
    return out.select("o_custkey", us("o_orderdate").alias("ts_us"), "o_totalprice", "o_orderstatus")


def _event_tables(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("table"), F.col("ts").alias("Timestamp"), F.col("user_id").alias("SeriesId"))


@query(
    "Q7_count_cardinality",
    """SELECT event_type AS table_name, CAST(count(DISTINCT user_id) AS DOUBLE) AS value, epoch_us(TIMESTAMP '2024-01-20 12:34:00') AS ts_us
    FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:34:56' AND ts < TIMESTAMP '2024-01-20 12:29:56' GROUP BY 1""",
)
def q7(spark, d):
    out = agg.count_cardinality(_event_tables(spark, d), utc(2024, 1, 20, 12, 34, 56), since_s=864_000, exact=True)
    return out.select(F.col("Labels")["table"].alias("table_name"), F.col("Value").alias("value"), us("Timestamp").alias("ts_us"))


@query("Q7_count_cardinality_sketch")
def q7_sketch(spark, d):
    out = agg.count_cardinality(_event_tables(spark, d), utc(2024, 1, 31), since_s=40 * 86_400)
    return out.select(F.col("Labels")["table"].alias("table_name"), F.col("Value").alias("value"))


@query(
    "Q7_sketch_bound",
    """SELECT event_type AS table_name, count(DISTINCT user_id) AS series, true AS within FROM events GROUP BY 1""",
)
def q7_bound(spark, d):
    """Whether the sketch form is within three per cent of the exact count of each table."""
    tables = _event_tables(spark, d)
    sketch, exact = (agg.count_cardinality(tables, utc(2024, 3, 1), since_s=70 * 86_400, exact=e).select("Labels", F.col("Value").alias(n)) for n, e in (("about", False), ("exact", True)))
    key = F.col("Labels")["table"].alias("table_name")
    both = sketch.select(key, "about").join(exact.select(key, "exact"), "table_name", "full")
    return both.select("table_name", F.col("exact").cast("bigint").alias("series"), _within("about", "exact"))


def _within(about: str, exact: str) -> Column:
    return F.coalesce(F.abs(F.col(about) - F.col(exact)) <= 0.03 * F.col(exact), F.lit(False)).alias("within")


@query(
    "V3_distinct_layers",
    f"""SELECT {bin_sql("ts", 86400)} AS bin_us, event_type, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1, 2""",
)
def v3_distinct(spark, d):
    """Users per day from hourly sketches that were stored, within three per cent of the exact count."""
    e = table(spark, d, "events")
    hourly = stored(agg.rollup_distinct(e, 3600, ["event_type"], "user_id"), "hourly-sketches")
    daily = agg.distinct_estimate(agg.reaggregate_distinct(hourly, 86_400, ["event_type"]))
    exact = agg.rollup(e, 86_400, ["event_type"], {"users": F.count_distinct("user_id")})
    return daily.join(exact, ["bin", "event_type"], "full").select(us("bin").alias("bin_us"), "event_type", "users", _within("distinct", "users"))


@query(
    "Q5_sketch_bound",
    """SELECT CAST(p AS DOUBLE) AS percentile, true AS within FROM (VALUES (50.0), (90.0), (99.0), (100.0)) AS t(p)""",
)
def q5_bound(spark, d):
    """Whether the rank of each percentile of the sketch form is within one row in 10,000, and a row, of the wanted rank."""
    delays = _delays(spark, d)
    found = agg.ingestion_delay_percentiles(delays).collect()
    x = F.unix_micros("ingested_ts") - F.unix_micros("observed_ts")
    counts = [F.struct(F.lit(r["percentile"]).alias("percentile"), F.count_if(x < r["delay_us"]).alias("lo"), F.count_if(x <= r["delay_us"]).alias("hi")) for r in found]
    ranks = delays.agg(F.array(*counts).alias("r"), F.count("*").alias("n")).select("n", F.inline("r"))
    rank, slack = F.col("n") * F.col("percentile") / 100, F.col("n") / 10_000 + 1
    return ranks.select(F.round("percentile", 3).alias("percentile"), ((F.col("lo") - slack <= rank) & (rank <= F.col("hi") + slack)).alias("within"))


@query(
    "Q9_unused_tables",
    """WITH s AS (SELECT user_id AS t, date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1, 2),
      f AS (SELECT t, max(CASE WHEN n > 0 THEN day END) AS filled FROM s GROUP BY 1)
    SELECT 'user_' || CAST(s.t AS VARCHAR) AS table_name, count(*) AS empty_snapshots, epoch_us(min(day)) AS since_us
    FROM s JOIN f ON f.t = s.t WHERE n = 0 AND (filled IS NULL OR day > filled) GROUP BY 1 HAVING count(*) > 2""",
)
def q9(spark, d):
    e = table(spark, d, "events")
    snapshots = e.groupBy(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("table"), F.date_trunc("day", "ts").alias("ts")).agg(
        F.count_if(F.col("event_type") == "error").alias("rows")
    )
    out = agg.unused_tables(snapshots)
    return out.select(F.col("table").alias("table_name"), "empty_snapshots", us("empty_since").alias("since_us"))


@query(
    "Q10_make_series",
    """WITH g AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'),
      b AS (SELECT unnest(range(20)) AS i),
      c AS (SELECT event_type, user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-05')) // 21600000000 AS i, count(*) AS n, max(value) AS hi FROM events
            WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2, 3)
    SELECT g.event_type, g.user_id, string_agg(CAST(CAST(coalesce(n, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY b.i) AS series, round(max(coalesce(hi, 0)), 6) AS high
    FROM g CROSS JOIN b LEFT JOIN c ON c.event_type = g.event_type AND c.user_id = g.user_id AND c.i = b.i GROUP BY 1, 2""",
)
def q10(spark, d):
    out = agg.make_series(
        table(spark, d, "events"), utc(2024, 1, 5), utc(2024, 1, 10), 21_600, ["event_type", "user_id"],
        {"n": F.count("*"), "hi": F.max("value")},
    )
    return out.select(
        "event_type", "user_id", F.array_join(F.transform("n", lambda x: x.cast("bigint").cast("string")), ",").alias("series"),
        r6(F.array_max("hi")).alias("high"),
    )


@query("Q11_distinct_values", "SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events")
def q11(spark, d):
    return agg.distinct_values(table(spark, d, "events"), F.get_json_object("props", "$.k").alias("k"))


@query(
    "Q12_project_paths",
    """SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_real,
      CAST(NULL AS VARCHAR) AS absent, epoch_us(ts) AS ts_us FROM events""",
)
def q12(spark, d):
    e = table(spark, d, "events")
    doc = F.concat(F.regexp_replace("props", "}$", ""), F.lit(',"ts":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('","id":'), F.col("event_id").cast("string"), F.lit("}"))
    out = agg.project_paths(
        e.select(doc.alias("Body")),
        {
            "event_id": ("Body", "$.id", "bigint"), "k_text": ("Body", "$.k", "string"), "k_real": ("Body", "$.k", "double"),
            "absent": ("Body", "$.none", "string"), "ts": ("Body", "$.ts", "timestamp"),
        },
    )
    return out.withColumn("ts_us", us("ts")).drop("ts")


@query(
    "Q13_text_filter",
    """SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') AND lang <> 'de' AND source IN (SELECT DISTINCT source FROM documents WHERE source <> 'zz')""",
)
def q13(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(agg.contains_ci(F.col("text"), "THE") & (F.col("lang") != "de") & (F.col("source") != "zz")).select("doc_id", "lang")


@query(
    "Q14_union_fuzzy",
    """SELECT 'orders' AS source, o_orderkey AS id, o_orderstatus AS status, NULL AS price FROM orders
    UNION ALL SELECT 'lines', l_orderkey, NULL, l_extendedprice FROM lineitem""",
)
def q14(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("id"))
    return agg.union_fuzzy({"orders": o, "missing": None, "lines": li}).select("source", "id", "status", "price")


@query("Q15_scalar_bound", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 3 DAY FROM events WHERE event_type = 'view')")
def q15(spark, d):
    e = table(spark, d, "events")
    bound = e.filter(F.col("event_type") == "view").agg(F.max("ts") - F.expr("INTERVAL '3' DAY")).scalar()
    return e.filter(F.col("ts") >= bound).select("event_id")


@query("Q16_top_n", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def q16(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return agg.top_n(li, 100, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))


@query(
    "Q18_clean_values",
    """SELECT event_id, value, CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'unknown' ELSE 'u' || CAST(user_id AS VARCHAR) END ELSE event_type END AS pod
    FROM events WHERE event_id % 10 > 2""",
)
def q18(spark, d):
    e = table(spark, d, "events")
    value = (
        F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(float("inf")))
        .when(F.col("event_id") % 10 == 2, F.lit(None).cast("double")).otherwise(F.col("value"))
    )
    rows = e.withColumns(
        {
            "value": value, "pod": F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(""),
            "pod_name": F.when(F.col("user_id") % 2 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))),
        }
    )
    return agg.clean_values(rows, fallbacks={"pod": ["pod", "pod_name"]}).select("event_id", "value", "pod")


STITCH_SQL = f"""SELECT {bin_sql("ts", 3600)} AS bin_us, event_type, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY 1, 2"""


def _stitched(spark, d, dedupe: bool) -> DataFrame:
    e = table(spark, d, "events")
    aggs = {"total": r6(F.sum("value")), "n": F.count("*")}
    stored = agg.rollup(e.filter(F.col("ts") < F.lit(utc(2024, 1, 15))), 3600, ["event_type"], aggs)
    out = agg.stitched_rollup(stored, e, 3600, ["event_type"], aggs, dedupe=dedupe)
    return out.withColumn("bin_us", us("bin")).drop("bin")


@query("V2_stitched_rollup", STITCH_SQL)
def v2(spark, d):
    return _stitched(spark, d, True)


@query(
    "V2_stitched_rollup_overlap",
    f"""WITH h AS ({STITCH_SQL}), s AS (SELECT * FROM h WHERE bin_us < epoch_us(TIMESTAMP '2024-01-15'))
    SELECT * FROM s UNION ALL SELECT * FROM h WHERE bin_us >= (SELECT max(bin_us) FROM s)""",
)
def v2_overlap(spark, d):
    return _stitched(spark, d, False)


@query(
    "V3_reaggregate",
    f"""SELECT {bin_sql("l_shipdate", 604800)} AS bin_us, l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS total, min(l_quantity) AS low,
      max(l_quantity) AS high, round(avg(l_quantity), 6) AS average FROM lineitem GROUP BY 1, 2""",
)
def v3(spark, d):
    daily = agg.rollup_partials(table(spark, d, "lineitem"), 86_400, ["l_returnflag"], "l_quantity", "l_shipdate")
    weekly = agg.reaggregate(daily, 604_800, ["l_returnflag"])
    return weekly.select(us("bin").alias("bin_us"), "l_returnflag", "n", r6(F.col("total")).alias("total"), "low", "high", r6(F.col("average")).alias("average"))


@query(
    "V1_log_view",
    f"""WITH {LOG_SQL} SELECT msg, lvl, k, epoch_us(ts) AS ts_us, CAST(NULL AS VARCHAR) AS pod FROM log WHERE lvl = 'ERROR'""",
)
def v1(spark, d):
    logs = encode_native_logs(log_rows(spark, d), now_ns=0)
    view = create_log_view(
        spark, "app_view", logs,
        {
            "msg": ("Body", "$.msg", "string"), "lvl": ("Body", "$.lvl", "string"), "ts": ("Body", "$.ts", "timestamp"),
            "k": ("Body", "$.k", "bigint"), "pod": ("Resource", "$.pod", "string"),
        },
    )
    return view.filter(F.col("lvl") == "ERROR").withColumn("ts_us", us("ts")).drop("ts")


TRACE_SQL = f"""WITH {SPAN_SQL} SELECT trace_id AS "traceID", span_id AS "spanID", parent AS "parentSpanID", service AS "serviceName", name AS "operationName",
      start_us, end_us - start_us AS duration, '{{"kind":"' || kind || '"}}' AS tags FROM span"""


@query("V4_trace_spans", TRACE_SQL)
def v4(spark, d):
    out = trace_spans(spans_to_logs(spans(spark, d)))
    return out.withColumn("start_us", us("startTime")).drop("startTime", "timestamp")


@query("V4_one_trace", TRACE_SQL + " WHERE trace_id = printf('%032x', 33)")
def v4_one(spark, d):
    out = trace_spans(spans_to_logs(spans(spark, d)), f"{33:032x}")
    return out.withColumn("start_us", us("startTime")).drop("startTime", "timestamp")


@query(
    "V5_trace_ids",
    f"""WITH {SPAN_SQL} SELECT DISTINCT trace_id AS "traceID" FROM span
    WHERE end_us >= epoch_us(TIMESTAMP '1996-01-01') AND end_us < epoch_us(TIMESTAMP '1997-01-01')""",
)
def v5(spark, d):
    return trace_ids(spans_to_logs(spans(spark, d)), utc(1996, 1, 1), utc(1997, 1, 1))


__all__ = ["COUNTER_SQL", "METRIC_SQL", "counters", "metric_samples"]
