"""Metric sources and relabelling over the events table."""

from __future__ import annotations

from datetime import datetime, timezone

import xxhash
from pyspark.sql import functions as F

from tidemark.functions.labels import entries, label_text
from tidemark.functions.names import metric_table_name, normalize_identifier, normalize_metric_name
from tidemark.operators import relabel
from tidemark.schemas import METRICS_COLUMNS, with_lifted
from tidemark.session import scratch_path
from tidemark.sources.external import import_table
from tidemark.sources.prometheus import explode_series, parse_prometheus_lines
from tidemark.sources.typed_csv import read_typed_csv
from tidemark.sinks.evolving import read_evolving
from tidemark.workload.adapters import DB, METRIC_LABELS, METRIC_SQL, PREFIX, metric_samples, node_meta, sql_text, table, us
from tidemark.workload.registry import query

SCRAPE = datetime(2024, 2, 1, tzinfo=timezone.utc)
LABELS_SQL = sql_text(*METRIC_LABELS)


def _exposition_lines(spark, d):
    e = table(spark, d, "events")
    sample = F.concat(
        F.lit("app_"), "event_type", F.lit('_total{user="'), F.col("user_id").cast("string"), F.lit('",path="C:\\\\dir\\n\\"q\\""} '),
        F.when(F.col("event_id") % 13 == 0, F.lit("+Inf")).otherwise(F.col("value").cast("string")),
        F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.unix_millis("ts").cast("string"))),
    )
    line = (
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit(" # HELP "), "event_type"))
        .when(F.col("event_id") % 10 == 1, F.lit("  "))
        .when(F.col("event_id") % 11 == 0, F.concat("event_type", F.lit('{user="1'), F.col("user_id").cast("string")))
        .otherwise(sample)
    )
    return e.select("event_id", line.alias("value"))


@query(
    "S1_prometheus_text",
    r"""SELECT event_id, 'app_' || event_type || '_total' AS name,
      'path=C:\dir' || chr(10) || '"q";user=' || CAST(user_id AS VARCHAR) || ';' AS labels,
      event_id % 13 = 0 AS is_inf, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value,
      CASE WHEN event_id % 7 = 0 THEN 1706745600000 ELSE epoch_us(ts) // 1000 END AS ts_ms
    FROM events WHERE event_id % 10 > 1 AND event_id % 11 <> 0""",
)
def s1(spark, d):
    samples, _ = parse_prometheus_lines(_exposition_lines(spark, d), SCRAPE)
    is_inf = F.col("value") == F.lit(float("inf"))
    return samples.select(
        "event_id", "name", label_text(F.col("labels")).alias("labels"), is_inf.alias("is_inf"),
        F.when(~is_inf, F.col("value")).alias("value"), F.unix_millis("ts").alias("ts_ms"),
    )


@query(
    "S1_prometheus_rejects",
    """SELECT event_id, event_type || '{user="1' || CAST(user_id AS VARCHAR) AS line
    FROM events WHERE event_id % 10 > 1 AND event_id % 11 = 0""",
)
def s1_rejects(spark, d):
    return parse_prometheus_lines(_exposition_lines(spark, d), SCRAPE)[1].select("event_id", "line")


@query(
    "S2_typed_csv",
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE epoch_us(o_orderdate) END AS ts_us, o_orderkey AS series_id,
      '{"p":"' || o_orderpriority || '"}' AS labels, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS value,
      o_orderstatus AS status
    FROM orders""",
)
def s2(spark, d):
    o = table(spark, d, "orders")
    path = scratch_path(spark, "typed-csv")
    o.select(
        F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("Timestamp:datetime"),
        F.col("o_orderkey").alias("SeriesId:long"),
        F.concat(F.lit('{"p":"'), "o_orderpriority", F.lit('"}')).alias("Labels:dynamic"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("Value:real"),
        F.col("o_orderstatus").alias("Status:string"),
    ).write.csv(path, header=True, escape='"', nullValue="")
    rows = read_typed_csv(spark, path)
    return rows.select(
        us("Timestamp").alias("ts_us"), F.col("SeriesId").alias("series_id"), F.col("Labels").alias("labels"),
        F.col("Value").alias("value"), F.col("Status").alias("status"),
    )


@query(
    "S3_explode_series",
    f"""WITH {METRIC_SQL}
    SELECT name, {sql_text(("user", "l_user"), ("k", "l_k"))} AS labels, epoch_us(ts) // 1000 + 1000 * i AS ts_ms, value * (i + 1) AS value
    FROM metric, (VALUES (0), (1)) AS t(i)""",
)
def s3(spark, d):
    m = metric_samples(spark, d)
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    at = lambda i: F.struct((F.unix_millis("ts") + 1000 * i).alias("timestamp"), (F.col("value") * (i + 1)).alias("value"))
    batch = m.select(
        F.array(pair("__name__", F.col("name")), pair("user", F.col("labels")["user"]), pair("k", F.col("labels")["k"])).alias("labels"),
        F.array(at(0), at(1)).alias("samples"),
    )
    return explode_series(batch).select(
        "name", label_text(F.col("labels")).alias("labels"), F.unix_millis("ts").alias("ts_ms"), "value"
    )


@query(
    "S9_import_table",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""",
)
def s9(spark, d):
    path = scratch_path(spark, "import")
    lo, hi = datetime(1996, 1, 1, tzinfo=timezone.utc), datetime(1999, 1, 1, tzinfo=timezone.utc)
    import_table(table(spark, d, "orders"), path, "o_orderdate", lo, hi, ["o_orderkey", "o_totalprice"])
    return read_evolving(spark, path)


KEEP_RULES = relabel.MetricFilter(drop=["_err", "^app_v"], keep=["^app_error"])
DROP_RULES = relabel.MetricFilter(default_drop=True, drop=["signup"], keep=["^app_click"], keep_by_label=[("^Reg", "^r[12]$")])


@query(
    "F1_filter_metrics_default_keep",
    f"WITH {METRIC_SQL} SELECT event_id, name FROM metric WHERE NOT regexp_matches(name, '_err') AND NOT regexp_matches(name, '^app_v')",
)
def f1_keep(spark, d):
    return relabel.filter_metrics(metric_samples(spark, d), KEEP_RULES).select("event_id", "name")


@query(
    "F1_filter_metrics_default_drop",
    f"""WITH {METRIC_SQL} SELECT event_id, name FROM metric
    WHERE name NOT LIKE '%signup%' AND (name LIKE 'app_click%' OR l_region IN ('r1', 'r2'))""",
)
def f1_drop(spark, d):
    return relabel.filter_metrics(metric_samples(spark, d), DROP_RULES).select("event_id", "name")


@query("F2_allow_databases", f"WITH {METRIC_SQL} SELECT event_id, name FROM metric WHERE l_db = 'Metrics'")
def f2(spark, d):
    return relabel.allow_databases(metric_samples(spark, d), ["Metrics", "Other"]).select("event_id", "name")


@query(
    "F3_drop_labels",
    f"""WITH {METRIC_SQL} SELECT event_id, CASE WHEN name LIKE '%click%'
      THEN {sql_text(("Region", "l_region"), (DB, "l_db"))}
      WHEN name LIKE 'app_view%' THEN {sql_text(("user", "l_user"), ("k", "l_k"), (DB, "l_db"))}
      ELSE {LABELS_SQL} END AS labels FROM metric""",
)
def f3(spark, d):
    out = relabel.drop_labels(metric_samples(spark, d), [("click", "^(user|k)$"), ("^app_view", "^Reg")])
    return out.select("event_id", label_text(F.col("labels")).alias("labels"))


@query(
    "F4_add_labels",
    f"WITH {METRIC_SQL} SELECT event_id, {sql_text(('user', 'l_user'), ('k', chr(39) + 'fixed' + chr(39)), ('Region', 'l_region'), (DB, 'l_db'), ('env', chr(39) + 'prod' + chr(39)))} AS labels FROM metric",
)
def f4(spark, d):
    out = relabel.add_labels(metric_samples(spark, d), {"env": "prod", "k": "fixed"})
    return out.select("event_id", label_text(F.col("labels")).alias("labels"))


@query(
    "F5_enrich_labels",
    f"""WITH {METRIC_SQL}, meta AS (SELECT n_nationkey, r_name, CASE WHEN n_nationkey % 2 = 0 THEN 'rack' || CAST(n_regionkey AS VARCHAR) ELSE '' END AS rack
      FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT event_id, {sql_text(("user", "l_user"), ("k", "l_k"), ("Region", "coalesce(r_name, '')"), (DB, "l_db"), ("rack_id", "coalesce(rack, '')"))} AS labels
    FROM metric LEFT JOIN meta ON n_nationkey = CAST(l_user AS BIGINT)""",
)
def f5(spark, d):
    m = metric_samples(spark, d).withColumn("node", F.col("labels")["user"].cast("bigint"))
    out = relabel.enrich_labels(m, node_meta(spark, d), {"zone": "Region"}, {"rack": "rack_id"})
    return out.select("event_id", label_text(F.col("labels")).alias("labels"))


@query(
    "F6_attach_target",
    f"""WITH {METRIC_SQL} SELECT event_id, CASE WHEN c_custkey IS NULL THEN {sql_text(("user", "l_user"), ("k", "l_k"), ("Region", "l_region"))}
      WHEN c_custkey % 4 = 0 THEN {sql_text(("user", "l_user"), ("k", "l_k"), ("Region", "l_region"), (PREFIX + "namespace", "lower(c_mktsegment)"))}
      ELSE {sql_text(("user", "l_user"), ("k", "l_k"), ("Region", "l_region"), (PREFIX + "namespace", "lower(c_mktsegment)"), (PREFIX + "pod", "c_name"))} END AS labels
    FROM metric LEFT JOIN customer ON c_custkey = CAST(l_user AS BIGINT)""",
)
def f6(spark, d):
    m = metric_samples(spark, d).withColumn("target", F.col("labels")["user"].cast("bigint"))
    targets = table(spark, d, "customer").select(
        F.col("c_custkey").alias("target"), F.lower("c_mktsegment").alias("namespace"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.col("c_name")).alias("pod"), F.lit("").alias("container"),
    )
    return relabel.attach_target(m, targets).select("event_id", label_text(F.col("labels")).alias("labels"))


@query(
    "F7_sort_labels",
    f"WITH {METRIC_SQL} SELECT event_id, '__name__=' || name || ';k=' || l_k || ';Region=' || l_region || ';{DB}=' || l_db || ';user=' || l_user || ';' AS ordered FROM metric",
)
def f7(spark, d):
    ordered = F.transform(entries(F.col("name"), F.col("labels")), lambda e: F.concat(e["name"], F.lit("="), e["value"], F.lit(";")))
    return metric_samples(spark, d).select("event_id", F.array_join(ordered, "").alias("ordered"))


@query(
    "F8_series_id",
    f"WITH {METRIC_SQL} SELECT name, l_user AS usr, count(DISTINCT l_k) AS series, count(*) AS samples FROM metric GROUP BY 1, 2",
)
def f8(spark, d):
    ids = relabel.with_series_id(metric_samples(spark, d))
    return ids.groupBy("name", F.col("labels")["user"].alias("usr")).agg(
        F.count_distinct("series_id").alias("series"), F.count("*").alias("samples")
    )


@query(
    "F9_lift_labels",
    f"WITH {METRIC_SQL} SELECT event_id, l_region AS region, '' AS pod, {sql_text(('user', 'l_user'), ('k', 'l_k'))} AS labels FROM metric",
)
def f9(spark, d):
    out = relabel.lift_labels(metric_samples(spark, d), ["region", "pod"])
    return out.select("event_id", "region", "pod", label_text(F.col("labels")).alias("labels"))


NAME_SQL = "substr(array_to_string(list_transform(regexp_split_to_array({0}, '[^A-Za-z0-9]'), lambda t: upper(t[1:1]) || t[2:]), ''), 1, 1024)"


@query("F10_metric_table_name", f"SELECT doc_id, {NAME_SQL.format('text')} AS table_name FROM documents")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", metric_table_name(F.col("text")).alias("table_name"))


@query("F11_normalize_identifier", "SELECT doc_id, substr(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'), 1, 1024) AS identifier FROM documents")
def f11(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize_identifier(F.col("text")).alias("identifier"))


def _base36(n: int) -> str:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = digits[r] + out
    return out or "0"


SCHEMA_ID = _base36(xxhash.xxh64_intdigest("".join(n + k for n, k in with_lifted(METRICS_COLUMNS, ["Region"]))))


@query(
    "F13_route_metrics",
    f"""WITH {METRIC_SQL} SELECT event_id, l_db AS database, {NAME_SQL.format("name")} AS table_name, '{SCHEMA_ID}' AS schema_id
    FROM metric WHERE l_db <> ''""",
)
def f13(spark, d):
    ok, _ = relabel.route_metrics(metric_samples(spark, d), ["Region"])
    return ok.select("event_id", "database", F.col("table").alias("table_name"), "schema_id")


@query("F13_route_metrics_rejects", f"WITH {METRIC_SQL} SELECT event_id, 'database label not found' AS reason FROM metric WHERE l_db = ''")
def f13_rejects(spark, d):
    return relabel.route_metrics(metric_samples(spark, d))[1].select("event_id", "reason")


@query(
    "F14_drop_destinations",
    f"""WITH {METRIC_SQL} SELECT event_id, {NAME_SQL.format("name")} AS table_name FROM metric
    WHERE l_db <> '' AND name NOT LIKE 'app_c%' AND name NOT LIKE 'app_purchase%'""",
)
def f14(spark, d):
    ok, _ = relabel.route_metrics(metric_samples(spark, d))
    out = relabel.drop_destinations(ok, ["Metrics_AppC", "Metrics_AppPurchaseT", "Nothing"])
    return out.select("event_id", F.col("table").alias("table_name"))


@query(
    "X2_normalize_metric_name",
    """SELECT doc_id, CASE WHEN n = '' THEN NULL WHEN regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END AS metric_name FROM (
      SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'),
        '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS n FROM documents)""",
)
def x2(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize_metric_name(F.col("text")).alias("metric_name"))
