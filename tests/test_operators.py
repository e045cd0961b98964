"""Operators on small hand-made rows and against plain windows on skewed keys."""

import json
import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import aggregate, alerts, export, logs, relabel, series
from tidemark.plans import rules as plans
from tidemark.plans.windows import backfill_windows, missing_windows, newest_windows
from tidemark.sources.containers import parse_container_lines
from tidemark.sources.otlp_logs import flatten_otlp_logs, log_records
from tidemark.sources.otlp_metrics import flatten_otlp_metrics
from tidemark.streaming.jobs import split_late

UTC = timezone.utc


def metric_rows(spark):
    rows = [("cpu", {"host": "a", "env": "dev"}, 1.0), ("mem", {"host": "b"}, 2.0), ("disk_cpu", {"sys_database": "Db"}, 3.0), ("net", {}, 4.0)]
    return spark.createDataFrame(rows, "name string, labels map<string,string>, value double").withColumn("ts", F.lit(datetime(2024, 1, 1)))


@pytest.mark.parametrize(
    "cfg,kept",
    [
        (relabel.MetricFilter(), {"cpu", "mem", "disk_cpu", "net"}),
        (relabel.MetricFilter(drop=["cpu"], keep=["cpu"]), {"mem", "net"}),
        (relabel.MetricFilter(default_drop=True), set()),
        (relabel.MetricFilter(default_drop=True, keep=["^cpu", "m"]), {"cpu", "mem"}),
        (relabel.MetricFilter(default_drop=True, drop=["^cpu"], keep=["cpu"]), {"disk_cpu"}),
        (relabel.MetricFilter(default_drop=True, keep_by_label=[("^ho", "b|z")]), {"mem"}),
    ],
)
def test_filter_metrics(spark, cfg, kept):
    rows = metric_rows(spark)
    assert {r["name"] for r in relabel.filter_metrics(rows, cfg).collect()} == kept
    left = rows.filter(~relabel.metric_kept(cfg, F.col("name"), F.col("labels"))).count()
    assert left + len(kept) == rows.count()


def test_label_edits(spark):
    rows = metric_rows(spark)
    labels = {r["name"]: r["labels"] for r in relabel.add_labels(relabel.drop_labels(rows, [("cpu", "^h"), ("x", "env")]), {"env": "prod"}).collect()}
    assert labels == {"cpu": {"env": "prod"}, "mem": {"host": "b", "env": "prod"}, "disk_cpu": {"sys_database": "Db", "env": "prod"}, "net": {"env": "prod"}}
    ok, bad = relabel.route_metrics(rows)
    assert [(r["database"], r["table"]) for r in ok.collect()] == [("Db", "DiskCpu")] and bad.count() == 3


def test_stored_metrics_shape(spark):
    stored = relabel.to_metrics_table(metric_rows(spark), ["Host"])
    assert stored.columns == ["Timestamp", "SeriesId", "Labels", "Value", "Host"]
    assert {r["Host"]: r["Labels"] for r in stored.filter("Host != ''").collect()} == {"a": {"env": "dev"}, "b": {}}


def test_container_lines(spark):
    stamp, at = "2024-05-06T07:08:09.000000001Z", 1714979289000000001
    # A line is <time> <stdout or stderr> <P or F> <text>.
    parts = [("stdout", "P", "left "), ("stderr", "P", "warn"), ("stdout", "P", "middle "), ("stdout", "F", "right"), ("stderr", "F", ""), ("stdout", "P", "never ended")]
    cri = [" ".join([stamp, *p]) for p in parts]
    docker = [json.dumps({"log": t, "stream": "stdout", "time": stamp}) for t in ("left ", "middle ", "right\n", "no end")]
    whole = cri[3].split(" ")
    bad = [" ".join(whole[:n]) for n in (3, 1)] + [" ".join(whole[:2]) + " ", whole[0] + " ", " ".join(["yesterday", *whole[1:]]), json.dumps({"log": 1})]
    rows = [("cri", i, x) for i, x in enumerate(cri + bad)] + [("docker", i, x) for i, x in enumerate(docker + ['{"log":"x\\n","stream":"s"', "plain"])]
    df = spark.createDataFrame(rows, "file string, offset long, line string")
    parsed, rejects = parse_container_lines(df)
    assert rejects.count() == len(bad) + 2
    assert parsed.count() + rejects.count() == len(rows)
    joined = logs.reassemble_lines(parsed, ["file", "stream"], slice_width=2)
    got = {(r["file"], r["stream"], r["message"], r["time_ns"], r["parts"]) for r in joined.collect()}
    assert got == {("cri", "stdout", "left middle right", at, 3), ("cri", "stderr", "warn", at, 2), ("docker", "stdout", "left middle right", at, 3)}
    by_line, _ = parse_container_lines(df.filter("line NOT IN ('plain', '{\"log\": 1}')"), detect="line")
    assert by_line.count() == parsed.count()


def test_reassembly_keeps_all_bytes(spark):
    """A hot stream cut into many slices joins to the same text as a plain window."""
    rows = [("hot" if i % 3 else f"s{i % 7}", i, (i * i + i // 5) % 4 != 0, f"<{i}>") for i in range(4000)]
    df = spark.createDataFrame(rows, "stream string, offset long, is_partial boolean, message string")
    done = logs.reassemble_lines(df, ["stream"], slice_width=37)
    tail = logs.withheld_lines(df, ["stream"], slice_width=37)
    texts = {}
    for r in done.unionByName(tail, allowMissingColumns=True).select("stream", "offset", "message").collect():
        texts.setdefault(r["stream"], []).append((r["offset"], r["message"]))
    for stream, parts in texts.items():
        assert "".join(m for _, m in sorted(parts)) == "".join(m for s, _, _, m in rows if s == stream)


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**7])
def test_sliced_increase_equals_plain_window(spark, slice_seconds):
    start = datetime(2024, 1, 1)
    rows = [(1 if i % 3 else i % 50 + 2, start + timedelta(seconds=i * 11), float((i * 7919) % 1000 if i % 40 == 0 else i)) for i in range(3000)]
    rows += [(1, start + timedelta(days=30), float("nan"))]
    df = spark.createDataFrame(rows, "SeriesId long, Timestamp timestamp, Value double")
    w = Window.partitionBy("SeriesId").orderBy("Timestamp")
    v, p, n = F.col("Value"), F.lag("Value").over(w), F.lead("Value").over(w)
    clean = df.filter(~F.isnan("Value"))
    plain = clean.withColumn("Value", F.when(p.isNull(), 0.0).when(v < p, n - v).otherwise(v - p))
    assert sorted(map(tuple, series.increase(df, slice_seconds=slice_seconds).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_null_keys_keep_their_rows(spark):
    rows = [(None, datetime(2024, 1, 1, h), float(h * h)) for h in range(10)] + [(0, datetime(2024, 1, 1, h), 1.0) for h in range(5)]
    df = spark.createDataFrame(rows, "SeriesId long, Timestamp timestamp, Value double")
    got = [(r["SeriesId"], r["Value"]) for r in series.increase(df, slice_seconds=7200).orderBy("SeriesId", "Timestamp").collect()]
    assert got == [(None, 0.0)] + [(None, float(2 * h - 1)) for h in range(1, 10)] + [(0, 0.0)] * 5
    lines = spark.createDataFrame([(None, 1, True, "a"), (None, 2, False, "b"), ("", 1, False, "c")], "stream string, offset long, is_partial boolean, message string")
    joined = logs.reassemble_lines(lines, ["stream"], slice_width=2)
    assert sorted(((r["stream"], r["message"]) for r in joined.collect()), key=str) == [("", "c"), (None, "ab")]


def test_rate_divides_by_gap(spark):
    rows = [(1, datetime(2024, 1, 1, 0, 0, 0), 10.0), (1, datetime(2024, 1, 1, 0, 0, 5), 20.0), (1, datetime(2024, 1, 1, 0, 0, 6), 4.0), (1, datetime(2024, 1, 1, 0, 0, 8), 6.0)]
    df = spark.createDataFrame(rows, "SeriesId long, Timestamp timestamp, Value double")
    assert [r["Value"] for r in series.rate(df).orderBy("Timestamp").collect()] == [2.0, 2.0, 1.0]
    assert [r["Value"] for r in series.rate(df, "prometheus").orderBy("Timestamp").collect()] == [2.0, 4.0, 1.0]


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0], [float(i % 17) for i in range(500)], [10.0**i for i in range(-5, 12)]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered, shares = sorted(values), [0.01, 0.5, 0.9, 1.0]
    want = {q: ordered[max(1, -(-len(ordered) * int(q * 100) // 100)) - 1] for q in shares}
    assert {r["quantile"]: r["value"] for r in aggregate.exact_quantiles(df, "v", shares).collect()} == want


def test_exact_quantiles_beside_outliers(spark, monkeypatch):
    """Dense values beside an infinity and 1e300: cells follow ranks, and too many values are split further."""
    dense = spark.range(1_000_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e12).alias("v"))
    far = spark.createDataFrame([(float("inf"),), (1e300,), (None,), (float("nan"),), (-1e300,)], "v double")
    df = dense.unionByName(far)
    shares = [0.0, 0.0001, 0.5, 0.999, 1.0]
    ordered = sorted(r[0] for r in df.filter("v is not null and not isnan(v)").collect())
    want = {q: ordered[max(1, math.ceil(q * len(ordered))) - 1] for q in shares}
    assert {r["quantile"]: r["value"] for r in aggregate.exact_quantiles(df, "v", shares).collect()} == want
    monkeypatch.setattr(aggregate, "RANKED", 20)
    assert {r["quantile"]: r["value"] for r in aggregate.exact_quantiles(df, "v", shares).collect()} == want
    monkeypatch.setattr(aggregate, "_splitters", lambda rows, shares: [1e-5] * len(shares))  # splitters that miss every rank
    monkeypatch.setattr(aggregate, "RANKED", 10**7)
    assert {r["quantile"]: r["value"] for r in aggregate.exact_quantiles(df, "v", shares).collect()} == want


def test_exact_quantiles_of_nothing(spark):
    assert aggregate.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_make_series_fills_gaps(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 20), 1.0), ("a", datetime(2024, 1, 1, 0, 59), 2.0), ("b", datetime(2024, 1, 1, 0, 0), 3.0), ("b", datetime(2024, 1, 1, 1, 0), 9.0)]
    df = spark.createDataFrame(rows, "d string, ts timestamp, value double")
    out = aggregate.make_series(df, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 1, 1, tzinfo=UTC), 900, ["d"], {"n": F.count("*"), "v": F.sum("value")}, default=-1)
    got = {r["d"]: (r["n"], r["v"], len(r["times"])) for r in out.collect()}
    assert got == {"a": ([-1.0, 1.0, -1.0, 1.0], [-1.0, 1.0, -1.0, 2.0], 4), "b": ([1.0, -1.0, -1.0, -1.0], [3.0, -1.0, -1.0, -1.0], 4)}


def test_union_skips_absent_tables(spark):
    out = aggregate.union_fuzzy({"x": spark.range(2), "gone": None, "y": spark.range(1).withColumn("extra", F.lit("e"))})
    assert sorted((r["source"], r["id"], r["extra"]) for r in out.collect()) == [("x", 0, None), ("x", 1, None), ("y", 0, "e")]


def window_rows(df):
    return [(r[0], int((r["window_end"] - r["window_start"]).total_seconds()), r["window_start"]) for r in df.orderBy("window_start").collect()]


RULES = "rule string, interval_s int, delay_s int, last_end timestamp"
LEDGER = "rule string, window_start timestamp, state string, request_id string, attempts int"


def test_missing_windows(spark):
    now = datetime(2024, 1, 1, 12, 34, tzinfo=UTC)
    rules = spark.createDataFrame([("new", 3600, 900, None), ("late", 3600, 0, datetime(2024, 1, 1, 8)), ("edge", 1800, 240, datetime(2024, 1, 1, 12)), ("old", 60, 0, datetime(2023, 1, 1))], RULES)
    ledger = spark.createDataFrame([("late", datetime(2024, 1, 1, 9), "running", "", 1)], LEDGER)
    got = {}
    for rule, seconds, start in window_rows(missing_windows(rules, ledger, now)):
        got.setdefault(rule, []).append((start, seconds))
    assert got["new"] == [(datetime(2024, 1, 1, 11), 3600)]
    assert got["late"] == [(datetime(2024, 1, 1, h), 3600) for h in (8, 10, 11)]
    assert "edge" not in got  # its next window closes exactly at now - delay
    starts = [s for s, _ in got["old"]]
    assert starts[0] == datetime(2023, 1, 1) and starts[-1] == datetime(2024, 1, 1, 12, 32)
    kept, left_out = newest_windows(rules, ledger, now, 200)
    assert kept.filter("rule = 'old'").count() == 200 and kept.count() + left_out.count() == missing_windows(rules, ledger, now).count()
    assert all(b - a == timedelta(seconds=60) for a, b in zip(starts, starts[1:]))


def test_backfill_resumes_without_gaps(spark):
    rules = spark.createDataFrame([("r", 3600, 0, None)], RULES)
    start = datetime(2024, 1, 1)
    request = spark.createDataFrame([("r", "q", start, start + timedelta(hours=50), 7)], "rule string, request_id string, start timestamp, end timestamp, max_in_flight int")
    done, rounds = [], 0
    while True:
        ledger = spark.createDataFrame([("r", s, "completed", "q", 1) for s in done], LEDGER)
        windows, errors = backfill_windows(rules, ledger, request)
        batch = [r["window_start"] for r in windows.collect()]
        if not batch:
            break
        assert len(batch) <= 7
        done += batch
        rounds += 1
    assert done == [start + timedelta(hours=h) for h in range(50)] and rounds == 8
    assert errors.count() == 0
    final = plans.backfill_progress(request, rules, ledger).first()
    assert (final["windows"], final["completed"], final["phase"]) == (50, 50, "Completed")


@pytest.mark.parametrize(
    "request_id,hours,seconds,error",
    [("", 2, 0, "no request id"), ("q", 0, 0, "empty or reversed"), ("q", 0, 60, "whole number"), ("q", 2, 60, "whole number")],
)
def test_backfill_errors(spark, request_id, hours, seconds, error):
    rules = spark.createDataFrame([("r", 3600, 0, None)], RULES)
    start = datetime(2024, 1, 1)
    request = spark.createDataFrame([("r", request_id, start, start + timedelta(hours=hours, seconds=seconds), 1)], "rule string, request_id string, start timestamp, end timestamp, max_in_flight int")
    windows, errors = backfill_windows(rules, spark.createDataFrame([], LEDGER), request)
    assert windows.count() == 0 and error in errors.first()["error"]


RULE = alerts.AlertRule("ns", "rule", "SELECT 1")


@pytest.mark.parametrize(
    "columns,error",
    [
        ("1L AS Severity", "title must be between 1 and 512 chars"),
        ("'t' AS Title", "severity must be specified"),
        ("'t' AS Title, 'not a number' AS Severity", "failed to convert severity to int"),
        ("repeat('x', 513) AS Title, 1 AS Severity", "title must be between 1 and 512 chars"),
        ("'t' AS Title, 1 AS Severity, CAST(NULL AS STRING) AS Extra", "nil value: Extra"),
    ],
)
def test_bad_notifications(spark, columns, error):
    ok, bad = alerts.to_notifications(spark.sql(f"SELECT {columns}"), RULE)
    assert ok.count() == 0 and error in bad.first()["reason"]


@pytest.mark.parametrize("severity,value", [("1L", 1), ("2", 2), ("'10'", 10), ("3.9D", 3), ("CAST(4.7 AS DECIMAL(5,2))", 4)])
def test_severities(spark, severity, value):
    ok, _ = alerts.to_notifications(spark.sql(f"SELECT 't' AS TITLE, {severity} AS severity, 'me' AS Recipient, 'ns/rule://x' AS CorrelationId, 5 AS n"), RULE)
    row = ok.first()
    assert (row["severity"], row["destination"], row["correlation_id"], row["custom_fields"]) == (value, "me", "ns/rule://x", {"n": "5"})


def test_duplicate_reserved_columns():
    with pytest.raises(ValueError, match="title"):
        alerts.check_columns(["Title", "n", "TITLE"])
    alerts.check_columns(["Title", "n", "N"])


def test_run_alerts_isolates_failures(spark):
    sent = []
    good = alerts.AlertRule("ns", "good", "SELECT 'a' AS title, 1 AS severity", destination="x")
    bad = alerts.AlertRule("ns", "bad", "SELECT missing", destination="y")
    flood = alerts.AlertRule("ns", "flood", lambda s, p: s.range(30).select(F.lit("t").alias("title"), F.lit(1).alias("severity")), destination="z")
    out = alerts.run_alerts(spark, [good, bad, flood], datetime(2024, 1, 1, tzinfo=UTC), sent.append)
    got = {r["name"]: (r["outcome"], r["rows"], r["alerts"]) for r in out.collect()}
    assert got == {"good": ("success", 1, 1), "bad": ("user_error", 0, 0), "flood": ("throttled", 30, 25)}
    assert [df.count() for df in sent] == [1, 1, 26]


def test_export_checks_schema(spark):
    df = spark.sql("SELECT 1 AS v, true AS b, 'x' AS l, 5 AS n")
    for cfg, error in [
        (export.MetricExport([], default_metric_name="m"), "at least one value column"),
        (export.MetricExport(["b"], default_metric_name="m"), "non-numeric"),
        (export.MetricExport(["gone"], default_metric_name="m"), "not found"),
        (export.MetricExport(["v"]), "metric name"),
        (export.MetricExport(["v"], default_metric_name="m", label_columns=["n"]), "unsupported type"),
    ]:
        with pytest.raises(ValueError, match=error):
            export.to_metrics(df, cfg, datetime(2024, 1, 1, tzinfo=UTC))


def test_export_strict_fails_on_bad_row(spark):
    df = spark.sql("SELECT '1' AS v UNION ALL SELECT 'x'")
    cfg = export.MetricExport(["v"], default_metric_name="m")
    with pytest.raises(Exception, match="not a number"):
        export.to_metrics(df, cfg, datetime(2024, 1, 1, tzinfo=UTC)).collect()
    good, bad = export.to_metrics(df, cfg, datetime(2024, 1, 1, tzinfo=UTC), strict=False)
    assert (good.count(), bad.count()) == (1, 1)


def any_value(v):
    if isinstance(v, bool):
        return {"boolValue": v}
    if isinstance(v, int):
        return {"intValue": str(v)}
    if isinstance(v, float):
        return {"doubleValue": v}
    if isinstance(v, list):
        return {"arrayValue": {"values": [any_value(x) for x in v]}}
    if isinstance(v, dict):
        return {"kvlistValue": {"values": [{"key": k, "value": any_value(x)} for k, x in v.items()]}}
    return {"stringValue": v}


def log_document(body, attributes, resource):
    pairs = lambda d: [{"key": k, "value": any_value(v)} for k, v in d.items()]
    record = {"timeUnixNano": "1694564005797489936", "body": any_value(body), "attributes": pairs(attributes)}
    return json.dumps({"resourceLogs": [{"resource": {"attributes": pairs(resource)}, "scopeLogs": [{"logRecords": [record]}]}]})


def test_nested_log_values(spark):
    deep = current = {}
    for _ in range(25):
        current["k"] = {}
        current = current["k"]
    current["k"] = "end"
    dest = {"dest.database": "D", "dest.table": "T"}
    docs = [
        (0, log_document({"a": {"b": [1, "x", {"c": True}]}}, {**dest, "n": {"m": 1.5}}, {"r": [1]})),
        (1, log_document([1, 2], dest, {})),
        (2, log_document({"dest.database": "B", "dest.table": "C", "m": "hi"}, {}, {"h": "x"})),
        (3, log_document("text", {"dest.table": "T"}, {})),
        (4, log_document(deep, dest, {})),
    ]
    ok, rejects = flatten_otlp_logs(spark.createDataFrame(docs, "i int, doc string"))
    rows = {r["i"]: r for r in ok.select("i", "database", "table", *[F.to_json(c).alias(c) for c in ("body", "attributes", "resource")]).collect()}
    assert json.loads(rows[0]["body"]) == {"a": {"b": [1, "x", {"c": True}]}}
    assert json.loads(rows[0]["attributes"])["n"] == {"m": 1.5} and json.loads(rows[0]["resource"]) == {"r": [1]}
    assert json.loads(rows[1]["body"]) == {"message": [1, 2]}
    assert (rows[2]["database"], rows[2]["table"]) == ("B", "C")
    assert rows[4]["body"].count("{") == 21 and "..." in rows[4]["body"]
    assert [r["i"] for r in rejects.collect()] == [3]


def test_encoded_log_row(spark):
    doc = log_document({"namespace": "default", "n": 3}, {"dest.database": "D", "dest.table": "T"}, {"source": "host"})
    row = logs.encode_otlp_logs(log_records(spark.createDataFrame([(doc,)], "doc string")), now_ns=1669112524001000000).first()
    assert row["Body"] == '{"namespace":"default","n":"3"}' and row["Resource"] == '{"source":"host"}'
    assert row["time_ns"] == 1694564005797489936 and row["ObservedTimestamp"] == datetime(2022, 11, 22, 10, 22, 4, 1000)


def test_unknown_metric_types_are_rejected(spark):
    doc = json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "x"}, {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "5000000", "asInt": "7"}]}}]}]}]})
    samples, rejects = flatten_otlp_metrics(spark.createDataFrame([(doc,)], "doc string"))
    assert [(r["name"], r["value"]) for r in samples.collect()] == [("g", 7.0)]
    assert [(r["name"], r["reason"]) for r in rejects.collect()] == [("x", "unknown metric type")]


def test_rule_expressions(spark):
    rows = [("none", None, None), ("map", {"Region": ["EASTUS"]}, None), ("both", {"region": ["x"]}, "env = 'prod'"), ("bad", None, "env ="), ("text", None, "env"), ("yes", None, "env LIKE 'p%'")]
    rules = spark.createDataFrame(rows, "rule string, criteria map<string,array<string>>, expression string")
    got = {r["rule"]: r["selected"] for r in plans.select_rules(rules, {"region": "eastus", "env": "prod"}).collect()}
    assert got == {"none": True, "map": True, "both": False, "bad": False, "text": False, "yes": True}


def test_split_late_counts(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in range(10)], "ts timestamp")
    on_time, late, _ = split_late(df, datetime(2024, 1, 1, 9, tzinfo=UTC), 3 * 3600)
    assert (on_time.count(), late.count()) == (4, 6)
    only, _, seen = split_late(df, datetime(2024, 1, 1, 9, tzinfo=UTC), 3 * 3600)
    only.write.format("noop").mode("overwrite").save()
    assert seen.get == {"late": 6, "on_time": 4}
