"""Physical plans: native operators, pushed filters, no nested loops, skew-safe windows."""

import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.timebin import in_window
from tidemark.operators import aggregate, alerts, federation, series
from tidemark.operators.views import trace_spans
from tidemark.plans import rules, windows
from tidemark.session import scratch_path
from tidemark.workload.adapters import counters, table
from tidemark.workload.alerts import notifications
from tidemark.workload.registry import load_all

# Queries that run user code or flatten nested documents in Arrow batches.
PYTHON_QUERIES = {"L15_apply_transforms", "S5_flatten_otlp_logs", "L1_encode_otlp_logs"}
# Queries whose build runs jobs of its own (writes, streams); their final read is not the plan of interest.
EAGER = ("K", "T1", "T2", "T3", "T4", "T5", "W4", "W10", "S2", "S9", "V8", "Q8", "N8_", "metrics_ingest", "logs_ingest")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in sorted(load_all()) if not n.startswith(EAGER)]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_nested_loops_or_python(spark, sf_dir, name):
    text = plan_text(load_all()[name].build(spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_QUERIES:
        assert "Python" not in text and "mapInPandas" not in text


def test_time_filter_reaches_the_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lo, hi = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 6, tzinfo=timezone.utc)
    text = plan_text(e.filter(in_window(F.col("ts"), lo, hi)).groupBy("event_type").agg(F.avg("value")))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text


def test_rollup_shuffles_once(spark, sf_dir):
    text = plan_text(aggregate.rollup(table(spark, sf_dir, "events"), 3600, ["event_type"], {"v": F.sum("value")}))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_series_rows_shuffle_once_by_slice(spark, sf_dir):
    """Rows move once, on (series, slice); no exchange of rows is on the series alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(series.increase(counters(spark, sf_dir)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = [x for x in text.split("\n") if "Exchange hashpartitioning" in x]
    by_slice = [x for x in rows if "_slice" in x]
    # the rows, the partial borders, and the borders after their own window
    assert len(by_slice) == 3 and len(rows) == 4


def test_throttle_ranks_before_the_shuffle(spark, sf_dir):
    emitted, _ = alerts.throttle(notifications(spark, sf_dir))
    text = plan_text(emitted)
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Exchange hashpartitioning") < text.rindex("Partial")


def test_latest_combines_before_the_shuffle(spark, sf_dir):
    text = plan_text(aggregate.latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_totalprice"]))
    assert "partial_max_by" in text and text.count("Exchange hashpartitioning") == 1


def test_trace_filter_reaches_the_scan(spark):
    path = scratch_path(spark, "logs")
    spark.createDataFrame([(datetime(2024, 1, 1), "{}", "a" * 32)], "Timestamp timestamp, Body string, TraceId string").write.parquet(path)
    text = plan_text(trace_spans(spark.read.parquet(path), "b" * 32))
    pushed = next(x for x in text.split("\n") if "PushedFilters" in x)
    assert "EqualTo(TraceId," in pushed and "IsNull(TraceId)" in pushed


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sql_body_of_many_windows_is_one_scan(spark, tmp_path):
    """Windows without rows, repeated starts, quoted parameter names and a tail comment, against one run per window."""
    base = datetime(2024, 1, 1)
    spark.createDataFrame([(base + timedelta(minutes=7 * i), i % 5, float(i)) for i in range(600)], "at timestamp, kind int, v double").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("bounded_rows")
    starts = [base + timedelta(hours=h) for h in range(-2, 80, 9)]
    windows = spark.createDataFrame([(s, s + timedelta(hours=n)) for s in starts for n in (1, 2)], "window_start timestamp, window_end timestamp")
    bodies = [
        "SELECT count(*) AS n, ':_endTime' AS word, sum(v) AS v FROM `bounded_rows` WHERE at >= :_startTime AND at < :_endTime AND kind <> :_skip -- :_startTime",
        "WITH a AS (SELECT kind, v, :_startTime AS s FROM `bounded_rows` WHERE at BETWEEN :_startTime AND :_endTime - INTERVAL 1 MICROSECOND) SELECT kind, s, max(v) AS v FROM a WHERE kind <> :_skip GROUP BY kind, s",
        "SELECT x.kind, count(*) AS n FROM `bounded_rows` x WHERE x.at >= :_startTime AND x.at < :_endTime AND kind > :_skip GROUP BY x.kind HAVING count(*) > 3",
    ]
    for body in bodies:
        got = rules.rollup_windows_sql(spark, body, windows, {"skip": 2}, {"bounded_rows": "at"})
        want = []
        for w in windows.collect():
            alone = spark.sql(body, args={"_startTime": w.window_start, "_endTime": w.window_end, "_skip": 2})
            want += [(*r, w.window_start) for r in alone.collect()]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        plan = _plan(got)
        assert plan.count("Relation [at") == 1 and "NestedLoop" not in plan_text(got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("windows_", "rows_"))]


def test_rules_of_one_source_share_a_scan(spark, tmp_path):
    base = datetime(2024, 1, 1)
    spark.createDataFrame([(base + timedelta(minutes=i), i % 3, i) for i in range(3000)], "ts timestamp, kind int, v int").write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    bodies = {f"r{i}": rules.Totals({"n": "count(*)", "v": "sum(v)"}, ("kind",) if i % 2 else (), f"v % 10 >= {i}" if i % 3 else None) for i in range(10)}
    windows = spark.createDataFrame([(f"r{i}", base + timedelta(hours=h), base + timedelta(hours=h + 1 + i % 2)) for i in range(10) for h in range(0, 40, 2)], "rule string, window_start timestamp, window_end timestamp")
    out, pick = rules.shared_rollup(source, windows, bodies)
    assert _plan(out).count("Relation [ts") == 1
    for name, body in bodies.items():
        alone = rules.rollup_windows(source, windows.filter(F.col("rule") == name), body)
        assert sorted(map(tuple, pick(out, name).select(alone.columns).collect())) == sorted(map(tuple, alone.collect()))


def test_a_failing_rule_leaves_those_it_shares_a_scan_with(spark):
    base = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(base, 1)], "ts timestamp, v int")
    paths = {n: scratch_path(spark, n) for n in ("good", "bad", "ledger")}
    made = [rules.RollupRule("good", "s", rules.Totals({"n": "count(*)"}), paths["good"]), rules.RollupRule("bad", "s", rules.Totals({"n": "sum(raise_error('no'))"}), paths["bad"])]
    windows = spark.createDataFrame([(n, base, base + timedelta(hours=1)) for n in ("good", "bad")], "rule string, window_start timestamp, window_end timestamp")
    outcome = rules.run_rules(made, {"s": rows}, windows, paths["ledger"])
    assert outcome["good"] is None and outcome["bad"]
    assert spark.read.parquet(paths["good"]).first()["n"] == 1
    state = {r["rule"]: r["state"] for r in rules.ledger_state(spark.read.parquet(paths["ledger"])).collect()}
    assert state == {"good": "completed", "bad": "failed"}


def test_federated_relation_is_one_scan(spark, tmp_path):
    """Members with columns of their own and day folders: one relation, rows under the right endpoint."""
    spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").write.parquet(str(tmp_path / "one + 1" / "T"))
    spark.createDataFrame([(3, 5.0)], "a int, c double").write.parquet(str(tmp_path / "T" / "T"))
    catalog = spark.createDataFrame([("D", None, ["p", "q", "r", "s"]), ("D", "T", ["p", "q", "s"]), ("E", "T", ["r"])], "database string, table string, endpoints array<string>")
    roots = spark.createDataFrame([("p", str(tmp_path / "one + 1")), ("q", str(tmp_path / "T") + "/"), ("s", str(tmp_path / "gone"))], "endpoint string, root string")
    rows, left_out = federation.federated_relation(spark, catalog, roots, "D", "T")
    assert sorted(map(tuple, rows.select("endpoint", "a", "b", "c").collect()), key=str) == [("p", 1, "x", None), ("p", 2, "y", None), ("q", 3, None, 5.0)]
    assert _plan(rows).count("Relation [") == 1
    assert sorted(map(tuple, left_out.collect())) == [("r", "table not in the schema"), ("s", "no folder")]
    assert federation.federated_relation(spark, catalog, roots, "nowhere", "T")[0] is None


def test_alerts_are_evaluated_side_by_side(spark):
    """Two rules wait for each other, which only works at once; sinks take turns and outcomes keep the order of rules."""
    together, inside, most, sent = threading.Barrier(2, timeout=60), [], [], []

    def rule(s, p):
        together.wait()
        return s.range(1).select(F.lit("t").alias("title"), F.lit(1).alias("severity"))

    def sink(df):
        inside.append(1)
        most.append(len(inside))
        sent.extend(r["source"] for r in df.collect())
        inside.pop()

    found = alerts.run_alerts(spark, [alerts.AlertRule("ops", n, rule) for n in ("b", "a")], datetime(2024, 1, 1, tzinfo=timezone.utc), sink, at_once=2)
    assert [(r["name"], r["outcome"]) for r in found.collect()] == [("b", "success"), ("a", "success")]
    assert max(most) == 1 and sorted(sent) == ["ops/a", "ops/b"]


def test_windows_are_made_and_sorted_by_all_tasks(spark):
    """Rules and windows are few bytes, so that their parts would be put together into one."""
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    made = spark.createDataFrame([(f"r{i}", 3600, 0, start) for i in range(50)], "rule string, interval_s int, delay_s int, last_end timestamp").coalesce(1)
    ledger = spark.createDataFrame([("r1", start)], "rule string, window_start timestamp")
    new, left = windows.newest_windows(made, ledger, start + timedelta(hours=100, minutes=1), 20)
    assert new.groupBy(F.spark_partition_id()).count().count() > 4
    assert (new.count(), left.count()) == (50 * 20, 50 * 80 - 1)
