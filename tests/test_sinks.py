"""Sinks, rollup runs and state tables on disk."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.operators.alerts import throttle
from tidemark.plans import rules as plans
from tidemark.session import scratch_path
from tidemark.sinks import layout
from tidemark.sinks.documents import group_by_tag, merged_attributes, to_otlp_gauges
from tidemark.sinks.evolving import SCHEMA_LOG, append_evolving, current_schema, read_evolving
from tidemark.sinks.fan_out import fan_out
from tidemark.sinks.registry import latest_schemas, register_schema
from tidemark.sinks.routed import read_routed, write_routed
from tidemark.sources.otlp_metrics import flatten_otlp_metrics
from tidemark.sources.typed_csv import parse_header, read_typed_csv
from tidemark.workload.layout import in_files
from tidemark.workload.logs import spans
from tidemark.workload.otlp import metric_documents

UTC = timezone.utc


def test_write_routed_counts_drops(spark):
    rows = [("My-Db", "t_1", 1), ("", "t", 2), (None, "t", 3), ("db", "--", 4), ("MyDb", "t1", 5)]
    root = scratch_path(spark, "routed")
    counts = write_routed(spark.createDataFrame(rows, "database string, table string, v int"), root)
    assert counts == {"written": 2, "dropped": 3}
    assert sorted(r["v"] for r in read_routed(spark, root, "MyDb", "t1").collect()) == [1, 5]


def test_hot_destination_is_split(spark):
    """A destination holding nearly all rows is written by several tasks."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        wide = spark.range(40_000).select(F.lit("db").alias("database"), F.when(F.col("id") < 10, F.lit("b")).otherwise("a").alias("table"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        root = scratch_path(spark, "hot")
        write_routed(wide.repartition(8), root)
        files = layout.list_files(spark, root).groupBy(F.regexp_extract("folder", "table=(.*)$", 1).alias("t")).count()
        counts = {r["t"]: r["count"] for r in files.collect()}
        assert counts["a"] > 3 and counts["b"] == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_append_evolving(spark):
    path = scratch_path(spark, "evolving")
    append_evolving(spark.sql("SELECT 1 AS a"), path)
    append_evolving(spark.sql("SELECT 'x' AS b, 2 AS a"), path)
    append_evolving(spark.sql("SELECT 'y' AS b"), path)
    assert sorted(map(tuple, read_evolving(spark, path).collect()), key=str) == [(1, None), (2, "x"), (None, "y")]
    with pytest.raises(ValueError, match="changes type"):
        append_evolving(spark.sql("SELECT 'no' AS a"), path)


def test_layout_order():
    assert layout.layout_order(["Value", "Timestamp", "SeriesId"]) == ["SeriesId", "Timestamp"]
    assert layout.layout_order(["Timestamp", "x"]) == ["Timestamp"]
    assert layout.layout_order(["x", "y"]) == ["x"]


def test_layout_prunes_days(spark):
    path = scratch_path(spark, "layout")
    base = datetime(2024, 1, 1)
    rows = [(i % 5, base + timedelta(hours=i), float(i)) for i in range(100)]
    layout.write_layout(spark.createDataFrame(rows, "SeriesId long, Timestamp timestamp, Value double"), path)
    table = spark.read.parquet(path)
    day = table.filter(F.col("day") == F.lit("2024-01-02").cast("date"))
    assert day.count() == 24
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()


def test_layout_measures_frames_of_unknown_size(spark):
    rows = spark.createDataFrame([(i, "x" * 1000) for i in range(5000)], "a long, b string")
    assert 4_000_000 < layout.sampled_bytes(rows, 0.2) < 6_000_000
    assert layout.range_partitions(rows, 100_000) == max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-layout.sampled_bytes(rows) // 100_000))


def rows_scanned(df):
    """Rows that the scans of a query gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_trace_skips_row_groups(spark):
    start = datetime(2024, 1, 1)
    spans = [(f"{i * 7919 % 20_000:032x}", start + timedelta(seconds=i), "x" * 50) for i in range(20_000)]
    scanned = []
    for lookup in (layout.LOOKUP, ()):
        path = scratch_path(spark, "traces")
        layout.write_layout(
            spark.createDataFrame(spans, "TraceId string, Timestamp timestamp, Body string"), path, lookup=lookup,
            **{"parquet.block.size": "200000", "parquet.page.size.row.check.min": "100", "parquet.enable.dictionary": "false"},
        )
        one = spark.read.parquet(path).filter(F.col("TraceId") == f"{12_345:032x}").select("Timestamp", "Body")
        assert len(one.collect()) == 1
        scanned.append(rows_scanned(one))
    assert scanned[0] < scanned[1] / 2


def test_compaction_rules(spark):
    files = spark.createDataFrame([("f", f"f/{i:03}", 10) for i in range(60)] + [("g", f"g/{i}", 400) for i in range(4)], "folder string, file string, bytes long")
    plan = layout.plan_compaction(files, target_bytes=1000, max_files=25)
    sizes = {r["batch"]: (r["n"], r["b"]) for r in plan.groupBy("batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()}
    assert sorted(n for k, (n, _) in sizes.items() if k.startswith("f")) == [10, 25, 25]
    assert sum(n for n, _ in sizes.values()) == 64


def test_compaction_keeps_rows(spark):
    src, out = scratch_path(spark, "small"), scratch_path(spark, "big")
    spark.range(1000).withColumn("p", F.col("id") % 2).repartition(20).write.partitionBy("p").parquet(src)
    layout.compact(spark, src, out, ["p"])
    before, after = layout.list_files(spark, src).count(), layout.list_files(spark, out).count()
    assert after < before
    assert spark.read.parquet(out).select("id", "p").exceptAll(spark.read.parquet(src).select("id", "p")).count() == 0
    assert spark.read.parquet(out).count() == 1000


def test_compaction_in_place_touches_small_folders_only(spark):
    path = scratch_path(spark, "in-place")
    wide = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("big").alias("p"))
    wide.coalesce(1).write.partitionBy("p").parquet(path)
    spark.range(100).select("id", F.lit("x").alias("text"), F.lit("small").alias("p")).repartition(10).write.mode("append").partitionBy("p").parquet(path)
    big = {r["file"] for r in layout.list_files(spark, path).filter("folder LIKE '%p=big'").collect()}
    layout.compact(spark, path, None, ["p"], target_bytes=50_000)
    after = layout.list_files(spark, path)
    assert {r["file"] for r in after.filter("folder LIKE '%p=big'").collect()} == big
    assert after.filter("folder LIKE '%p=small'").count() < 10
    assert {r["p"]: r["count"] for r in spark.read.parquet(path).groupBy("p").count().collect()} == {"big": 3000, "small": 100}


def test_registry(spark):
    path = scratch_path(spark, "registry")
    register_schema(spark.sql("SELECT 1 AS a"), "t", path, datetime(2024, 1, 1, tzinfo=UTC))
    register_schema(spark.sql("SELECT 1 AS a, 'x' AS b"), "t", path, datetime(2024, 1, 2, tzinfo=UTC))
    rows = latest_schemas(spark.read.parquet(path)).collect()
    assert [(r["table"], r["schema_id"], r["header"]) for r in rows] == [("t", "default", "a:int,b:string")]


def test_fan_out_isolates_failures(spark):
    seen = {}

    def broken(_):
        raise OSError("down")

    result = fan_out(spark.range(5), {"a": lambda df: seen.update(a=df.count()), "bad": broken, "b": lambda df: seen.update(b=df.count())})
    assert result == {"a": None, "bad": "down", "b": None} and seen == {"a": 5, "b": 5}


def test_gauges_round_trip(spark):
    """Documents read back as the samples they were made of, internal labels gone, chunks bounded."""
    rows = [("cpu", {"host": "a", "sys_pod": "p"}, datetime(2024, 1, 1, 0, 0, i % 60, 5000), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, ts timestamp, value double")
    docs = to_otlp_gauges(df, merged_attributes({"c": "1"}, {"c": "2"}), max_entries=50)
    assert sorted(r["points"] for r in docs.collect()) == [20, 50, 50]
    back, _ = flatten_otlp_metrics(docs.select("doc"))
    assert sorted((r["name"], r["value"]) for r in back.collect()) == sorted(("cpu", v) for _, _, _, v in rows)
    assert back.first()["labels"] == {"host": "a"}


def test_tag_batches(spark):
    df = spark.range(10).select(
        (F.col("id") * 1_500_000_000).alias("time_ns"), F.create_map(F.lit("n"), F.col("id").cast("variant")).alias("body"),
        F.create_map(F.lit("tag"), F.when(F.col("id") % 2 == 0, F.lit("even")).otherwise("").cast("variant")).alias("attributes"),
    )
    out = group_by_tag(df, "tag").collect()
    assert [r["tag"] for r in out] == ["even"]
    assert [(e["seconds"], e["nanos"], e["body"]) for e in out[0]["entries"]][:2] == [(0, 0, '{"n":0}'), (3, 0, '{"n":2}')]


def test_header_rules():
    assert parse_header("A:long,B:real\n") == [("A", "long"), ("B", "real")]
    for bad in ("A", "A:long:x", "A:what"):
        with pytest.raises(ValueError):
            parse_header(bad)


def test_typed_csv_quotes_and_rejects(spark, tmp_path):
    head = "Timestamp:datetime,SeriesId:long,Labels:dynamic,Value:real"
    lines = [head, '2024-02-29T06:07:08.009Z,-4611686018427387123,"{""a"":""b,c""}",1.5', head, ",,,", "2024-02-29T06:07:08Z,x,,1"]
    path = tmp_path / "csv"
    path.mkdir()
    (path / "a.csv").write_text("\n".join(lines[:4]) + "\n")
    rows = read_typed_csv(spark, str(path)).orderBy("Timestamp").collect()
    assert tuple(rows[0]) == (datetime(1970, 1, 1), 0, "", 0.0)
    assert tuple(rows[1]) == (datetime(2024, 2, 29, 6, 7, 8, 9000), -4611686018427387123, '{"a":"b,c"}', 1.5)
    (path / "b.csv").write_text("\n".join([head, lines[4], "1,2"]) + "\n")
    with pytest.raises(Exception):
        read_typed_csv(spark, str(path)).collect()
    good, bad = read_typed_csv(spark, str(path), strict=False)
    assert (good.count(), bad.count()) == (2, 2)


def hourly(df):
    return df.groupBy("window_start").agg(F.sum("v").alias("total"))


def test_rollup_rerun_replaces_its_windows(spark):
    target, ledger = scratch_path(spark, "rollup"), scratch_path(spark, "ledger")
    base = datetime(2024, 1, 1)
    windows = spark.createDataFrame([(base + timedelta(hours=h), base + timedelta(hours=h + 1)) for h in range(3)], "window_start timestamp, window_end timestamp")
    rows = lambda k: spark.createDataFrame([(base + timedelta(minutes=20 * i), k) for i in range(12)], "ts timestamp, v int")
    plans.run_rollup(rows(1), windows, hourly, target, ledger, "r")
    plans.run_rollup(rows(10), windows.limit(1), hourly, target, ledger, "r")
    got = sorted((str(r["window_start"]), r["total"]) for r in spark.read.parquet(target).collect())
    assert [t for _, t in got] == [30, 3, 3]
    assert plans.ledger_state(spark.read.parquet(ledger)).count() == 3
    assert plans.last_ends(spark.read.parquet(ledger)).first()["last_end"] == base + timedelta(hours=3)


def test_overlapping_and_empty_windows(spark):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + timedelta(minutes=m), 1) for m in range(0, 180, 10)], "ts timestamp, v int")
    windows = spark.createDataFrame([(base + timedelta(minutes=5), base + timedelta(minutes=65)), (base + timedelta(minutes=35), base + timedelta(minutes=95))], "window_start timestamp, window_end timestamp")
    got = {r["window_start"]: r["total"] for r in hourly(plans.assign_windows(df, windows)).collect()}
    assert got == {base + timedelta(minutes=5): 6, base + timedelta(minutes=35): 6}
    assert plans.assign_windows(df, windows.limit(0)).count() == 0


def test_rollup_sql_binds_parameters(spark):
    spark.createDataFrame([(datetime(2024, 1, 1, h), "e") for h in range(5)], "ts timestamp, region string").createOrReplaceTempView("rows_for_sql")
    target = scratch_path(spark, "sql-rollup")
    body = "SELECT count(*) AS n, :_region AS region FROM rows_for_sql WHERE ts >= :_startTime AND ts < :_endTime AND region = :_region"
    windows = spark.createDataFrame([(datetime(2024, 1, 1, 1, tzinfo=UTC), datetime(2024, 1, 1, 3, tzinfo=UTC))], "window_start timestamp, window_end timestamp")
    plans.run_rollup_sql(spark, body, windows, {"region": "e"}, target, scratch_path(spark, "ledger"), "r")
    row = spark.read.parquet(target).first()
    assert (row["n"], row["region"]) == (2, "e")


def test_chunks_are_bounded_in_bytes(spark):
    rows = [(i, f"{i:04d}" + "x" * 996) for i in range(100)]
    logs = spark.createDataFrame(rows, "time_ns long, text string").select(
        "time_ns", F.create_map(F.lit("m"), F.col("text").cast("variant")).alias("body"), F.create_map(F.lit("tag"), F.lit("t").cast("variant")).alias("attributes")
    )
    batches = group_by_tag(logs, "tag", max_bytes=10_000).orderBy("chunk").collect()
    assert max(sum(len(e["body"]) for e in b["entries"]) for b in batches) <= 11_100
    assert [e["nanos"] for b in batches for e in b["entries"]] == list(range(100))


def test_writers_that_add_columns_at_once_keep_both(spark):
    path = scratch_path(spark, "evolving")
    append_evolving(spark.sql("SELECT 1 AS a"), path)
    for name in ("b", "c"):  # as if each had read the log before the other wrote
        schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField(name, T.IntegerType())])
        entry = spark.createDataFrame([(2, schema.json())], "version int, schema string")
        entry.write.mode("append").json(f"{path}/{SCHEMA_LOG}")
    assert current_schema(spark, path).names == ["a", "b", "c"]
    append_evolving(spark.sql("SELECT 2 AS A, 3 AS C"), path)
    assert read_evolving(spark, path).columns == ["a", "b", "c"]
    assert sorted(map(tuple, read_evolving(spark, path).collect())) == [(1, None, None), (2, None, 3)]


def test_throttle_with_a_large_cap(spark):
    rows = spark.range(3000).select(
        F.lit("ops/r").alias("source"), F.format_string("%05d", "id").alias("correlation_id"), F.lit("t").alias("title"), F.lit("d").alias("destination"),
        F.lit("").alias("summary"), F.lit("").alias("description"), F.lit(1).cast("bigint").alias("severity"), F.create_map().cast("map<string,string>").alias("custom_fields"),
    )
    emitted, flags = throttle(rows, cap=1500)
    assert sorted(r[0] for r in emitted.select("correlation_id").collect()) == [f"{i:05d}" for i in range(1500)] and flags.count() == 1


def test_files_are_written_from_the_parts_as_read(spark):
    """Five files need no shuffle of the rows, unless a file would stay empty."""
    rows = spark.range(100)
    together = in_files(rows.repartition(10), 5)
    assert together.rdd.getNumPartitions() == 5 and together.count() == 100 and "RoundRobinPartitioning(5)" not in together._jdf.queryExecution().toString()
    assert in_files(rows.coalesce(1), 3).groupBy(F.spark_partition_id()).count().count() == 3


def test_documents_and_spans_are_made_by_all_tasks(spark):
    root = scratch_path(spark, "tables")
    at = "timestamp_seconds(id)"
    spark.range(40).selectExpr("id AS event_id", "id AS user_id", f"{at} AS ts", "CAST(id AS DOUBLE) AS value").coalesce(1).write.parquet(f"{root}/events.parquet")
    spark.range(40).selectExpr("id AS o_orderkey", f"{at} AS o_orderdate", "'p' AS o_orderpriority").coalesce(1).write.parquet(f"{root}/orders.parquet")
    line = ["id AS l_orderkey", "1 AS l_linenumber", f"{at} AS l_shipdate", "CAST(1 AS DOUBLE) AS l_quantity", "'R' AS l_returnflag"]
    spark.range(40).selectExpr(*line).coalesce(1).write.parquet(f"{root}/lineitem.parquet")
    for made, n in ((metric_documents(spark, root), 40), (spans(spark, root), 80)):
        parts = made.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 8 and sum(p["count"] for p in parts) == n
