"""Streams over growing folders: redelivery, late rows, views in the catalog."""

import types
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.alerts import AlertRule
from tidemark.operators.logs import reassemble_lines
from tidemark.operators.series import increase
from tidemark.operators.views import create_log_view
from tidemark.session import delete_path, scratch_path
from tidemark.streaming import jobs
from tidemark.workload import stream
from tidemark.workload.stream import event_files, finish, read_stream, written


def feed(spark, batches, schema):
    """A folder with one file per batch, in order."""
    path = scratch_path(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_redelivered_batches_are_stored_once(spark):
    path = feed(spark, [[("a", i)] * 3 for i in range(4)], "table string, v int")
    root, checkpoint = scratch_path(spark, "ingest"), scratch_path(spark, "cp")
    steps = [lambda df: df.withColumn("database", F.lit("Db"))]
    finish(jobs.stream_ingest(read_stream(spark, path), steps, root, checkpoint))
    delete_path(spark, f"{checkpoint}/commits/3")  # as if the job had died before its last commit
    finish(jobs.stream_ingest(read_stream(spark, path), steps, root, checkpoint))
    assert spark.read.parquet(root).count() == 12


def test_streams_share_a_root(spark):
    path = feed(spark, [[("a", i), (None, i)] for i in range(4)], "table string, v int")
    root = scratch_path(spark, "ingest")
    steps = [lambda df: df.withColumn("database", F.lit("Db"))]
    for _ in range(2):
        finish(jobs.stream_ingest(read_stream(spark, path), steps, root, scratch_path(spark, "cp")))
    assert spark.read.parquet(root).count() == 8
    assert spark.read.parquet(f"{root}-unrouted").count() == 8


def test_partial_lines_wait_across_batches(spark):
    lines = [("s", i, i % 7 != 6, f"{i},") for i in range(40)] + [("t", i, False, "x") for i in range(3)]
    schema = "stream string, offset long, is_partial boolean, message string"
    path = feed(spark, [lines[:5], lines[5:6], lines[6:30], lines[30:]], schema)
    got = written(spark, jobs.reassemble_stream(read_stream(spark, path), ["stream"])).filter("NOT cut")
    batch = reassemble_lines(spark.createDataFrame(lines, schema), ["stream"])
    want = sorted((r["stream"], r["offset"], r["message"]) for r in batch.collect())
    assert sorted((r["stream"], r["offset"], r["message"]) for r in got.collect()) == want


def test_stream_increase_matches_batch_and_diverts_late_rows(spark):
    start = datetime(2024, 1, 1)
    rows = [(i % 3, start + timedelta(minutes=i), float(i * i % 101)) for i in range(90)]
    late = [(0, start + timedelta(minutes=1, seconds=5), 5.0)]
    schema = "SeriesId long, Timestamp timestamp, Value double"
    path = feed(spark, [rows[:20], rows[20:55], late + rows[55:]], schema)
    got = written(spark, jobs.stream_increase(read_stream(spark, path)))
    batch = increase(spark.createDataFrame(rows, schema), "prometheus")
    columns = ["SeriesId", "Timestamp", "Value"]
    assert sorted(map(tuple, got.filter("NOT late").select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert [r["Value"] for r in got.filter("late").collect()] == [5.0]


def state_rows(spark, checkpoint):
    """Open messages kept; the second of the two steps holds them."""
    for operator in (0, 1):
        try:
            return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "open").load(checkpoint).count()
        except Exception:
            if operator:
                raise


def test_finished_messages_leave_no_state(spark):
    lines = [(f"s{i}", i, False, "whole") for i in range(20)] + [("open", 100, True, "part")]
    path = feed(spark, [lines], "stream string, offset long, is_partial boolean, message string")
    checkpoint = scratch_path(spark, "cp")
    stream = jobs.reassemble_stream(read_stream(spark, path), ["stream"])
    finish(stream.writeStream.format("parquet").option("path", scratch_path(spark, "out")).option("checkpointLocation", checkpoint))
    assert state_rows(spark, checkpoint) == 1


def test_endless_message_is_cut(spark):
    lines = [("s", i, True, "0123456789") for i in range(25)] + [("s", 25, False, "!")]
    path = feed(spark, [lines[:13], lines[13:]], "stream string, offset long, is_partial boolean, message string")
    got = written(spark, jobs.reassemble_stream(read_stream(spark, path), ["stream"], longest=100))
    assert sorted((r["offset"], len(r["message"]), r["cut"]) for r in got.collect()) == [(9, 100, True), (19, 100, True), (25, 51, False)]


def test_flooding_id_gives_one_alert(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"id{i % 2 if i % 9 == 0 else 0}", f"n{i}", start + timedelta(seconds=i)) for i in range(300)]
    path = feed(spark, [rows[:150], rows[150:]], "CorrelationId string, Extra string, ts timestamp")
    sdf = read_stream(spark, path).withColumns({"Title": F.lit("t"), "Severity": F.lit(1)})
    found = jobs.stream_alerts(sdf, AlertRule("ns", "r", "SELECT 1"), "CorrelationId", "1 hour")[0]
    out = scratch_path(spark, "alerts")
    finish(found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "cp")))
    assert sorted(r["correlation_id"] for r in spark.read.parquet(out).collect()) == ["ns/r://id0", "ns/r://id1"]


def test_view_in_a_catalog_schema(spark):
    logs = spark.createDataFrame([('{"msg":"hi","it\'s":7}',), ("not json",)], "Body string")
    logs.write.mode("overwrite").option("path", scratch_path(spark, "table")).saveAsTable("app_logs")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS log_views LOCATION '{scratch_path(spark, 'views')}'")
    mapping = {"msg": ("Body", "$.msg", "string"), "n": ("Body", "$[\"it's\"]", "int")}
    try:
        view = create_log_view(spark, "app_logs", spark.table("app_logs"), mapping, "log_views")
        assert sorted(map(tuple, view.collect()), key=str) == [("hi", 7), (None, None)]
        assert sorted(map(tuple, spark.table("log_views.app_logs").collect()), key=str) == [("hi", 7), (None, None)]
    finally:
        spark.sql("DROP DATABASE IF EXISTS log_views CASCADE")
        spark.sql("DROP TABLE IF EXISTS app_logs")


def test_no_frame_is_larger_than_a_slice():
    """A third of all rows in one stream: each call sees one slice, the joiner only what is open at borders."""
    rows = pd.DataFrame({"file": "hot", "offset": range(1000), "is_partial": [i % 7 != 6 for i in range(1000)], "message": [f"{i}," for i in range(1000)]})
    columns = ["file", "offset", "message", "cut", jobs.SLICE, jobs.ROLE]
    first, rests, done = jobs.LinePieces(columns, "offset", "message", True), [], []
    for number, part in rows.assign(**{jobs.SLICE: rows["offset"] // 100}).groupby(rows["offset"] // 100):
        assert len(part) == 100
        (given,) = first.handleInputRows(("hot", number), iter([part]), None)
        done += given[given[jobs.ROLE] == jobs.DONE][["offset", "message"]].values.tolist()
        rests.append(given[given[jobs.ROLE] != jobs.DONE])
    assert max(map(len, rests)) == 2  # whatever the length of the slice
    joiner = jobs.LineJoiner(["file", "offset", "message", "cut"], "offset", "message", None, None)
    state = {}
    joiner.open = types.SimpleNamespace(exists=lambda: "v" in state, get=lambda: state["v"], update=lambda v: state.update(v=v), clear=state.clear)
    (given,) = joiner.handleInputRows((-1, "hot"), iter(rests), None)
    done += given[["offset", "message"]].values.tolist()
    want = [[i, "".join(f"{j}," for j in range(i - 6, i + 1))] for i in range(6, 1000, 7)]
    assert sorted(done) == want and state["v"][0] == 999


def test_slices_of_a_series_agree_with_the_batch(spark):
    start = datetime(2024, 1, 1)
    rows = [(((1 << 60) + 1, 2, None)[i % 5 % 3], start + timedelta(minutes=7 * i), float(i * i % 101)) for i in range(150)]
    schema = "SeriesId long, Timestamp timestamp, Value double"
    path = feed(spark, [rows[:40], rows[40:110], rows[110:]], schema)
    got = written(spark, jobs.stream_increase(read_stream(spark, path), slice_seconds=3600))
    columns = ["SeriesId", "Timestamp", "Value"]
    want = increase(spark.createDataFrame(rows, schema), "prometheus").select(columns).collect()
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want), key=str) and got.filter("late").count() == 0


def test_late_rows_stay_beside_the_rollup(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=10 * i), 1.0) for i in range(60)]
    late = [("b", start + timedelta(minutes=1), 5.0), ("a", None, 7.0)]
    path = feed(spark, [rows[:30], rows[30:], late, [("z", start + timedelta(days=30), 0.0)]], "k string, ts timestamp, v double")
    out = written(spark, jobs.stream_rollup_with_late(read_stream(spark, path), "1 hour", "10 minutes", ["k"], {"n": F.count("*"), "total": F.sum("v")}))
    bins = out.filter("late_row IS NULL").agg(F.sum("n"), F.sum("total")).first()
    assert tuple(bins) == (60, 60.0)
    found = out.filter("late_row IS NOT NULL").select("k", F.get_json_object("late_row", "$.v").cast("double").alias("v"), "bin", "n", "total").collect()
    assert sorted(map(tuple, found)) == [("a", 7.0, None, 1, 7.0), ("b", 5.0, None, 1, 5.0)]


def map_state():
    """A map state of one group, and its entries."""
    kept = {}
    return types.SimpleNamespace(getValue=kept.get, updateValue=lambda k, v: kept.update({k: v}), removeKey=kept.pop), kept


def test_one_call_takes_the_lines_of_many_streams():
    lines = [(f"s{k}", i, (i + k) % 4 != 3, f"{k}:{i},") for k in range(5) for i in range(10)]
    frame = pd.DataFrame(lines, columns=[jobs.OWNER, "offset", "is_partial", "message"])
    frame[jobs.SLICE] = frame["offset"] // 6
    columns = [jobs.OWNER, "offset", "message", "cut"]
    first = jobs.LinePieces([*columns, jobs.SLICE, jobs.ROLE], "offset", "message", True)
    joiner = jobs.LineJoiners(columns, "offset", "message", None, None)
    joiner.open, kept = map_state()
    done = []
    for batch in (frame[frame["offset"] < 7], frame[frame["offset"] >= 7]):
        (given,) = first.handleInputRows((1,), iter([batch]), None)
        done += given[given[jobs.ROLE] == jobs.DONE][columns[:3]].values.tolist()
        (given,) = joiner.handleInputRows((-1, "1"), iter([given[given[jobs.ROLE] != jobs.DONE]]), None)
        done += given[columns[:3]].values.tolist()
    want, still = [], {}
    for k in range(5):
        text = ""
        for i in range(10):
            text += f"{k}:{i},"
            if (i + k) % 4 == 3:
                want.append([f"s{k}", i, text])
                text = ""
        if text:
            still[f"s{k}",] = (9, text)
    assert sorted(done) == sorted(want) and kept == still


def test_a_cut_of_the_events_is_one_file(spark):
    """A batch is a cut of the ids in event order, into however many parts the table is split."""
    root = scratch_path(spark, "tables")
    spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts").repartition(8).write.parquet(f"{root}/events.parquet")
    files = spark.read.parquet(event_files(spark, root)).groupBy(F.input_file_name().alias("f")).agg(F.min("event_id"), F.max("event_id")).collect()
    assert sorted(tuple(r)[1:] for r in files) == [(0, 12), (13, 25), (26, 39)]


def test_one_call_takes_the_samples_of_many_series():
    start, rows = pd.Timestamp("2024-01-01"), []
    for k in range(4):
        rows += [(f"s{k}", start + pd.Timedelta(minutes=20 * i + k), float((i + k) ** 2 % 11)) for i in range(12)]
    frame = pd.DataFrame(rows, columns=[jobs.OWNER, "Timestamp", "Value"])
    frame[jobs.SLICE] = frame["Timestamp"].dt.hour
    frame[jobs.LANE] = frame[jobs.SLICE] % 2
    columns = [jobs.OWNER, "Timestamp", "Value", "late"]
    sliced, series = jobs.SlicedCounter([*columns, jobs.SLICE, jobs.ROLE]), jobs.SeriesCounter(columns, None)
    (sliced.last, lanes), (series.last, kept) = map_state(), map_state()
    late = frame.iloc[[1, 13]].assign(Value=99.0)
    done, cut = [], start + pd.Timedelta(minutes=150)
    for batch in (frame[frame["Timestamp"] < cut], pd.concat([late, frame[frame["Timestamp"] >= cut]])):
        (given,) = sliced.handleInputRows((1,), iter([batch]), None)
        done += given[given[jobs.ROLE] == jobs.DONE][columns].values.tolist()
        (given,) = series.handleInputRows((-1, "1"), iter([given[given[jobs.ROLE] != jobs.DONE]]), None)
        done += given[columns].values.tolist()
    want = [[o, t, 99.0, True] for o, t in late[[jobs.OWNER, "Timestamp"]].values.tolist()]
    for owner, own in frame.groupby(jobs.OWNER):
        before = None
        for at, value in zip(own["Timestamp"], own["Value"]):
            want.append([owner, at, 0.0 if before is None else value if value < before else value - before, False])
            before = value
    plain = lambda found: sorted([o, pd.Timestamp(t), v, bool(x)] for o, t, v, x in found)
    assert plain(done) == plain(want) and len(kept) == 4 and len(lanes) == 8


def test_alert_batches_do_not_follow_the_parts_of_the_table(spark):
    root, seen = scratch_path(spark, "tables"), []
    spark.range(60).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts").repartition(8).write.parquet(f"{root}/events.parquet")
    stream = read_stream(spark, event_files(spark, root)).writeStream.foreachBatch(lambda df, i: seen.append(df.count()))
    finish(stream.option("checkpointLocation", scratch_path(spark, "cp")))
    assert seen == [20, 20, 20]


def test_event_files_read_the_table_once_for_all_cuts(spark, monkeypatch):
    ids = [i * i - 50 for i in range(60)]
    table = spark.createDataFrame([(i, datetime(2024, 1, 1)) for i in [*ids, None]], "event_id long, ts timestamp").repartition(8)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(stream, "table", lambda *_: table.mapInArrow(counted, table.schema))
    monkeypatch.setattr(stream, "FILE_ROWS", 10)
    files = spark.read.parquet(event_files(spark, "")).select("event_id", F.input_file_name().alias("file")).collect()
    found = {f: sorted(r.event_id for r in files if r.file == f) for f in {r.file for r in files}}
    cuts = [ids[0] + (ids[-1] + 1 - ids[0]) * i // 6 for i in range(7)]
    assert sorted(found.values()) == [[i for i in ids if lo <= i < hi] for lo, hi in zip(cuts, cuts[1:])]
    assert read.value == 2 * len(ids) + 2  # once for the ends of the ids, once for the files
