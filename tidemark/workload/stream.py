"""Streaming jobs run to completion over the events table, and the late split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.alerts import AlertRule
from tidemark.session import delete_path, scratch_path
from tidemark.streaming import jobs
from tidemark.workload.adapters import COUNTER_SQL, r6, table, us
from tidemark.workload.aggregates import bin_sql, utc
from tidemark.workload.registry import query
from tidemark.workload.series import change_sql

NOW = utc(2024, 1, 31)
BATCHES = 3
# Most rows of a file, on average; a larger table has more files instead of larger ones.
FILE_ROWS = 2_000_000


def event_files(spark, d, columns: list | None = None) -> str:
    """The events as a few files written one after the other in event order, the input folder of a stream.

    Each cut of the event ids is one file, and so one batch, however many parts the table is read in.
    The table is dealt to its cuts once, by all tasks; a file is then written from its own cut alone.
    """
    path, dealt = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-cuts")
    e = table(spark, d, "events")
    first, last, rows = e.agg(F.min("event_id"), F.max("event_id"), F.count("event_id")).first()
    batches = max(BATCHES, -(-rows // FILE_ROWS))
    # Cut i begins at first + (last + 1 - first) * i // batches; in decimals, because no product of ids may overflow.
    number = F.expr(f"((CAST(event_id AS DECIMAL(20, 0)) - ({first}) + 1) * {batches} - 1) DIV {last + 1 - first}")
    shaped = (e.select(*columns) if columns else e).withColumn("tm_cut", number).filter("tm_cut IS NOT NULL")
    shaped.write.partitionBy("tm_cut").parquet(dealt)
    stored = spark.read.schema(shaped.schema).parquet(dealt)
    for i in range(batches):
        stored.filter(F.col("tm_cut") == i).drop("tm_cut").coalesce(1).write.mode("append").parquet(path)
    delete_path(spark, dealt)
    return path


def read_stream(spark, path: str, per_batch: int = 1) -> DataFrame:
    """A stream over a folder taking ``per_batch`` files at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def finish(writer) -> None:
    """Run a stream over what is there and stop."""
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


def written(spark, sdf: DataFrame) -> DataFrame:
    """What a stream gives out over what is there, stored."""
    out = scratch_path(spark, "stream-out")
    writer = sdf.writeStream.outputMode("append").format("parquet").option("path", out)
    finish(writer.option("checkpointLocation", scratch_path(spark, "checkpoint")))
    return spark.read.schema(sdf.schema).parquet(out)


@query(
    "T1_stream_rollup",
    f"""SELECT {bin_sql("ts", 86400)} AS bin_us, event_type, round(sum(value), 6) AS total, count(*) AS n FROM events GROUP BY 1, 2
    HAVING {bin_sql("max(ts)", 86400)} + 86400000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)""",
)
def t1(spark, d):
    sdf = read_stream(spark, event_files(spark, d, ["event_id", "event_type", "ts", "value"]))
    rolled = jobs.stream_rollup(sdf, "1 day", "1 hour", ["event_type"], {"total": F.sum("value"), "n": F.count("*")})
    out = scratch_path(spark, "stream-rollup")
    writer = rolled.writeStream.outputMode("append").format("parquet").option("path", out)
    finish(writer.option("checkpointLocation", scratch_path(spark, "checkpoint")))
    return spark.read.parquet(out).select(us("bin").alias("bin_us"), "event_type", r6(F.col("total")).alias("total"), "n")


@query(
    "T6_stream_late",
    "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1",
)
def t6_stream(spark, d):
    """The newest third of the events comes first: bins in time and late rows together are all events."""
    path = scratch_path(spark, "stream-in")
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    first, last = e.agg(F.min("event_id"), F.max("event_id")).first()
    newest = F.col("event_id") >= first + (last - first) * 2 // 3
    # A row of a later year moves the watermark, so that what waits behind it is given out.
    end = spark.sql("SELECT CAST(0 AS BIGINT) AS event_id, 'end' AS event_type, TIMESTAMP '2100-01-01' AS ts, CAST(0 AS DOUBLE) AS value")
    for part in (e.filter(newest), e.filter(~newest | newest.isNull()), end):
        part.coalesce(1).write.mode("append").parquet(path)
    aggs = {"n": F.count("*"), "total": F.sum("value")}
    out = written(spark, jobs.stream_rollup_with_late(read_stream(spark, path), "1 day", "1 hour", ["event_type"], aggs))
    if out.groupBy(F.col("late_row").isNull()).count().count() != 2:
        raise RuntimeError("bins and late rows are both expected")
    return out.filter("event_type <> 'end'").groupBy("event_type").agg(F.sum("n").alias("n"), r6(F.sum("total")).alias("total"))


@query(
    "T2_stream_ingest",
    "SELECT 'Events' AS database, event_type AS table_name, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE value > 5 GROUP BY 2",
)
def t2(spark, d):
    sdf = read_stream(spark, event_files(spark, d))
    root = scratch_path(spark, "stream-ingest")
    steps = [
        lambda df: df.filter(F.col("value") > 5),
        lambda df: df.withColumns({"database": F.lit("Events!"), "table": F.col("event_type")}),
    ]
    finish(jobs.stream_ingest(sdf, steps, root, scratch_path(spark, "checkpoint")))
    out = spark.read.parquet(root).groupBy("database", F.col("table").alias("table_name"))
    return out.agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "T3_reassemble_stream",
    """WITH s AS (SELECT user_id, event_id, event_id % 4 = 0 AS partial, event_type || '#' || CAST(event_id AS VARCHAR) AS m,
        coalesce(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events)
    SELECT 'f' || CAST(user_id AS VARCHAR) AS file, max(event_id) AS "offset", string_agg(m, '' ORDER BY event_id) AS message FROM s GROUP BY user_id, g HAVING bool_or(NOT partial)""",
)
def t3(spark, d):
    columns = [
        "event_id", F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("offset"),
        (F.col("event_id") % 4 == 0).alias("is_partial"), F.concat("event_type", F.lit("#"), F.col("event_id").cast("string")).alias("message"),
    ]
    sdf = read_stream(spark, event_files(spark, d, columns)).drop("event_id")
    return written(spark, jobs.reassemble_stream(sdf, ["file"])).select("file", "offset", "message")


@query("T4_stream_increase", change_sql("v", "SELECT sid AS series, epoch_us(ts) AS ts_us, round(v, 6) AS v FROM c"))
def t4(spark, d):
    value = F.when(F.col("event_id") % 97 == 0, F.col("value")).otherwise(F.col("event_id") + F.col("value") / 1000)
    columns = ["event_id", F.col("user_id").alias("SeriesId"), F.col("ts").alias("Timestamp"), value.alias("Value")]
    sdf = read_stream(spark, event_files(spark, d, columns)).drop("event_id")
    rows = written(spark, jobs.stream_increase(sdf)).filter("NOT late")
    return rows.select(F.col("SeriesId").alias("series"), us("Timestamp").alias("ts_us"), r6(F.col("Value")).alias("v"))


@query(
    "T2_two_streams",
    """SELECT event_type AS table_name, 2 * count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1
    UNION ALL SELECT 'unrouted', 2 * count(*) FROM events WHERE event_type = 'click'""",
)
def t2_two(spark, d):
    """Two streams with checkpoints of their own into one root: both streams' rows stay, unrouted ones too."""
    path, root = event_files(spark, d), scratch_path(spark, "stream-ingest")
    table_of = F.when(F.col("event_type") != "click", F.col("event_type"))
    steps = [lambda df: df.withColumns({"database": F.lit("Events"), "table": table_of})]
    for _ in range(2):
        finish(jobs.stream_ingest(read_stream(spark, path), steps, root, scratch_path(spark, "checkpoint"), f"{root}-rest"))
    stored = spark.read.parquet(root).groupBy(F.col("table").alias("table_name")).agg(F.count("*").alias("n"))
    rest = spark.read.parquet(f"{root}-rest").agg(F.lit("unrouted").alias("table_name"), F.count("*").alias("n"))
    return stored.unionByName(rest)


RULE = AlertRule("ops", "errors", "SELECT 1", destination="team")


@query(
    "T5_stream_alerts",
    """SELECT DISTINCT 'ops/errors://user-' || CAST(user_id AS VARCHAR) AS correlation_id, 'Errors of user ' || CAST(user_id AS VARCHAR) AS title, CAST(2 AS BIGINT) AS severity
    FROM events WHERE event_type = 'error' AND value > 20""",
)
def t5(spark, d):
    sdf = read_stream(spark, event_files(spark, d, ["event_id", "event_type", "user_id", "ts", "value"])).filter((F.col("event_type") == "error") & (F.col("value") > 20))
    user = F.col("user_id").cast("string")
    rows = sdf.select(
        F.concat(F.lit("Errors of user "), user).alias("Title"), F.lit(2).alias("Severity"), F.concat(F.lit("user-"), user).alias("CorrelationId"), "ts"
    )
    found, _ = jobs.stream_alerts(rows, RULE, "CorrelationId", "60 days")
    out = scratch_path(spark, "stream-alerts")
    writer = found.writeStream.outputMode("append").format("parquet").option("path", out)
    finish(writer.option("checkpointLocation", scratch_path(spark, "checkpoint")))
    return spark.read.parquet(out).select("correlation_id", "title", "severity")


@query(
    "T5_alerts_without_id",
    """SELECT 'valid' AS kind, count(*) AS n FROM events WHERE event_type = 'error' AND event_id % 3 <> 0
    UNION ALL SELECT 'rejected', count(*) FROM events WHERE event_type = 'error' AND event_id % 3 = 0""",
)
def t5_without_id(spark, d):
    """Alert rows without a correlation id, a third of them without a severity: each is its own alert or reject."""
    sdf = read_stream(spark, event_files(spark, d, ["event_id", "event_type", "ts"])).filter("event_type = 'error'")
    severity = F.when(F.col("event_id") % 3 != 0, F.lit("2")).otherwise("high")
    rows = sdf.select(F.lit("Error").alias("Title"), severity.alias("Severity"), F.lit("").alias("CorrelationId"), "ts")
    found = written(spark, jobs.judge_stream_alerts(rows, RULE, "CorrelationId", "60 days"))
    parts = {"valid": found.filter("reason IS NULL"), "rejected": found.filter("reason IS NOT NULL")}
    kinds = [part.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, part in parts.items()]
    return kinds[0].unionByName(kinds[1])


@query(
    "T6_split_late",
    "SELECT event_type, ts < TIMESTAMP '2024-01-21' AS late, count(*) AS n FROM events GROUP BY 1, 2",
)
def t6(spark, d):
    on_time, late, _ = jobs.split_late(table(spark, d, "events"), NOW, 10 * 86_400)
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("event_type", "late").agg(F.count("*").alias("n"))


__all__ = ["COUNTER_SQL"]
