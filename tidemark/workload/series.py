"""Counter functions over per-user series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import series as ops
from tidemark.workload.adapters import COUNTER_SQL, counters, r6, table, us
from tidemark.workload.registry import query

CHANGE_SQL = """WITH {counter}, w AS (
  SELECT sid, ts, v, region, lag(v) OVER o AS p, lead(v) OVER o AS nx, lag(ts) OVER o AS pts FROM counter WINDOW o AS (PARTITION BY sid ORDER BY ts)),
  c AS (SELECT sid, ts, pts, region, CASE WHEN p IS NULL THEN 0 WHEN v - p < 0 THEN {reset} ELSE v - p END AS v FROM w)
  {rest}"""


def change_sql(reset: str, rest: str) -> str:
    return CHANGE_SQL.format(counter=COUNTER_SQL, reset=reset, rest=rest)


SHOW = "SELECT sid AS series, epoch_us(ts) AS ts_us, round(v, 6) AS v FROM c"


def _shown(df):
    return df.select(F.col("SeriesId").alias("series"), us("Timestamp").alias("ts_us"), r6(F.col("Value")).alias("v"))


@query("A1_increase", change_sql("nx - v", SHOW))
def a1(spark, d):
    return _shown(ops.increase(counters(spark, d)))


@query("A1_increase_from_zero", change_sql("v", SHOW))
def a1_zero(spark, d):
    return _shown(ops.increase(counters(spark, d), reset="prometheus"))


@query(
    "A2_rate",
    change_sql(
        "nx - v",
        "SELECT sid AS series, epoch_us(ts) AS ts_us, round(v / ((epoch_us(ts) - epoch_us(pts)) / 1000000.0), 6) AS v FROM c WHERE pts IS NOT NULL AND v IS NOT NULL",
    ),
)
def a2(spark, d):
    return _shown(ops.rate(counters(spark, d)))


@query("A3_delta", change_sql("nx - v", SHOW))
def a3(spark, d):
    return _shown(ops.delta(counters(spark, d)))


@query("A3_delta_gauge", change_sql("v - p", SHOW))
def a3_gauge(spark, d):
    return _shown(ops.delta(counters(spark, d), gauge=True))


@query("A4_counter_totals", change_sql("nx - v", "SELECT region, round(sum(v), 4) AS total FROM c GROUP BY 1"))
def a4(spark, d):
    out = ops.counter_totals(counters(spark, d), {"region": F.col("Labels")["region"]})
    return out.select("region", F.round("total", 4).alias("total"))


@query(
    "A5_snapshot_delta",
    """WITH s AS (SELECT event_type, epoch_us(date_trunc('day', ts)) AS ts_us, count(*) AS e, sum(value) AS ds, count(*) FILTER (value > 20) AS dc FROM events GROUP BY 1, 2),
      w AS (SELECT *, coalesce(lag(e) OVER o, 0) AS pe, coalesce(lag(ds) OVER o, 0) AS pds, coalesce(lag(dc) OVER o, 0) AS pdc FROM s WINDOW o AS (PARTITION BY event_type ORDER BY ts_us)),
      x AS (SELECT event_type, ts_us, CASE WHEN e < pe THEN e ELSE e - pe END AS evaluations, CASE WHEN ds < pds THEN ds ELSE ds - pds END AS ds, CASE WHEN dc < pdc THEN dc ELSE dc - pdc END AS dc FROM w)
    SELECT event_type, ts_us, evaluations, round(CASE WHEN dc = 0 THEN 0 ELSE ds / dc END, 6) AS average_duration FROM x""",
)
def a5(spark, d):
    e = table(spark, d, "events")
    snapshots = e.groupBy("event_type", F.date_trunc("day", "ts").alias("ts")).agg(
        F.count("*").alias("evaluations"), F.sum("value").alias("duration_sum"), F.count_if(F.col("value") > 20).alias("duration_count")
    )
    out = ops.snapshot_delta(snapshots, ["event_type"])
    return out.select("event_type", us("ts").alias("ts_us"), "evaluations", r6(F.col("average_duration")).alias("average_duration"))
