"""Heartbeats and federated tables: suppliers as endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import federation as ops
from tidemark.session import scratch_path
from tidemark.workload.adapters import table, us
from tidemark.workload.aggregates import utc
from tidemark.workload.registry import query

NOW = utc(2024, 1, 31)


def heartbeats(spark, d) -> DataFrame:
    """Two heartbeats per supplier endpoint: an older one and one up to ten hours old; every ninth schema is broken."""
    s = table(spark, d, "supplier")
    hours = F.explode(F.array(F.lit(20), (F.col("s_suppkey") % 11).cast("int"))).alias("h")
    nation = F.col("s_nationkey").cast("string")
    good = F.concat(
        F.lit('[{"database":"Metrics","tables":["T'), nation, F.lit('","Common"],"views":["V'), (F.col("h") % 3).cast("string"),
        F.lit('"]},{"database":"Db'), (F.col("s_nationkey") % 5).cast("string"), F.lit('","tables":["Only"]}]'),
    )
    schema = F.when(F.col("s_suppkey") % 9 == 8, F.lit('[{"database":"Metrics"')).otherwise(good)
    rows = s.select("s_suppkey", "s_nationkey", hours)
    return rows.select(
        F.timestamp_micros(us(F.lit(NOW)) - F.col("h").cast("bigint") * 3_600_000_000).alias("Timestamp"),
        F.concat(F.lit("https://e"), F.col("s_suppkey").cast("string")).alias("ClusterEndpoint"), schema.alias("Schema"),
    )


LIVE_SQL = """live AS (SELECT 'https://e' || CAST(s_suppkey AS VARCHAR) AS endpoint, s_suppkey, s_nationkey, s_suppkey % 11 AS h, s_suppkey % 9 = 8 AS broken FROM supplier WHERE s_suppkey % 11 < 8)"""


@query("V6_live_endpoints", f"WITH {LIVE_SQL} SELECT endpoint, epoch_us(TIMESTAMP '2024-01-31') - h * 3600000000 AS ts_us, broken FROM live")
def v6(spark, d):
    out = ops.live_endpoints(heartbeats(spark, d), NOW, 8 * 3600)
    return out.select(F.col("ClusterEndpoint").alias("endpoint"), us("Timestamp").alias("ts_us"), (~F.col("Schema").endswith("]")).alias("broken"))


@query(
    "V7_federation_catalog",
    f"""WITH {LIVE_SQL}, good AS (SELECT * FROM live WHERE NOT broken), member AS (
      SELECT 'Metrics' AS database, 'T' || CAST(s_nationkey AS VARCHAR) AS t, endpoint FROM good UNION ALL SELECT 'Metrics', 'Common', endpoint FROM good
      UNION ALL SELECT 'Metrics', 'V' || CAST(h % 3 AS VARCHAR), endpoint FROM good UNION ALL SELECT 'Metrics', NULL, endpoint FROM good
      UNION ALL SELECT 'Db' || CAST(s_nationkey % 5 AS VARCHAR), 'Only', endpoint FROM good UNION ALL SELECT 'Db' || CAST(s_nationkey % 5 AS VARCHAR), NULL, endpoint FROM good)
    SELECT database, coalesce(t, '*') AS member, string_agg(endpoint, ',' ORDER BY endpoint) AS endpoints FROM member GROUP BY 1, 2""",
)
def v7(spark, d):
    catalog, _ = ops.federation_catalog(ops.live_endpoints(heartbeats(spark, d), NOW, 8 * 3600))
    return catalog.select("database", F.coalesce("table", F.lit("*")).alias("member"), F.array_join("endpoints", ",").alias("endpoints"))


@query("V7_catalog_errors", f"WITH {LIVE_SQL} SELECT endpoint, 'schema is not a valid document' AS reason FROM live WHERE broken")
def v7_errors(spark, d):
    return ops.federation_catalog(ops.live_endpoints(heartbeats(spark, d), NOW, 8 * 3600))[1]


@query(
    "V8_federated_table",
    """SELECT 'e' || CAST(n_regionkey AS VARCHAR) AS endpoint, count(*) AS n, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
)
def v8(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_acctbal", "n_regionkey")
    root = scratch_path(spark, "members")
    rows.write.partitionBy("n_regionkey").parquet(root)
    members = {}
    for (r,) in table(spark, d, "region").select("r_regionkey").toLocalIterator():
        base = f"{root}-e{r}"
        spark.read.parquet(f"{root}/n_regionkey={r}").write.parquet(f"{base}/Customers")
        members[f"e{r}"] = base
    members["e9"] = f"{root}-e9"
    out, skipped = ops.federated_table(spark, members, "Customers")
    if skipped != ["e9"]:
        raise RuntimeError(f"unexpected members skipped: {skipped}")
    return out.groupBy("endpoint").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


@query(
    "V8_from_heartbeats",
    """SELECT 'e' || CAST(n_regionkey AS VARCHAR) AS endpoint, CAST(NULL AS VARCHAR) AS reason, count(*) AS n, count(*) FILTER (n_regionkey % 2 = 0) AS named, round(sum(c_acctbal), 4) AS balance
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3 GROUP BY 1, n_regionkey
    UNION ALL SELECT 'e3', 'table not in the schema', NULL, NULL, NULL UNION ALL SELECT 'e9', 'no root', NULL, NULL, NULL""",
)
def v8_from_heartbeats(spark, d):
    """Regions as endpoints, from their heartbeats to one relation: one lacks the table, one is stale, one has no root, some lack a column."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_acctbal", "c_name", "n_regionkey")
    base = scratch_path(spark, "clusters")
    regions = [r for (r,) in table(spark, d, "region").select("r_regionkey").toLocalIterator()]
    for r in regions:
        part = rows.filter(F.col("n_regionkey") == r).drop("n_regionkey", *(["c_name"] if r % 2 else []))
        part.write.parquet(f"{base}/e{r}/Customers")
    schema = F.when(F.col("r") == 3, F.lit('[{"database":"Sales","tables":["Other"]}]')).otherwise(F.lit('[{"database":"Sales","tables":["Customers"]},{"database":"Else","tables":["Customers"]}]'))
    age = F.when(F.col("r") == 4, 20).otherwise(1)
    beats = spark.createDataFrame([(r,) for r in [*regions, 9]], "r int").select(
        F.timestamp_micros(us(F.lit(NOW)) - age.cast("bigint") * 3_600_000_000).alias("Timestamp"), F.concat(F.lit("e"), F.col("r").cast("string")).alias("ClusterEndpoint"), schema.alias("Schema"),
    )
    roots = spark.createDataFrame([(f"e{r}", f"{base}/e{r}/") for r in regions], "endpoint string, root string")
    catalog, _ = ops.federation_catalog(ops.live_endpoints(beats, NOW, 8 * 3600))
    out, left_out = ops.federated_relation(spark, catalog, roots, "Sales", "Customers")
    read = out.groupBy("endpoint").agg(F.count("*").alias("n"), F.count("c_name").alias("named"), F.round(F.sum("c_acctbal"), 4).alias("balance"))
    return read.withColumn("reason", F.lit(None).cast("string")).unionByName(left_out, allowMissingColumns=True)
