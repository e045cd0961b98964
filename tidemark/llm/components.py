"""Connected components by alternating large and small stars.

Each round is a minimum per node (combined before the shuffle) and a join back, so a
hub with very many neighbours is split by the adaptive skew join. Every round is written
to the shared folder. The edges end as stars whose centres are the smallest nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import stored


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.where("v > u").join(_smallest(both), "u")
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    joined = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v")
    return joined.union(least.select("u", F.col("least").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v): every node ``u`` that is not the smallest of its component, and that smallest as ``root``."""
    now = stored(edges.where("u != v").distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        now = stored(_small_star(_large_star(now)), "stars")
    return now.select("u", F.col("v").alias("root"))
