"""Minimax contiguous partition of documents into shards, with DataFrame operations only.

Equal texts form one atomic group. Groups stand in the order of a hash of their text.
The smallest capacity at which a greedy walk needs no more than ``shards`` shards is
found by search, and the groups are cut there.

A greedy walk needs only the running total of group sizes: the next cut is the last
total that is at most the cut before plus the capacity. Totals are computed by bucket
(one sum per bucket, one window within each), so no task holds all groups. A round of
the search walks ``PROBES`` capacities at once, a small aggregate per shard, and leaves a
narrower range of capacities, hence a narrower range for each cut. When at most
``TAIL_ROWS`` totals lie in those ranges, they are fetched and the search ends on them;
that bound does not depend on the input.

Null texts have no bytes, count as one byte by the contract's size and form a group of
their own. A group larger than the ideal capacity fills a shard alone. An empty table
gives no rows. Repeated rows are separate rows of one group. Slots follow the hash of
the id, then the id.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.rows import stored

BUCKETS = 4096
SALTS = 256
PROBES = 15
TAIL_ROWS = 50_000


def running_totals(groups: DataFrame) -> DataFrame:
    """groups (key, size) with ``bucket`` and ``total``: the sum of sizes up to and with each group in key order."""
    keyed = groups.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    sums = keyed.groupBy("bucket").agg(F.sum("size").alias("bucket_size"))
    # One row per bucket: at most BUCKETS rows whatever the input.
    before = F.sum("bucket_size").over(Window.orderBy("bucket")) - F.col("bucket_size")
    offsets = sums.select("bucket", before.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("bucket").orderBy("key"))
    return keyed.withColumn("inside", inside).join(F.broadcast(offsets), "bucket").select("key", "size", "bucket", (F.col("before") + F.col("inside")).alias("total"))


def next_cuts(totals: DataFrame, limits: list[int], reach: int) -> list[int]:
    """For each limit the largest running total that is not above it."""
    best = [F.max(F.when(F.col("total") <= x, F.col("total"))).alias(f"c{i}") for i, x in enumerate(limits)]
    # No group is larger than a capacity, so no cut lies further below its limit than ``reach``.
    row = totals.where(F.col("total").between(min(limits) - reach, max(limits))).agg(*best).first()
    return [row[f"c{i}"] or 0 for i in range(len(limits))]


def greedy(capacities: list[int], shards: int, totals: DataFrame) -> list[list[int]]:
    """The cuts of a greedy walk for each capacity, all capacities in one job per shard."""
    cuts: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        at = next_cuts(totals, [a + c for a, c in zip(at, capacities)], max(capacities))
        for own, a in zip(cuts, at):
            own.append(a)
    return cuts


def smallest_capacity(totals: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cuts (running totals where shards end)."""
    facts = totals.agg(F.max("total").alias("all"), F.max("size").alias("largest")).first()
    if facts["all"] is None:
        return 0, []
    total, largest = facts["all"], facts["largest"]
    low = max(largest, -(-total // shards))  # no capacity below can do
    high = low + largest  # always feasible
    while True:
        lowest, highest = greedy([low, high], shards, totals)
        if low == high:
            return low, lowest
        step = max(1, (high - low) // (PROBES + 1))
        inside = F.lit(False)
        for a, b in zip(lowest, highest):
            inside = inside | F.col("total").between(a, b)
        tail = totals.where(inside).select("total")
        if tail.count() <= TAIL_ROWS:
            return finish(sorted(r["total"] for r in tail.collect()), low, high, shards, total)
        tried = [*range(low, high, step)][: PROBES + 1]
        good = [cuts[-1] >= total for cuts in greedy(tried, shards, totals)]
        for c, ok in zip(tried, good):
            if ok:
                high = c
                break
            low = c + 1


def finish(points: list[int], low: int, high: int, shards: int, total: int) -> tuple[int, list[int]]:
    """Binary search between two capacities on the totals where their cuts can lie."""

    def walk(capacity: int) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            at = max(at, points[bisect_right(points, at + capacity) - 1])
            cuts.append(at)
        return cuts

    while low < high:
        middle = (low + high) // 2
        if walk(middle)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low, walk(low)


def ranked(rows: DataFrame, within: str, salt: Column, order: list[str | Column], name: str) -> DataFrame:
    """Gapless numbers from 0 within ``within``: rows are numbered per salt and shifted by the salts before."""
    salted = rows.withColumn("_salt", salt)
    counts = salted.groupBy(within, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(within).orderBy("_salt")) - F.col("_n")
    offsets = counts.select(within, "_salt", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy(within, "_salt").orderBy(*order)) - 1
    numbered = salted.withColumn("_at", number).join(F.broadcast(offsets), [within, "_salt"])
    return numbered.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_salt", "_at", "_before")


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; ``size`` is the UTF-8 length plus 1."""
    data = F.col("text")
    narrow = stored(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).select(
            "doc_id",
            (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(data, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(data.isNull(), F.sha2(F.lit("no text").cast("binary"), 224)).otherwise(F.sha2(data.cast("binary"), 256)).alias("key"),
        ),
        "shard-rows",
    )
    groups = narrow.groupBy("key").agg(F.sum("size").alias("size"))
    totals = stored(running_totals(groups), "shard-totals")
    capacity, cuts = smallest_capacity(totals, shards)
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + (F.col("total") > cut).cast("int")
    placed = totals.select("key", shard.alias("shard"))
    rows = narrow.join(placed, "key").drop("key")
    salt = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SALTS)).cast("int")
    return ranked(rows, "shard", salt, ["doc_id", "text_crc32", "size"], "slot")


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    return shard_documents(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
