"""Day-partitioned, series-ordered layout, compaction and table inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.session import delete_path, stored

# Smallest batch worth writing and most files in a batch.
TARGET_BYTES = 100 * 1024 * 1024
MAX_FILES = 25

# Most partitions an estimate of the planner may ask for unchecked; joins multiply estimates, unknown sizes are 2^63.
BELIEVED = 100_000
# Columns that single rows are looked up by.
LOOKUP = ("TraceId", "SeriesId")


def layout_order(columns: list[str]) -> list[str]:
    """Sort columns of a table: series and time, else time, else the first column."""
    if "SeriesId" in columns and "Timestamp" in columns:
        return ["SeriesId", "Timestamp"]
    return ["Timestamp"] if "Timestamp" in columns else columns[:1]


def sampled_bytes(df: DataFrame, fraction: float = 0.01) -> int:
    """Size of a frame from one pass: its rows are counted and a share of them is measured as JSON."""
    picked = F.when(F.rand(7) < fraction, F.octet_length(F.to_json(F.struct(*df.columns))))
    seen = df.select(picked.alias("size")).agg(F.count("*").alias("rows"), F.avg("size").alias("size")).first()
    return int(seen["rows"] * (seen["size"] or 0))


def range_partitions(df: DataFrame, target_bytes: int = TARGET_BYTES) -> int:
    """Partitions for a range shuffle: the session's setting, or more when the frame's size asks for it.

    The planner's estimate is believed up to ``BELIEVED`` partitions. What is above, and rows
    that have no estimate (made in Python, an RDD or a micro-batch), are measured on a sample.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate // target_bytes > BELIEVED:
        estimate = sampled_bytes(df)
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, -(-estimate // target_bytes))


def write_layout(df: DataFrame, path: str, mode: str = "append", lookup: tuple[str, ...] = LOOKUP, **options: str) -> None:
    """Write ordered by series and time inside day partitions.

    Ranges are cut on (day, series, time), so a hot series is split over tasks
    and row groups keep narrow series and time bounds for scan pruning. Columns of
    ``lookup`` get bloom filters, so a read of one id skips the row groups without it
    even where the order does not help. ``options`` go to the Parquet writer.
    """
    order = layout_order(df.columns)
    parts = range_partitions(df)
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in lookup if c in df.columns}
    if "Timestamp" not in df.columns:
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode(mode).options(**blooms, **options).parquet(path)
        return
    dated = df.withColumn("day", F.to_date("Timestamp"))
    ranged = dated.repartitionByRange(parts, "day", *order).sortWithinPartitions("day", *order)
    ranged.write.mode(mode).options(**blooms, **options).partitionBy("day").parquet(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Folder, path and size of the data files below a table; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return files.load(path).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("path").alias("file"), F.col("length").alias("bytes")
    )


def plan_compaction(files: DataFrame, target_bytes: int = TARGET_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """Batch number per file: files of one folder in name order, cut by bytes and by count.

    Folders whose files already reach the target on average stay as they are.
    """
    order = Window.partitionBy("folder").orderBy("file")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    position = F.row_number().over(order) - 1
    average = F.avg("bytes").over(Window.partitionBy("folder"))
    planned = files.select(
        "folder",
        "file",
        "bytes",
        F.floor(before / F.lit(float(target_bytes))).alias("_by_bytes"),
        F.floor(position / F.lit(float(max_files))).alias("_by_count"),
        (average < target_bytes).alias("small"),
    )
    return planned.select(
        "folder", "file", "bytes", "small", F.concat_ws("/", "folder", "_by_bytes", "_by_count").alias("batch")
    )


def compact(
    spark: SparkSession, path: str, out: str | None = None, partition_by: list[str] | None = None,
    target_bytes: int = TARGET_BYTES, max_files: int = MAX_FILES,
) -> DataFrame:
    """Rewrite small files into files of about ``target_bytes`` and return the plan they were chosen by.

    Without ``out`` only the folders of small files are rewritten, in place: the new files
    are added first, then exactly the files they replace are removed, so what other
    writers add meanwhile stays. Until the removal ends a reader may see rows of a folder
    twice; a run that dies in between is finished by removing the files of its plan.
    With ``out`` the whole table is written there. Rows are rebalanced by partition: the
    adaptive plan merges what is small and splits what is large, so a partition holding
    most of the table is written by many tasks.
    """
    plan = stored(plan_compaction(list_files(spark, path), target_bytes, max_files), "compaction")
    rows = spark.read.parquet(path)
    columns = rows.columns
    small = plan.filter("small").select(F.col("file").alias("_file"))
    if out is None:
        if not partition_by:
            raise ValueError("compaction in place needs a partitioned table")
        rows = rows.withColumn("_file", F.col("_metadata.file_path")).join(small, "_file", "left_semi").select(*columns)
    balanced = rows.hint("rebalance", *(partition_by or []))
    writer = balanced.write.mode("append" if out is None else "overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, str(target_bytes))
    try:
        writer.parquet(out or path)
    finally:
        spark.conf.set(advisory, before)
    if out is None:
        for row in small.toLocalIterator():
            delete_path(spark, row["_file"])
    return plan


def table_details(spark: SparkSession, root: str, now, tables: list[str]) -> DataFrame:
    """Rows, bytes and files of each table below ``root``, stamped with the snapshot time.

    Row counts come from Parquet footers; no column is read.
    """
    from functools import reduce

    counts = reduce(
        lambda a, b: a.unionByName(b),
        [
            spark.read.parquet(f"{root}/{t}").agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
            for t in tables
        ],
    )
    files = reduce(
        lambda a, b: a.unionByName(b), [list_files(spark, f"{root}/{t}").withColumn("table", F.lit(t)) for t in tables]
    )
    sizes = files.groupBy("table").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("extents"))
    return counts.join(sizes, "table", "left").select(F.lit(now).alias("ts"), "table", "rows", "bytes", "extents")
