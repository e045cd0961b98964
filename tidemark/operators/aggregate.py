"""Aggregations of the stored and documented queries.

Every aggregate here combines on the map side, so a hot dimension value costs
one partial row per task, not a large group.
"""

from __future__ import annotations

import math
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.labels import xxhash64_seed0
from tidemark.functions.once import compute_once
from tidemark.functions.timebin import MICROS, bin_micros, floor_div, in_window, time_bin
from tidemark.session import stored

AGGREGATES = {
    "avg": F.avg,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "count": F.count,
}


def rollup(df: DataFrame, step: int, dims: list[str], aggs: dict[str, Column], ts: str = "ts", bin_name: str = "bin") -> DataFrame:
    """Aggregate per time bin of ``step`` seconds and dimension values."""
    return df.groupBy(time_bin(F.col(ts), step).alias(bin_name), *dims).agg(*[a.alias(n) for n, a in aggs.items()])


def rollup_partials(df: DataFrame, step: int, dims: list[str], value: str = "value", ts: str = "ts", bin_name: str = "bin") -> DataFrame:
    """Rollup storing count, sum, min and max, which later rollups can combine."""
    v = F.col(value)
    return rollup(
        df,
        step,
        dims,
        {"n": F.count(v), "total": F.sum(v), "low": F.min(v), "high": F.max(v)},
        ts,
        bin_name,
    )


def error_rate(df: DataFrame, bad: Column, dims: list[str | Column]) -> DataFrame:
    """Rows, matching rows and their percentage per group."""
    return df.groupBy(*dims).agg(
        F.count("*").alias("requests"),
        F.count_if(bad).alias("errors"),
        (F.count_if(bad) * F.lit(100.0) / F.count("*")).alias("error_rate"),
    )


def service_health(metrics: DataFrame, logs: DataFrame, step: int, key: str = "service") -> DataFrame:
    """Request totals per service and bin with the error count of the logs beside them.

    Both sides are aggregated to (key, bin) before they are joined, so the join
    meets one row per group. ``errors`` is the bin's own count.
    """
    requests = rollup(
        metrics, step, [key], {"request_count": F.sum("value"), "avg_duration": F.avg("duration"), "_rows": F.count("*")}
    )
    errors = rollup(logs, step, [key], {"_errors": F.count("*")})
    joined = requests.join(errors, [key, "bin"], "left")
    errors_or_zero = F.coalesce("_errors", F.lit(0))
    # The documented query sums after joining, which counts a bin's errors once per sample.
    return joined.select(
        key,
        "bin",
        "request_count",
        "avg_duration",
        errors_or_zero.alias("errors"),
        (errors_or_zero * F.col("_rows")).alias("error_count"),
    )


def latest_by(df: DataFrame, keys: list[str], ts: str, cols: list[str]) -> DataFrame:
    """Values of ``cols`` on the latest row of each key; equal times are settled by the values."""
    picked = F.max_by(F.struct(ts, *cols), F.struct(ts, *cols)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


#: Rank error of the splitter sketch as a share of the rows; a bracket spans four of them and its ends' own error.
SPLITTER_ERROR = 1e-4
#: Distinct values that are ranked in one task.
RANKED = 1_000_000


def _splitters(rows: DataFrame, shares: list[float]) -> list[float]:
    """Values near the given shares of the rows, by a mergeable sketch with a sure rank error."""
    return rows.agg(F.percentile_approx("v", [min(1.0, max(0.0, q)) for q in shares], round(1 / SPLITTER_ERROR)).alias("p")).first()["p"] or []


def _cell(splitters: list[float]) -> Column:
    """2i + 1 for values equal to splitter i, 2i for those below it and above the one before."""
    below = reduce(lambda a, b: a + b, [(F.lit(x) < F.col("v")).cast("int") for x in splitters])
    return below * 2 + F.col("v").isin(splitters).cast("int")


def _sizes(cells: DataFrame) -> list[tuple[int, int, int]]:
    """Each cell's number, rows and distinct values, in order; there are a few per splitter."""
    return sorted(tuple(r) for r in cells.groupBy("cell").agg(F.sum("n"), F.count("*")).collect())


def _find(sizes: list[tuple[int, int, int]], rank: int) -> tuple[int, int, int]:
    """The cell that holds a rank, the rank inside it and the number of its distinct values."""
    for cell, n, distinct in sizes:
        if rank <= n:
            break
        rank -= n
    return cell, rank, distinct


def _at_rank(values: DataFrame, rank: int, distinct: int) -> DataFrame:
    """The value at a rank of counted values ``v, n``; they are split until one task can rank what is left."""
    while distinct > RANKED:
        cell = _cell(sorted(set(_splitters(values, [i / 64 for i in range(65)]))))
        at, rank, distinct = _find(_sizes(values.withColumn("cell", cell)), rank)
        values = values.filter(cell == at)
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("upto", upto).filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select("v")


def exact_quantiles(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """Exact nearest-rank quantiles of a numeric column, as rows ``quantile, value``; null and NaN do not count.

    Two passes over the rows. The first is a quantile sketch whose rank error is at most
    one row in 10,000: it gives two splitters around each wanted rank. The second counts
    the cells between splitters and, around a rank, each distinct value. However the
    values are spread, such a cell holds at most one row in a thousand; ties are one
    counted value. The counted values are stored and ranked, more than a million of them
    after further splits. Should a rank lie outside its splitters, its cell is counted again.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    shares = sorted({float(q) for q in quantiles})
    found = _splitters(rows, [q + side * 2 * SPLITTER_ERROR for q in shares for side in (-1, 1)])
    if not found:
        return df.sparkSession.createDataFrame([], "quantile double, value double")
    points = sorted(set(found))
    number = {x: i for i, x in enumerate(points)}
    near = sorted({2 * i for lo, hi in zip(found[::2], found[1::2]) for i in range(number[lo] + 1, number[hi] + 1)})
    cell = _cell(points)
    known = (F.col("cell") % 2 == 1) | F.col("cell").isin(near)
    counted = rows.withColumn("cell", cell).groupBy("cell", F.when(known, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    counted = stored(counted, "quantile-cells")
    sizes = _sizes(counted)
    total = sum(n for _, n, _ in sizes)
    out = []
    for q in shares:
        at, rank, distinct = _find(sizes, max(1, math.ceil(q * total)))
        values = counted.filter(F.col("cell") == at)
        if at % 2 == 0 and at not in near:
            values = stored(rows.filter(cell == at).groupBy("v").agg(F.count("*").alias("n")), "quantile-cell")
            distinct = values.count()
        out.append(_at_rank(values.select("v", "n"), rank, distinct).select(F.lit(q).alias("quantile"), F.col("v").alias("value")))
    return reduce(DataFrame.unionAll, out)


def ingestion_delay_percentiles(
    df: DataFrame,
    observed: str = "observed_ts",
    ingested: str = "ingested_ts",
    percentiles: tuple[float, ...] = (50, 90, 99, 100),
    exact: bool = False,
) -> DataFrame:
    """Percentiles of ingestion time minus observed time, in microseconds."""
    delay = df.select((F.unix_micros(ingested) - F.unix_micros(observed)).alias("delay_us"))
    shares = [p / 100 for p in percentiles]
    if exact:
        found = exact_quantiles(delay, "delay_us", shares)
        return found.select((F.col("quantile") * 100).alias("percentile"), F.col("value").alias("delay_us"))
    sketch = delay.agg(F.percentile_approx("delay_us", shares, 100_000).alias("p"))
    named = sketch.select(F.array(*[F.lit(float(p)) for p in percentiles]).alias("percentile"), F.col("p").alias("delay_us"))
    rows = named.select(F.inline(F.arrays_zip("percentile", "delay_us")))
    return rows.withColumn("delay_us", F.col("delay_us").cast("double"))


def union_fuzzy(dfs: dict[str, DataFrame | None], source_col: str = "source") -> DataFrame:
    """Union of named tables by column name with their name beside each row.

    Columns a table lacks are null; absent tables (``None``) are skipped.
    """
    present = [df.withColumn(source_col, F.lit(name)) for name, df in dfs.items() if df is not None]
    if not present:
        raise ValueError("no table to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def count_cardinality(
    tables: DataFrame, now: datetime, table: str = "table", since_s: int = 3600, until_s: int = 300, exact: bool = False
) -> DataFrame:
    """Distinct series per table over ``[now - 1h, now - 5m)``, as metric rows."""
    stop = F.lit(now)
    recent = tables.filter(
        in_window(
            F.col("Timestamp"),
            stop - F.make_dt_interval(secs=F.lit(since_s)),
            stop - F.make_dt_interval(secs=F.lit(until_s)),
        )
    )
    counter = F.count_distinct("SeriesId") if exact else F.approx_count_distinct("SeriesId", 0.01)
    counted = recent.groupBy(table).agg(counter.cast("double").alias("Value"))
    return counted.select(
        time_bin(stop, 60).alias("Timestamp"),
        xxhash64_seed0(F.col(table)).alias("SeriesId"),
        F.create_map(F.lit("table"), F.col(table)).alias("Labels"),
        "Value",
    )


#: log2 of the buckets of a stored distinct-count sketch: a standard error of 0.8 %, at most 16 KiB a sketch.
SKETCH_BITS = 14


def rollup_distinct(df: DataFrame, step: int, dims: list[str], column: str, ts: str = "ts", bin_name: str = "bin") -> DataFrame:
    """Rollup that stores, as ``sketch``, what later rollups need to count distinct values of a column."""
    return rollup(df, step, dims, {"sketch": F.hll_sketch_agg(column, SKETCH_BITS)}, ts, bin_name)


def reaggregate_distinct(rollup_df: DataFrame, step: int, dims: list[str], bin_name: str = "bin") -> DataFrame:
    """Coarser rollup from stored sketches: a value in several fine bins counts once in the coarse one."""
    coarse = F.timestamp_micros(bin_micros(F.unix_micros(bin_name), step)).alias(bin_name)
    return rollup_df.groupBy(coarse, *dims).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimate(rollup_df: DataFrame) -> DataFrame:
    """Rollup rows with ``distinct``, the estimate of their sketches, instead of those."""
    return rollup_df.withColumn("distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def unused_tables(snapshots: DataFrame, more_than: int = 2) -> DataFrame:
    """Tables whose latest snapshots were all empty more than ``more_than`` times in a row.

    ``snapshots``: table, ts, rows. Two aggregates and a join on the table name;
    no window over a table's whole history.
    """
    last_filled = snapshots.groupBy("table").agg(F.max(F.when(F.col("rows") > 0, F.col("ts"))).alias("_filled"))
    empties = snapshots.filter(F.col("rows") == 0).join(last_filled, "table")
    runs = (
        empties.filter(F.col("_filled").isNull() | (F.col("ts") > F.col("_filled")))
        .groupBy("table")
        .agg(F.count("*").alias("empty_snapshots"), F.min("ts").alias("empty_since"))
    )
    return runs.filter(F.col("empty_snapshots") > more_than)


def make_series(
    df: DataFrame,
    start: datetime,
    end: datetime,
    step: int,
    dims: list[str],
    aggs: dict[str, Column],
    default: float = 0.0,
    ts: str = "ts",
) -> DataFrame:
    """One row per dimension set with a dense array per aggregate, ``default`` where a bin is empty.

    Bins start at ``start`` and cover ``[start, end)``. Rows are aggregated to
    bins first; the dense array is filled from the bins by position, with no
    cross join of bins and dimensions.
    """
    t0 = F.unix_micros(F.lit(start))
    n_bins = -(-int((end - start).total_seconds()) // step)
    position = floor_div(F.unix_micros(ts) - t0, step * MICROS).cast("int")
    binned = (
        df.filter(in_window(F.col(ts), start, end))
        .groupBy(*dims, position.alias("_i"))
        .agg(*[a.cast("double").alias(n) for n, a in aggs.items()])
    )
    filled = binned.groupBy(*dims).agg(F.sort_array(F.collect_list(F.struct("_i", *aggs))).alias("_bins"))
    times = F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: F.timestamp_micros(t0 + i.cast("bigint") * F.lit(step * MICROS))
    )

    def dense(name: str) -> Column:
        bins, fill = F.col("_bins"), F.lit(float(default))

        def with_gap(e: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(-1)).otherwise(F.get(bins, k - 1)["_i"])
            return F.concat(F.array_repeat(fill, e["_i"] - before - 1), F.array(e[name]))

        tail = F.array_repeat(fill, F.lit(n_bins - 1) - F.get(bins, F.size(bins) - 1)["_i"])
        return F.concat(F.flatten(F.transform(bins, with_gap)), tail)

    return filled.select(*dims, times.alias("times"), *[dense(n).alias(n) for n in aggs])


def distinct_values(df: DataFrame, expr: Column) -> DataFrame:
    """Distinct values of an expression."""
    return df.select(expr).distinct()


def project_paths(df: DataFrame, paths: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Columns read from JSON members: ``{name: (column, path, type)}``; unreadable values are null."""
    kinds = dict(df.dtypes)
    used = {column for column, _, _ in paths.values()}
    parsed = {c: F.col(c) if kinds[c] == "variant" else F.try_parse_json(c) for c in sorted(used)}
    docs = compute_once(df.select(*sorted(used)), **{f"_doc_{c}": v for c, v in parsed.items()})
    columns = []
    for name, (column, path, kind) in paths.items():
        text = F.try_variant_get(F.col(f"_doc_{column}"), path, "string")
        columns.append((text if kind == "string" else text.try_cast(kind)).alias(name))
    return docs.select(*columns)


def contains_ci(c: Column, text: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(c).contains(text.lower())


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clean_values(df: DataFrame, value: str = "value", fallbacks: dict[str, list[str]] | None = None, default: str = "unknown") -> DataFrame:
    """Finite values only; each fallback column takes the first non-empty text of its candidates."""
    kept = df.filter(is_finite(F.col(value)))
    for name, candidates in (fallbacks or {}).items():
        texts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in candidates]
        kept = kept.withColumn(name, F.coalesce(*texts, F.lit(default)))
    return kept


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows in a declared order."""
    return df.orderBy(*order).limit(n)


def stitched_rollup(
    stored: DataFrame, raw: DataFrame, step: int, dims: list[str], aggs: dict[str, Column], ts: str = "ts", dedupe: bool = True
) -> DataFrame:
    """Stored rollup rows with a rollup of the raw rows after them.

    ``dedupe`` starts after the last stored bin. Without it the last stored bin
    is computed again from raw rows and appears twice, as in the documented view.
    """
    last = F.max("bin")
    after = F.timestamp_micros(F.unix_micros(last) + F.lit(step * MICROS)) if dedupe else last
    # A scalar subquery: evaluated once, then used as a filter of the raw scan.
    bound = stored.agg(F.coalesce(after, F.timestamp_micros(F.lit(-(1 << 55))))).scalar()
    recent = raw.filter(F.col(ts) >= bound)
    return stored.unionByName(rollup(recent, step, dims, aggs, ts), allowMissingColumns=True)


def reaggregate(rollup_df: DataFrame, step: int, dims: list[str], bin_name: str = "bin") -> DataFrame:
    """Coarser rollup from stored partials (``n, total, low, high``), with the exact average."""
    coarse = F.timestamp_micros(bin_micros(F.unix_micros(bin_name), step)).alias(bin_name)
    return (
        rollup_df.groupBy(coarse, *dims)
        .agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        .withColumn("average", F.col("total") / F.col("n"))
    )
