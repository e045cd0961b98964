"""Ordered per-key work without gathering a key in one task.

A plain window over a key sends all of its rows to one task. Here a key is cut
into slices of its order column, the window runs per (key, slice), and what
crosses a slice border comes from a small table with one row per (key, slice).
The rows are shuffled once, by (key, slice); the border table is joined on the
same columns, so the join adds no shuffle of the rows. Null keys are given a
stand-in value and a mark while this runs, so plain equality keeps their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.timebin import floor_div

SLICE = "_slice"
NULLS = "_nulls"
# Slice of rows without a position.
NO_SLICE = -(1 << 62)


def _stand_in(kind: T.DataType) -> Column | None:
    """Value a null key of this type takes; None for types left as they are."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return None


def _sliced(df: DataFrame, keys: list[str], slice_of: Column) -> DataFrame:
    """Rows with their slice, and null keys replaced and marked, one bit per key."""
    columns = {SLICE: F.coalesce(slice_of, F.lit(NO_SLICE))}
    mask = F.lit(0)
    for i, key in enumerate(keys):
        field = df.schema[key]
        value = _stand_in(field.dataType) if field.nullable else None
        if value is not None:
            mask = mask + F.when(F.col(key).isNull(), 1 << i).otherwise(0)
            columns[key] = F.coalesce(F.col(key), value)
    columns[NULLS] = mask
    return df.withColumns(columns)


def _restored(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their null keys back, without the columns of this module."""
    marked = {k: F.when(F.col(NULLS).bitwiseAND(1 << i) == 0, F.col(k)) for i, k in enumerate(keys)}
    return df.withColumns(marked).drop(SLICE, NULLS)


def time_slice(ts: Column, seconds: int) -> Column:
    """Slice number of a timestamp."""
    return floor_div(F.unix_micros(ts), seconds * 1_000_000)


def number_slice(n: Column, width: int) -> Column:
    """Slice number of an integer position."""
    return floor_div(n, width)


def with_neighbours(
    df: DataFrame, keys: list[str], order: list[str], carry: list[str], slice_of: Column, next_too: bool = True
) -> DataFrame:
    """Add ``_prev`` and ``_next``: structs of ``carry`` from the neighbouring rows of the same key.

    Rows of a key are ordered by ``order``, whose first column never decreases with the slice.
    """
    sliced = _sliced(df, keys, slice_of)
    names, keys = keys, [*keys, NULLS]
    payload = F.struct(*carry)
    sort_key = F.struct(*order, *[c for c in carry if c not in order])
    borders = sliced.groupBy(*keys, SLICE).agg(
        F.max_by(payload, sort_key).alias("_last"), F.min_by(payload, sort_key).alias("_first")
    )
    across = Window.partitionBy(*keys).orderBy(SLICE)
    borders = borders.select(
        *keys, SLICE, F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after")
    )
    within = Window.partitionBy(*keys, SLICE).orderBy(*order, *[c for c in carry if c not in order])
    rows = sliced.withColumn("_prev", F.lag(payload).over(within))
    if next_too:
        rows = rows.withColumn("_next", F.lead(payload).over(within))
    joined = rows.join(borders, [*keys, SLICE])
    result = joined.withColumn("_prev", F.coalesce("_prev", "_before"))
    if next_too:
        result = result.withColumn("_next", F.coalesce("_next", "_after"))
    return _restored(result.drop("_before", "_after"), names)


def with_running_count(
    df: DataFrame, keys: list[str], order: list[str], flag: Column, slice_of: Column
) -> DataFrame:
    """Add ``_before``: flagged rows of the key strictly before this one, and ``_all``: flagged rows of the key."""
    sliced = _sliced(df.withColumn("_flag", flag.cast("bigint")), keys, slice_of)
    names, keys = keys, [*keys, NULLS]
    totals = sliced.groupBy(*keys, SLICE).agg(F.sum("_flag").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_all"),
    )
    within = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = sliced.withColumn("_run", F.coalesce(F.sum("_flag").over(within), F.lit(0)))
    counted = rows.join(offsets, [*keys, SLICE]).withColumn("_before", F.col("_run") + F.col("_offset"))
    return _restored(counted.drop("_run", "_offset", "_flag"), names)
