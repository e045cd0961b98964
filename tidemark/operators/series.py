"""Functions over counter and gauge series (``SeriesId, Timestamp, Value`` rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.slices import time_slice, with_neighbours

SLICE_SECONDS = 6 * 3600


def _with_change(df: DataFrame, reset: str | None, slice_seconds: int) -> DataFrame:
    """``Value`` replaced by the change since the previous sample; ``_prev_ts`` is that sample's time."""
    clean = df.filter(~F.isnan("Value") | F.col("Value").isNull())
    around = with_neighbours(
        clean,
        ["SeriesId"],
        ["Timestamp"],
        ["Timestamp", "Value"],
        time_slice(F.col("Timestamp"), slice_seconds),
        next_too=reset == "reference",
    )
    value, previous = F.col("Value"), F.col("_prev.Value")
    diff = value - previous
    if reset is None:
        change = diff
    elif reset == "prometheus":
        change = F.when(diff < 0, value).otherwise(diff)
    elif reset == "reference":
        change = F.when(diff < 0, F.col("_next.Value") - value).otherwise(diff)
    else:
        raise ValueError(f"unknown reset rule: {reset!r}")
    changed = around.withColumns(
        {
            "Value": F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(change),
            "_prev_ts": F.col("_prev.Timestamp"),
        }
    )
    return changed.drop("_prev", "_next")


def increase(df: DataFrame, reset: str = "reference", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Increase of each counter sample over the one before it in its series.

    The first sample of a series gives 0. After a drop, ``reset="reference"``
    takes the following sample minus this one (null on the last sample), and
    ``"prometheus"`` counts from zero.
    """
    return _with_change(df, reset, slice_seconds).drop("_prev_ts")


def delta(df: DataFrame, gauge: bool = False, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Same as :func:`increase`; ``gauge=True`` is the plain difference."""
    return _with_change(df, None if gauge else "reference", slice_seconds).drop("_prev_ts")


def rate(df: DataFrame, reset: str = "reference", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Increase per second since the previous sample; rows without a rate are removed."""
    changed = _with_change(df, reset, slice_seconds)
    seconds = (F.unix_micros("Timestamp") - F.unix_micros("_prev_ts")) / F.lit(1e6)
    value = F.when(seconds > 0, F.col("Value") / seconds)
    return (
        changed.withColumn("Value", value)
        .filter(F.col("Value").isNotNull() & ~F.isnan("Value"))
        .drop("_prev_ts")
    )


def counter_totals(df: DataFrame, labels: dict[str, Column], slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Total counted per label set over the rows given."""
    changed = delta(df, slice_seconds=slice_seconds)
    return changed.groupBy(*[c.alias(n) for n, c in labels.items()]).agg(F.sum("Value").alias("total"))


def snapshot_delta(df: DataFrame, keys: list[str], ts: str = "ts", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Change between successive snapshots of cumulative ``evaluations, duration_sum, duration_count``.

    A value below the previous one means a restart and counts from zero. The
    average duration is 0 when nothing was counted.
    """
    names = ["evaluations", "duration_sum", "duration_count"]
    around = with_neighbours(df.select(*keys, ts, *names), keys, [ts], names, time_slice(F.col(ts), slice_seconds), next_too=False)

    def grown(name: str) -> Column:
        before = F.coalesce(F.col("_prev")[name], F.lit(0))
        return F.when(F.col(name) < before, F.col(name)).otherwise(F.col(name) - before)

    changed = around.select(*keys, ts, *[grown(n).alias(n) for n in names])
    return changed.withColumn(
        "average_duration",
        F.when(F.col("duration_count") == 0, F.lit(0.0)).otherwise(F.col("duration_sum") / F.col("duration_count")),
    )
