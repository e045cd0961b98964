"""Pending windows of rollup rules over a ledger table.

``rules``: rule, interval_s, delay_s, last_end (null before the first run).
``ledger``: rule, window_start, state, … with one row per tracked window.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.timebin import MICROS, bin_micros
from tidemark.session import spread

# Fixed value: the most backfill windows of a request in flight, unless told otherwise.
MAX_IN_FLIGHT = 20


def _windows_from(start_us: Column, interval_us: Column, first: Column, count: Column) -> Column:
    """Starts of windows ``first … first + count - 1`` counted from ``start_us``."""
    indexes = F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(indexes, lambda k: start_us + k * interval_us)


def _untracked(rules: DataFrame, ledger: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Complete windows without a ledger row, and the ledger's own: rule, interval_s, _start in microseconds."""
    interval_us = F.col("interval_s").cast("bigint") * F.lit(MICROS)
    effective = F.unix_micros(F.lit(now)) - F.coalesce(F.col("delay_s"), F.lit(0)).cast("bigint") * F.lit(MICROS)
    first_end = bin_micros(effective, F.col("interval_s").cast("bigint"), origin="year-one")
    last_end = F.unix_micros("last_end")
    first_run = F.col("last_end").isNull()
    start = F.when(first_run, first_end - interval_us).otherwise(last_end)
    elapsed = F.call_function("div", F.greatest(effective - last_end - 1, F.lit(0).cast("bigint")), interval_us)
    count = F.when(first_run, F.lit(1).cast("bigint")).otherwise(elapsed)
    windows = F.explode(_windows_from(start, interval_us, F.lit(0).cast("bigint"), count))
    # Few bytes of rules make many windows, and windows take few bytes in a shuffle: without spreading both, few tasks would make and sort them all.
    generated = spread(spread(rules, "rule").select("rule", "interval_s", windows.alias("_start")), "rule", "_start")
    tracked = ledger.join(rules.select("rule"), "rule", "left_semi").select(
        "rule", F.unix_micros("window_start").alias("_start")
    ).distinct()
    return generated.join(tracked, ["rule", "_start"], "left_anti"), tracked


def _as_windows(df: DataFrame) -> DataFrame:
    end = F.col("_start") + F.col("interval_s").cast("bigint") * F.lit(MICROS)
    return df.select("rule", F.timestamp_micros("_start").alias("window_start"), F.timestamp_micros(end).alias("window_end"))


def missing_windows(rules: DataFrame, ledger: DataFrame, now: datetime) -> DataFrame:
    """Complete windows that are not tracked yet: ``rule, window_start, window_end``.

    A rule that never ran gets the last full interval before ``now - delay``.
    Others get every window after their last end that closed before ``now - delay``,
    however many they are.
    """
    return _as_windows(_untracked(rules, ledger, now)[0])


def newest_windows(rules: DataFrame, ledger: DataFrame, now: datetime, cap: int) -> tuple[DataFrame, DataFrame]:
    """Missing windows among the newest ``cap`` of a rule, tracked ones included, and those that the cap leaves out."""
    new, tracked = _untracked(rules, ledger, now)
    every = new.withColumn("_new", F.lit(True)).unionByName(tracked.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    newest = Window.partitionBy("rule").orderBy(F.desc("_start"))
    ranked = spread(every, "rule").withColumn("_rank", F.row_number().over(newest)).filter("_new")
    return _as_windows(ranked.filter(F.col("_rank") <= cap)), _as_windows(ranked.filter(F.col("_rank") > cap))


def request_checks() -> dict[str, Column]:
    """What may be wrong with a backfill request joined with its rule, by name; the first that holds is reported."""
    interval = F.col("interval_s").cast("bigint") * F.lit(MICROS)
    length = F.unix_micros("end") - F.unix_micros("start")
    open_ended = F.col("start").isNull() | F.col("end").isNull()
    return {
        "no request id": F.coalesce("request_id", F.lit("")) == "",
        "rule has no interval": F.coalesce("interval_s", F.lit(0)) <= 0,
        "range is open": open_ended,
        "range is empty or reversed": length <= 0,
        "range is not a whole number of intervals": F.pmod(length, F.when(interval > 0, interval)) != 0,
    }


def request_error() -> Column:
    """Name of the first failed check of a backfill request, null when valid."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in request_checks().items()])


def backfill_windows(
    rules: DataFrame, ledger: DataFrame, requests: DataFrame, most: int = MAX_IN_FLIGHT
) -> tuple[DataFrame, DataFrame]:
    """Next windows of backfill requests, and the requests that are not valid.

    ``requests``: rule, request_id, start, end, max_in_flight. ``ledger`` rows of
    the same request with state ``running`` use up its budget (at most ``most``);
    windows with any state other than ``retry`` are not issued again. Windows are
    contiguous from the start of the range and never overlap. Only windows from the
    first unknown one on are generated, as many as the budget and the known ones
    after it can take.
    """
    asked = requests.join(rules.select("rule", "interval_s"), "rule").withColumn("error", request_error())
    errors = asked.filter(F.col("error").isNotNull()).select("rule", "request_id", "error")
    interval = F.col("interval_s").cast("bigint") * F.lit(MICROS)
    budget = F.least(F.greatest(F.coalesce("max_in_flight", F.lit(1)), F.lit(1)), F.lit(most))
    valid = asked.filter(F.col("error").isNull()).select(
        "rule", "request_id", F.unix_micros("start").alias("_first"), interval.alias("_interval"), budget.alias("_budget"),
        F.call_function("div", F.unix_micros("end") - F.unix_micros("start"), interval).alias("_count"),
    )
    same = ["rule", "request_id"]
    known = ledger.filter(F.col("state") != "retry").select(*same, F.unix_micros("window_start").alias("_start")).distinct()
    number = F.call_function("div", F.col("_start") - F.col("_first"), F.col("_interval"))
    within = known.join(valid.select(*same, "_first", "_interval", "_count"), same).withColumn("_k", number).filter("_k >= 0 AND _k < _count")
    in_order = Window.partitionBy(*same).orderBy("_k")
    reached = within.withColumn("_nth", F.row_number().over(in_order) - 1).groupBy(*same).agg(
        F.count_if(F.col("_k") == F.col("_nth")).alias("_done"), F.count("*").alias("_known")
    )
    running = ledger.filter(F.col("state") == "running").groupBy(*same).agg(F.count("*").alias("_running"))
    counted = valid.join(reached, same, "left").join(running, same, "left").fillna(0, ["_done", "_known", "_running"])
    stop = F.least(F.col("_count"), F.col("_known") + F.col("_budget"))
    listed = counted.withColumn("_start", F.explode(_windows_from(F.col("_first"), F.col("_interval"), F.col("_done"), stop - F.col("_done"))))
    open_windows = listed.join(known, [*same, "_start"], "left_anti")
    issued = open_windows.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("_start"))).filter(
        F.col("_n") <= F.col("_budget") - F.col("_running")
    )
    windows = issued.select(
        *same, F.timestamp_micros("_start").alias("window_start"), F.timestamp_micros(F.col("_start") + F.col("_interval")).alias("window_end")
    )
    return windows, errors
