"""Gating, execution and health of rollup rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from hashlib import sha1
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.labels import literal_map
from tidemark.functions.timebin import MICROS, in_window
from tidemark.session import delete_path, path_exists, stored

# Fixed value: seconds between status polls, three of which make a run stale.
POLL_SECONDS = 600


def select_rules(rules: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Add ``selected`` and ``reason`` to ``rule, criteria (map of lists), expression`` rows.

    The criteria map passes when any key holds any listed value, ignoring case.
    The expression is a Spark SQL predicate over the labels as columns. Both must
    pass when both are given; neither means yes. A bad expression never runs.
    """
    lowered = literal_map({k.lower(): v.lower() for k, v in labels.items()})
    entries = F.map_entries(F.coalesce("criteria", F.create_map().cast("map<string,array<string>>")))
    by_map = (F.size(entries) == 0) | F.exists(
        entries,
        lambda e: F.exists(e["value"], lambda v: F.coalesce(F.lower(v) == lowered[F.lower(e["key"])], F.lit(False))),
    )
    expression = F.trim(F.coalesce("expression", F.lit("")))
    verdicts = _expression_verdicts(rules, expression, labels)
    passed = F.when(expression == "", F.lit("true")).otherwise(verdicts[expression])
    return rules.withColumns(
        {
            "selected": by_map & (passed == "true"),
            "reason": F.when(passed == "error", F.lit("criteria expression error"))
            .when(~by_map & (passed == "true"), F.lit("criteria map did not match"))
            .when(by_map & (passed != "true"), F.lit("criteria expression evaluated to false"))
            .when(~by_map, F.lit("criteria map did not match and expression false"))
            .otherwise(F.lit("criteria matched")),
        }
    )


def _expression_verdicts(rules: DataFrame, expression: Column, labels: dict[str, str]) -> Column:
    """Verdict on each rule's expression (true, false or error), looked up by its text.

    Texts are analysed one by one, without a job; those that are predicates are
    evaluated together in one job over one row. A text that fails at run time is
    found by halving the set it failed in.
    """
    spark = rules.sparkSession
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in labels.items()])
    texts = rules.select(expression.alias("e")).filter("e != ''").distinct().toLocalIterator()
    verdicts, sound = {}, []
    for (text,) in texts:
        try:
            kind = row.select(F.expr(text).alias("v")).schema["v"].dataType.simpleString()
            verdicts[text] = "error"
            if kind == "boolean":
                sound.append(text)
        except Exception:  # a bad expression is an outcome, not a failure
            verdicts[text] = "error"
    waiting = [sound]
    while waiting:
        some = waiting.pop()
        if not some:
            continue
        try:
            values = row.select(F.array(*[F.expr(t) for t in some])).first()[0]
            verdicts |= {t: "true" if v else "false" for t, v in zip(some, values)}
        except Exception:
            if len(some) > 1:
                waiting += [some[: len(some) // 2], some[len(some) // 2 :]]
    return literal_map(verdicts)


WINDOW_COLUMNS = ("window_start", "window_end")


def _length_class(start: Column, end: Column) -> Column:
    """Smallest power of two, in microseconds, that is no shorter than the window: its exponent."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1).cast("bigint")))).cast("int")


def assign_windows(df: DataFrame, windows: DataFrame, ts: str = "ts", tags: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the ``window_start, window_end`` of each window that holds them.

    ``tags`` are further string columns of ``windows`` to carry along, such as the rule.
    Of the windows only the outer bounds and the length classes present (at most 64)
    come to the driver; the bounds reach partition pruning and the file filters.
    Windows are grouped by length class. Within a class a window overlaps at most two
    bins as long as the class, is listed under those, and rows meet it by (class, bin):
    an equi-join in which a row sees only windows about as long as its bin.
    """
    listed = windows.select(*tags, *WINDOW_COLUMNS).distinct()
    start, end = F.unix_micros("window_start"), F.unix_micros("window_end")
    facts = listed.agg(F.min(start).alias("lo"), F.max(end).alias("hi"), F.collect_set(_length_class(start, end)).alias("classes")).first()
    if facts["lo"] is None:
        return df.limit(0).withColumns({t: F.lit(None).cast("string") for t in tags} | {c: F.lit(None).cast("timestamp") for c in WINDOW_COLUMNS})
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_class"))
    first, last = (F.call_function("div", x - F.pmod(x, width), width) for x in (start, end - 1))
    bins = listed.withColumn("_class", _length_class(start, end)).withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))
    inside = df.filter(in_window(F.col(ts), F.timestamp_micros(F.lit(facts["lo"])), F.timestamp_micros(F.lit(facts["hi"]))))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    placed = inside.withColumn("_class", F.explode(F.array(*[F.lit(c) for c in sorted(facts["classes"])])))
    placed = placed.withColumn("_bin", F.call_function("div", at - F.pmod(at, width), width))
    joined = placed.join(bins, ["_class", "_bin"])
    return joined.filter((F.col(ts) >= F.col("window_start")) & (F.col(ts) < F.col("window_end"))).drop("_class", "_bin")


def rollup_windows(
    df: DataFrame, windows: DataFrame, body: Callable[[DataFrame], DataFrame], ts: str = "ts"
) -> DataFrame:
    """Rollup rows of many windows from one scan.

    ``body`` receives rows carrying ``window_start, window_end`` and must keep
    ``window_start`` among its grouping columns.
    """
    out = body(assign_windows(df, windows, ts))
    if "window_start" not in out.columns:
        raise ValueError("the rollup body must keep window_start")
    return out


def _record(windows: DataFrame, ledger: str, rule: str, state: str) -> None:
    """Append a ledger row per window; ``attempts`` counts the runs of a window, this one included.

    A rule has a folder of its own in the ledger, so rules that run at once do not meet in one write.
    """
    spark, folder = windows.sparkSession, f"{ledger}/writer=r{sha1(rule.encode()).hexdigest()[:16]}"
    rows = windows.select(F.lit(rule).alias("rule"), *WINDOW_COLUMNS, F.lit(state).alias("state"), F.current_timestamp().alias("updated_at"))
    attempts = F.lit(1).cast("bigint")
    if path_exists(spark, folder):
        begun = spark.read.parquet(folder).filter((F.col("rule") == rule) & (F.col("state") == "running"))
        tries = begun.groupBy("window_start").agg(F.count("*").alias("_tries"))
        rows = rows.join(tries, "window_start", "left")
        attempts = F.coalesce("_tries", F.lit(0)) + F.lit(1 if state == "running" else 0)
    rows.select("rule", *WINDOW_COLUMNS, "state", attempts.alias("attempts"), "updated_at").write.mode("append").parquet(folder)


def replace_windows(out: DataFrame, windows: DataFrame, target: str, rule: str) -> None:
    """Make the rows of ``out`` the only rows of these windows of a rule in ``target``.

    The target is partitioned by (rule, window_start): rules that share it never touch
    each other's rows. Windows without rows are cleared too.
    """
    spark = out.sparkSession
    # One task writes a window's folder; a very large window is split again.
    rows = out.withColumn("rule", F.lit(rule)).hint("rebalance", "window_start")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rule", "window_start").parquet(target)
    if not path_exists(spark, target):
        return
    stored_rows = spark.read.parquet(target)
    if "rule" not in stored_rows.columns:  # nothing was ever written
        return
    old = stored_rows.filter(F.col("rule") == rule).select(F.col("window_start").cast("timestamp").alias("window_start"), F.col("_metadata.file_path").alias("file")).distinct()
    filled = out.select("window_start").distinct()
    empty = windows.select("window_start").distinct().join(filled, "window_start", "left_anti")
    folders = old.join(empty, "window_start", "left_semi").select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct()
    for row in folders.toLocalIterator():
        delete_path(spark, row["folder"])


def run_rollup(
    df: DataFrame,
    windows: DataFrame,
    body: Callable[[DataFrame], DataFrame],
    target: str,
    ledger: str,
    rule: str,
    ts: str = "ts",
) -> None:
    """Compute the windows in one job, replace them in ``target`` and record them in ``ledger``.

    The list of windows is fixed first; the ledger says ``running`` for all of them, then
    ``completed`` or ``failed``. A rerun replaces the rule's own output of these windows.
    """
    listed = stored(windows.select(*WINDOW_COLUMNS).distinct(), "windows")
    _record(listed, ledger, rule, "running")
    try:
        replace_windows(stored(rollup_windows(df, listed, body, ts), "rollup-rows"), listed, target, rule)
    except Exception:
        _record(listed, ledger, rule, "failed")
        raise
    _record(listed, ledger, rule, "completed")


#: Quoted text, quoted names and comments, in which no parameter is bound, or one of the two window parameters.
BOUNDS = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|:(_startTime|_endTime)\b""", re.S)
BOUND_COLUMNS = {"_startTime": "_window.window_start", "_endTime": "_window.window_end"}


def rollup_windows_sql(spark: SparkSession, body: str, windows: DataFrame, labels: dict[str, str], reads: dict[str, str]) -> DataFrame:
    """Rollup rows of a Spark SQL body for many windows in one plan, with their ``window_start``.

    The windows are the outer side of a lateral join and ``:_startTime`` and ``:_endTime``
    columns of theirs; ``:_<label>`` are bound as parameters. ``reads`` names the tables or
    views (without a catalog) that the body bounds by the window, with their time column:
    each is scanned once, its rows meet the windows as in :func:`assign_windows`, and
    inside the body the name stands for the rows of the body's window. A body gives
    the same rows as if it ran for each window alone, windows without rows included.
    """
    key = uuid4().hex
    listed = windows.select(*WINDOW_COLUMNS).distinct()
    listed.createOrReplaceTempView(f"windows_{key}")
    views = [f"windows_{key}"]
    scoped = []
    for number, (name, ts) in enumerate(reads.items()):
        rows = spark.table(name)
        placed = assign_windows(rows, listed, ts).withColumnsRenamed({"window_start": "_ws", "window_end": "_we"})
        placed.createOrReplaceTempView(f"rows_{key}_{number}")
        views.append(f"rows_{key}_{number}")
        columns = ", ".join(f"`{c}`" for c in rows.columns)
        scoped.append(f"`{name}` AS (SELECT {columns} FROM rows_{key}_{number} WHERE _ws = _window.window_start AND _we = _window.window_end)")
    bound = BOUNDS.sub(lambda m: BOUND_COLUMNS[m[1]] if m[1] else m[0], body)
    scope = f"WITH {', '.join(scoped)} " if scoped else ""
    text = f"SELECT _window.window_start AS _start, _body.* FROM windows_{key} _window, LATERAL ({scope}SELECT * FROM (\n{bound}\n)) _body"
    try:
        out = spark.sql(text, args={f"_{k}": v for k, v in labels.items()})
        return out.withColumn("window_start", F.col("_start")).drop("_start")
    finally:
        for view in views:
            spark.catalog.dropTempView(view)


def run_rollup_sql(
    spark: SparkSession, body: str, windows: DataFrame, labels: dict[str, str], target: str, ledger: str, rule: str, reads: dict[str, str] | None = None
) -> None:
    """Run a Spark SQL body for all windows in one job (:func:`rollup_windows_sql`), replace them and record them."""
    listed = stored(windows.select(*WINDOW_COLUMNS).distinct(), "windows")
    _record(listed, ledger, rule, "running")
    try:
        replace_windows(stored(rollup_windows_sql(spark, body, listed, labels, reads or {}), "rollup-rows"), listed, target, rule)
    except Exception:
        _record(listed, ledger, rule, "failed")
        raise
    _record(listed, ledger, rule, "completed")


def ledger_state(ledger: DataFrame) -> DataFrame:
    """Latest state of each tracked window."""
    row = F.struct("updated_at", (F.col("state") != "running").alias("done"), "state", "attempts", "window_end")
    latest = ledger.groupBy("rule", "window_start").agg(F.max(row).alias("_r"))
    return latest.select("rule", "window_start", "_r.window_end", "_r.state", "_r.attempts")


def last_ends(ledger: DataFrame) -> DataFrame:
    """Latest completed window end per rule; it only moves forward."""
    return ledger.filter(F.col("state") == "completed").groupBy("rule").agg(F.max("window_end").alias("last_end"))


def rule_health(rules: DataFrame, ledger: DataFrame, now: datetime) -> DataFrame:
    """Counts and health per rule.

    ``rules``: rule, interval_s, delay_s, last_end, managed, selected.
    ``ledger``: rule, window_start, state (``running``, ``backlog``, ``completed``,
    ``failed``), attempts. ``reason`` is the first problem found, null when working.
    """
    state = F.col("state")
    counted = ledger.groupBy("rule").agg(
        F.count_if(state != "backlog").alias("submitted"),
        F.count_if(state == "completed").alias("completed"),
        F.count_if(state == "failed").alias("failed"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retried"),
        F.count_if(state == "running").alias("in_flight"),
        F.count_if(state == "backlog").alias("backlog"),
        F.min(F.when(state == "running", F.col("window_start"))).alias("_oldest"),
    )
    joined = rules.join(counted, "rule", "left").fillna(
        0, ["submitted", "completed", "failed", "retried", "in_flight", "backlog"]
    )
    interval = F.when(F.coalesce("interval_s", F.lit(0)) > 0, F.col("interval_s")).otherwise(60).cast("bigint") * F.lit(MICROS)
    now_us = F.unix_micros(F.lit(now))
    effective = now_us - F.coalesce("delay_s", F.lit(0)).cast("bigint") * F.lit(MICROS)
    elapsed = effective - F.unix_micros("last_end")
    due = F.when(F.col("last_end").isNull(), F.lit(True)).otherwise(elapsed >= interval)
    just_run = F.coalesce(elapsed < F.call_function("div", interval, F.lit(2).cast("bigint")), F.lit(False))
    stale = F.coalesce(
        now_us - F.unix_micros("_oldest") > F.greatest(interval, F.lit(3 * POLL_SECONDS * MICROS)), F.lit(False)
    )
    complete = F.call_function("div", elapsed, interval)
    gap = F.coalesce((elapsed > interval) & (complete - F.col("backlog") > 1), F.lit(False))
    reason = (
        F.when(~F.col("managed"), F.lit("unmanaged_database"))
        .when(~F.col("selected"), F.lit("criteria_mismatch"))
        .when(due & ~just_run, F.lit("submission_missed"))
        .when(stale, F.lit("async_stale"))
        .when(gap, F.lit("backlog_gap"))
    )
    return joined.select(
        "rule",
        "submitted",
        "completed",
        "failed",
        "retried",
        "in_flight",
        "backlog",
        due.alias("due"),
        stale.alias("stale"),
        gap.alias("gap"),
        reason.isNull().alias("working"),
        reason.alias("reason"),
    )


def backfill_progress(requests: DataFrame, rules: DataFrame, ledger: DataFrame) -> DataFrame:
    """Windows submitted, completed and retried per backfill request, and its phase."""
    total = F.call_function(
        "div",
        F.unix_micros("end") - F.unix_micros("start"),
        F.col("interval_s").cast("bigint") * F.lit(MICROS),
    )
    state = F.col("state")
    counted = ledger.groupBy("rule", "request_id").agg(
        F.count_if(state != "retry").alias("submitted"),
        F.count_if(state == "completed").alias("completed"),
        F.count_if(state == "failed").alias("failed"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retried"),
    )
    joined = (
        requests.join(rules.select("rule", "interval_s"), "rule")
        .join(counted, ["rule", "request_id"], "left")
        .fillna(0, ["submitted", "completed", "failed", "retried"])
    )
    phase = (
        F.when(F.col("failed") > 0, F.lit("Failed"))
        .when(F.col("completed") >= total, F.lit("Completed"))
        .when(F.col("submitted") > 0, F.lit("Running"))
        .otherwise(F.lit("Pending"))
    )
    return joined.select("rule", "request_id", total.alias("windows"), "submitted", "completed", "retried", phase.alias("phase"))


@dataclass(frozen=True)
class Totals:
    """A rollup body as data: SQL aggregates by output name, per window and ``by`` columns, over rows that meet ``where``.

    Alone it is a body like any other; several over one source share a scan.
    """

    aggs: dict[str, str]
    by: tuple[str, ...] = ()
    where: str | None = None

    def __call__(self, rows: DataFrame) -> DataFrame:
        kept = rows.filter(self.where) if self.where else rows
        return kept.groupBy("window_start", *self.by).agg(*[F.expr(text).alias(name) for name, text in self.aggs.items()])


@dataclass(frozen=True)
class RollupRule:
    """A rollup rule run by :func:`run_rules`.

    ``body`` is a :class:`Totals`, a function of rows with their windows, or SQL with
    parameters, which bounds the tables in ``reads`` (name and time column) by its window.
    """

    name: str
    source: str
    body: Callable[[DataFrame], DataFrame] | str
    target: str
    ts: str = "ts"
    labels: dict[str, str] = field(default_factory=dict)
    reads: dict[str, str] = field(default_factory=dict)


def shared_rollup(df: DataFrame, windows: DataFrame, bodies: dict[str, Totals], ts: str = "ts") -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """Rollup rows of many rules over one source from one scan, and a function that picks a rule's rows out of them.

    ``windows`` has ``rule, window_start, window_end``. The outer bounds of all windows and
    the union of all conditions reach the scan. A row meets the windows of every rule that
    wants it and is combined under (rule, window, by columns) before the one shuffle; a
    column that a rule does not group by is null in its groups, and an aggregate that
    several rules ask for is computed once.
    """
    dims = sorted({c for b in bodies.values() for c in b.by})
    texts = sorted({t for b in bodies.values() for t in b.aggs.values()})
    conditions = [F.coalesce(F.expr(b.where).cast("boolean"), F.lit(False)) if b.where else F.lit(True) for b in bodies.values()]
    wanted = reduce(lambda a, b: a | b, conditions)
    tagged = windows.filter(F.col("rule").isin(list(bodies))).withColumnRenamed("rule", "_rule")
    placed = assign_windows(df.filter(wanted), tagged, ts, ("_rule",))
    placed = placed.filter(reduce(lambda a, b: a | b, [(F.col("_rule") == n) & c for n, c in zip(bodies, conditions)]))
    keys = [F.when(F.col("_rule").isin([n for n, b in bodies.items() if c in b.by]), F.col(c)).alias(f"_by{i}") for i, c in enumerate(dims)]
    out = placed.groupBy("_rule", "window_start", *keys).agg(*[F.expr(t).alias(f"_agg{i}") for i, t in enumerate(texts)])

    def pick(rows: DataFrame, name: str) -> DataFrame:
        body = bodies[name]
        columns = [F.col(f"_by{dims.index(c)}").alias(c) for c in body.by] + [F.col(f"_agg{texts.index(t)}").alias(n) for n, t in body.aggs.items()]
        return rows.filter(F.col("_rule") == name).select("window_start", *columns)

    return out, pick


def run_rules(
    rules: list[RollupRule], sources: dict[str, DataFrame], windows: DataFrame, ledger: str, at_once: int = 4
) -> dict[str, str | None]:
    """Run many rules, ``at_once`` side by side; the result maps each rule with windows to its error or None.

    ``windows`` has ``rule, window_start, window_end`` rows. Rules whose body is a
    :class:`Totals` and whose source and time column are the same are computed in one scan
    of it (:func:`shared_rollup`); if that job fails, each of them runs alone, so that
    whatever goes wrong in a rule is its own outcome. Every other rule reads its source
    within the bounds of its own windows.
    """
    listed = stored(windows.select("rule", *WINDOW_COLUMNS), "rule-windows")
    waiting = {r["rule"] for r in listed.select("rule").distinct().toLocalIterator()}
    due = [r for r in rules if r.name in waiting]
    own = {r.name: listed.filter(F.col("rule") == r.name) for r in due}

    together: dict[tuple[str, str], list[RollupRule]] = {}
    for rule in due:
        if isinstance(rule.body, Totals):
            together.setdefault((rule.source, rule.ts), []).append(rule)
    ready: dict[str, DataFrame] = {}
    for (source, ts), members in together.items():
        if len(members) < 2:
            continue
        for rule in members:
            _record(own[rule.name], ledger, rule.name, "running")
        try:
            out, pick = shared_rollup(sources[source], listed, {r.name: r.body for r in members}, ts)
            rows = stored(out, "shared-rollup")
            ready |= {r.name: pick(rows, r.name) for r in members}
        except Exception:  # run one by one below; the failed run counts as an attempt
            for rule in members:
                _record(own[rule.name], ledger, rule.name, "failed")

    def finish(rule: RollupRule) -> None:
        try:
            replace_windows(ready[rule.name], own[rule.name], rule.target, rule.name)
        except Exception:
            _record(own[rule.name], ledger, rule.name, "failed")
            raise
        _record(own[rule.name], ledger, rule.name, "completed")

    def run(rule: RollupRule) -> str | None:
        try:
            if rule.name in ready:
                finish(rule)
            elif isinstance(rule.body, str):
                run_rollup_sql(listed.sparkSession, rule.body, own[rule.name], rule.labels, rule.target, ledger, rule.name, rule.reads)
            else:
                run_rollup(sources[rule.source], own[rule.name], rule.body, rule.target, ledger, rule.name, rule.ts)
        except Exception as error:
            return f"{type(error).__name__}: {error}"
        return None

    targets: dict[str, list[RollupRule]] = {}
    for rule in due:  # dynamic overwrites of one folder take turns
        targets.setdefault(rule.target, []).append(rule)
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        groups = pool.map(lambda members: [(r.name, run(r)) for r in members], targets.values())
        return dict(pair for group in groups for pair in group)
