"""Kernel and journal records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Kernel priority names, most severe first. Fixed values.
PRIORITIES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
PRIORITY_ALIASES = {"error": "err", "warn": "warning", "": "info"}


def priority_number(name: Column) -> Column:
    """Number of a priority name; unknown and empty names count as info."""
    known = F.lower(F.coalesce(name, F.lit("")))
    for alias, full in PRIORITY_ALIASES.items():
        known = F.when(known == alias, F.lit(full)).otherwise(known)
    position = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), known)
    return F.when(position > 0, position - 1).otherwise(PRIORITIES.index("info")).cast("int")


def route_kernel_records(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Copy each record to every target that wants its priority and has not seen its sequence.

    ``records``: seq, priority (number), time_ns, message. ``targets``: database,
    table, priority (name), processed. A target is expanded to the priorities it
    accepts, at most one row per priority, so the match is an equi-join.
    """
    wanted = targets.select(
        "database",
        "table",
        "processed",
        F.explode(F.sequence(F.lit(0), priority_number(F.col("priority")))).alias("priority"),
    )
    routed = records.join(wanted, "priority").filter((F.col("processed") == 0) | (F.col("seq") > F.col("processed")))
    return routed.drop("processed")


def journal_condition(fields: Column, matches: list[str]) -> Column:
    """Predicate of a journal match list.

    ``FIELD=value`` terms; ``+`` separates alternatives. Inside an alternative
    terms on one field are alternatives and terms on different fields must all
    hold.
    """
    groups: list[dict[str, list[str]]] = [{}]
    for match in matches:
        if match == "+":
            groups.append({})
            continue
        field, sep, value = match.partition("=")
        if not sep or not field:
            raise ValueError(f"invalid journal match: {match!r}")
        groups[-1].setdefault(field, []).append(value)
    conditions = []
    for group in groups:
        if group:
            cond = F.lit(True)
            for field, values in group.items():
                cond = cond & F.coalesce(fields[field].isin(values), F.lit(False))
            conditions.append(cond)
    if not conditions:
        return F.lit(True)
    result = conditions[0]
    for cond in conditions[1:]:
        result = result | cond
    return result


def filter_journal(df: DataFrame, matches: list[str], fields: list[str], column: str = "fields") -> DataFrame:
    """Matching records with the chosen journal fields as ``resource``."""
    keep = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
    return df.filter(journal_condition(F.col(column), matches)).withColumn(
        "resource", F.map_filter(F.col(column), lambda k, _: F.array_contains(keep, k))
    )
