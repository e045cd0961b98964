"""Name normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: longest identifier a destination accepts.
MAX_IDENTIFIER = 1024


def normalize_identifier(c: Column) -> Column:
    """Keep ASCII letters and digits only."""
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9]", ""), 1, MAX_IDENTIFIER)


def metric_table_name(c: Column) -> Column:
    """ProperCase table name of a metric: separators go, the letter after one is raised."""
    words = F.split(c, "[^A-Za-z0-9]")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, MAX_IDENTIFIER)))
    return F.substring(F.array_join(raised, ""), 1, MAX_IDENTIFIER)


def normalize_metric_name(c: Column) -> Column:
    """snake_case metric name; null when nothing is left."""
    # Word boundaries of camelCase names and acronyms.
    split_camel = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    split_acronym = F.regexp_replace(split_camel, "([A-Z])([A-Z][a-z])", "$1_$2")
    plain = F.regexp_replace(F.lower(split_acronym), "[^a-z0-9]+", "_")
    plain = F.btrim(plain, F.lit("_"))
    guarded = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)
    return F.nullif(guarded, F.lit(""))


def metric_name(prefix: Column | None, base: Column | None, column: Column, base_norm: Column | None = None) -> Column:
    """``[prefix_][base_]column`` with every part normalised; null when a given part is unusable.

    Pass ``base_norm`` when the base name is already normalised.
    """
    parts = []
    usable = F.lit(True)
    for part, known in ((prefix, None), (base, base_norm)):
        if part is not None:
            given = F.coalesce(part, F.lit("")) != ""
            norm = normalize_metric_name(part) if known is None else known
            usable = usable & (~given | norm.isNotNull())
            parts.append(norm)
    last = normalize_metric_name(column)
    joined = F.concat_ws("_", *parts, last)
    tidy = F.when(joined.contains("__"), F.regexp_replace(joined, "_+", "_")).otherwise(joined)
    return F.when(usable & last.isNotNull(), F.nullif(F.btrim(tidy, F.lit("_")), F.lit("")))
