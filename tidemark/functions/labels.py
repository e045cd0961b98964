"""Label sets: canonical order, series identity and map edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tidemark.schemas import DEFAULT_NAMING, Naming

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case ASCII letters only, so the order of other bytes does not change."""
    return F.translate(c, UPPER, LOWER)


def entries(name: Column, labels: Column, naming: Naming = DEFAULT_NAMING) -> Column:
    """Label list with the metric name as its own entry, in canonical order."""
    first = F.array(F.struct(F.lit(naming.name_label).alias("name"), name.alias("value")))
    rest = F.transform(F.map_entries(labels), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return sort_labels(F.concat(first, rest), naming)


def sort_labels(items: Column, naming: Naming = DEFAULT_NAMING) -> Column:
    """Metric name first, then case-insensitive byte order of the label names.

    The sort key is a struct, so the array sorts natively instead of calling a
    comparator per pair.
    """
    keyed = F.transform(
        items,
        lambda e: F.struct(
            (e["name"] != F.lit(naming.name_label)).alias("after_name"),
            ascii_lower(e["name"]).alias("folded"),
            e["name"].alias("name"),
            e["value"].alias("value"),
        ),
    )
    return F.transform(
        F.sort_array(keyed), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))
    )


def series_id(items: Column) -> Column:
    """64-bit xxHash (seed 0) of all names and values in list order, as a signed long."""
    text = F.array_join(F.transform(items, lambda e: F.concat(e["name"], e["value"])), "")
    return xxhash64_seed0(text)


def xxhash64_seed0(text: Column) -> Column:
    """xxHash64 of UTF-8 bytes with seed 0.

    Spark's own function fixes the seed at 42. The same JVM expression takes any
    seed, so the hash stays in generated code; sessions without a local JVM use
    an Arrow function instead.
    """
    jc = getattr(text, "_jc", None)
    if jc is None:
        return _arrow_xxhash64()(text)
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = SparkSession.getActiveSession()._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    children = jvm.PythonUtils.toSeq([bridge.expression(jc)])
    hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(children, 0)
    return ClassicColumn(bridge.column(hashed))


def _arrow_xxhash64():
    @pandas_udf(T.LongType())
    def hashed(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda v: int.from_bytes(xxhash.xxh64_digest(v.encode()), "big", signed=True))

    return hashed


def put_labels(labels: Column, added: Column) -> Column:
    """Labels with the entries of ``added`` set, replacing labels of the same name."""
    return F.map_concat(F.map_filter(labels, lambda k, v: ~F.map_contains_key(added, k)), added)


def literal_map(values: dict[str, str]) -> Column:
    """Constant string map."""
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])


def label_text(labels: Column) -> Column:
    """Labels as sorted ``name=value;`` text, for display and comparison."""
    pairs = F.transform(
        F.map_entries(labels),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null")), F.lit(";")),
    )
    return F.array_join(F.sort_array(pairs), "")


def any_regex(c: Column, patterns: list[str]) -> Column:
    """True when any pattern matches somewhere in the text; one regex pass for all patterns."""
    if not patterns:
        return F.lit(False)
    return c.rlike("|".join(f"(?:{p})" for p in patterns))
