"""Prometheus exposition text and remote-write shaped batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.labels import series_id
from tidemark.functions.once import compute_once
from tidemark.schemas import DEFAULT_NAMING, Naming

# Shape of one sample line: name, optional label block, value, optional time.
LABEL_SHAPE = r'[^=}][^=]*="?[^"\\]*+(?:\\.[^"\\]*+)*+",?'
LABEL = r'([^=}][^=]*)="?([^"\\]*+(?:\\.[^"\\]*+)*+)",?'
LINE = (
    r"(?s)^[ \t]*([^{ \t]*)[ \t]*(?:\{((?:" + LABEL_SHAPE + r")*)\})?"
    r"[ \t]*([^ \t]+)(?:[ \t]+([^ \t]+))?.*$"
)
# Parts of a matched line, the label block last because only it may hold any character.
PARTS = "$1\x00$3\x00$4\x00$2"
NUMBER = r"(?i)^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?inf(inity)?|[+-]?nan)$"


def _unescape(c: Column) -> Column:
    pieces = F.transform(
        F.split(c, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")),
    )
    return F.when(c.contains("\\"), F.array_join(pieces, "\\")).otherwise(c)


def parse_prometheus_lines(
    df: DataFrame, scrape_ts: datetime | Column, line: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Sample lines to ``name, labels, value, ts`` rows, and the lines that are not samples.

    Comments and blank lines are skipped. A missing or zero time becomes the
    scrape time.
    """
    scrape = scrape_ts if isinstance(scrape_ts, Column) else F.lit(scrape_ts)
    text = F.col(line)
    lines = df.filter(~text.rlike(r"^[ \t]*(#|$)"))
    # One match per line: the groups are written behind each other and split again.
    split_up = compute_once(lines, _part=F.split(F.regexp_replace(text, LINE, PARTS), "\x00", 4))
    value_text, time_text, block = (F.get("_part", F.lit(i)) for i in (1, 2, 3))
    value = F.when(value_text.rlike(NUMBER), F.regexp_replace(value_text, "(?i)^[+-]nan$", "NaN").try_cast("double"))
    millis = F.when(time_text == "", F.lit(0)).when(time_text.rlike("^-?[0-9]+$"), time_text.try_cast("bigint"))
    parsed = compute_once(split_up, sample_value=value, millis=millis)
    ok = F.col("sample_value").isNotNull() & F.col("millis").isNotNull()
    keys = F.regexp_extract_all(block, F.lit(LABEL), F.lit(1))
    values = F.transform(F.regexp_extract_all(block, F.lit(LABEL), F.lit(2)), _unescape)
    carried = [c for c in df.columns if c != line]
    samples = parsed.filter(ok).select(
        *carried,
        F.get("_part", F.lit(0)).alias("name"),
        F.map_from_arrays(keys, values).alias("labels"),
        F.col("sample_value").alias("value"),
        F.when(F.col("millis") == 0, scrape).otherwise(F.timestamp_millis("millis")).alias("ts"),
    )
    rejects = parsed.filter(~ok).select(*carried, text.alias("line"), F.lit("malformed sample line").alias("reason"))
    return samples, rejects


def read_prometheus_text(
    spark: SparkSession, path: str | list[str], scrape_ts: datetime | Column
) -> tuple[DataFrame, DataFrame]:
    """Exposition text files to samples and rejected lines."""
    return parse_prometheus_lines(spark.read.text(path), scrape_ts)


def explode_series(df: DataFrame, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """One row per sample of ``labels`` (list of name, value) and ``samples`` (list of ms time, value).

    The series id is taken over the labels in their given order.
    """
    carried = [c for c in df.columns if c not in ("labels", "samples")]
    as_map = F.map_from_entries(F.col("labels"))
    per_series = df.select(
        *carried,
        as_map[naming.name_label].alias("name"),
        F.map_filter(as_map, lambda k, _: k != F.lit(naming.name_label)).alias("labels"),
        series_id(F.col("labels")).alias("series_id"),
        F.explode("samples").alias("sample"),
    )
    return per_series.select(
        *carried,
        "name",
        "labels",
        "series_id",
        F.timestamp_millis(F.col("sample.timestamp")).alias("ts"),
        F.col("sample.value").alias("value"),
    )
