"""Container log files: format detection and line fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.once import compute_once
from tidemark.functions.timebin import rfc3339_to_nanos

DOCKER_LINE = "struct<log:string,stream:string,time:string,_corrupt:string>"


def _parsed(df: DataFrame, now_ns: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of ``…, line, _docker`` with their fields; a CRI line is ``<time> <stream> <tag> <message>``."""
    line, is_docker = F.col("line"), F.col("_docker")
    doc = F.from_json(F.when(is_docker, line), DOCKER_LINE, {"columnNameOfCorruptRecord": "_corrupt"})
    split_up = compute_once(df, _doc=doc, _part=F.when(~is_docker, F.split(line, " ", 4)))
    part = [F.get("_part", F.lit(i)) for i in range(4)]
    log, doc = F.coalesce("_doc.log", F.lit("")), F.col("_doc")
    fields = compute_once(
        split_up,
        is_partial=F.when(is_docker, ~log.endswith("\n")).otherwise(part[2] == "P"),
        _time=rfc3339_to_nanos(F.when(is_docker, F.coalesce(doc["time"], F.lit(""))).otherwise(part[0])),
    )
    docker_ok = is_docker & doc["_corrupt"].isNull() & F.rtrim(line).endswith("}")
    # The time of a partial line is never used, so only complete lines must have one.
    cri_ok = ~is_docker & (F.size("_part") == 4) & (F.col("is_partial") | F.col("_time").isNotNull())
    ok = F.coalesce(docker_ok | cri_ok, F.lit(False))
    carried = [c for c in df.columns if c not in ("line", "_docker")]
    rejects = fields.filter(~ok).select(
        *carried, "line", F.when(is_docker, F.lit("bad docker line")).otherwise(F.lit("bad cri line")).alias("reason")
    )
    rows = fields.filter(ok).select(
        *carried,
        F.when(is_docker, F.coalesce("_time", now_ns)).otherwise(F.col("_time")).alias("time_ns"),
        F.when(is_docker, F.coalesce(doc["stream"], F.lit(""))).otherwise(part[1]).alias("stream"),
        "is_partial",
        F.when(is_docker & ~F.col("is_partial"), log.substr(F.lit(1), F.length(log) - 1))
        .when(is_docker, log)
        .otherwise(part[3])
        .alias("message"),
    )
    return rows, rejects


def parse_container_lines(
    df: DataFrame, now_ns: int | Column = 0, detect: str = "file"
) -> tuple[DataFrame, DataFrame]:
    """Time, stream, partial flag and message of ``file, offset, line`` rows, and the bad lines.

    ``detect="file"`` decides the format by the first line of each file: a small
    per-file aggregate joined back, which is broadcast when small and split by
    the adaptive skew join when one file dominates. ``detect="line"`` decides per
    line and needs no shuffle.
    """
    now = now_ns if isinstance(now_ns, Column) else F.lit(now_ns).cast("bigint")
    rows = df.filter(F.length("line") > 0)
    if detect == "line":
        return _parsed(rows.withColumn("_docker", F.col("line").startswith("{")), now)
    # Offset and format in one number, so the aggregate keeps fixed-width state and needs no sort.
    brace = F.when(F.col("line").startswith("{"), 1).otherwise(0)
    formats = rows.groupBy("file").agg((F.min(F.col("offset") * 2 + brace) % 2 == 1).alias("_docker"))
    return _parsed(rows.join(formats, "file"), now)


def plain_lines(df: DataFrame, now_ns: int | Column) -> DataFrame:
    """Whole lines as messages, stamped with the reading time."""
    now = now_ns if isinstance(now_ns, Column) else F.lit(now_ns).cast("bigint")
    return df.withColumns(
        {"time_ns": now, "stream": F.lit(""), "is_partial": F.lit(False), "message": F.col("line")}
    ).drop("line")
