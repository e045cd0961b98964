"""CSV files whose first line names the columns and their types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.schemas import HEADER_TYPES


def parse_header(line: str) -> list[tuple[str, str]]:
    """Column names and types of a ``Name:type,Name:type`` line."""
    columns = []
    for field in line.strip().split(","):
        name, sep, kind = field.partition(":")
        if not sep or ":" in kind or kind not in HEADER_TYPES:
            raise ValueError(f"invalid schema field: {field!r}")
        columns.append((name, kind))
    return columns


def read_typed_csv(
    spark: SparkSession, path: str, strict: bool = True, multiline: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Typed rows of every file below ``path``.

    Header lines inside the data are dropped. Empty cells become the epoch, zero
    or the empty text. With ``strict`` a bad cell or row width fails the job;
    otherwise the result is ``(rows, rejects)``.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError(f"no header line below {path}")
    header = head[0][0].strip()
    columns = parse_header(header)
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(len(columns))]
    reader = spark.read.options(
        escape='"', quote='"', multiLine=str(multiline).lower(), emptyValue="", nullValue="\u0000", columnPruning="false"
    )
    if strict:
        raw = reader.schema(T.StructType(fields)).csv(path, mode="FAILFAST")
    else:
        fields.append(T.StructField("_corrupt", T.StringType()))
        raw = reader.schema(T.StructType(fields)).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    cells = [F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(len(columns))]
    rows = raw.filter(F.concat_ws(",", *cells) != F.lit(header))

    def converted(cell, kind: str):
        spark_type, default = HEADER_TYPES[kind]
        cast = cell.cast(spark_type) if strict else cell.try_cast(spark_type)
        return F.when(cell == "", F.expr(default)).otherwise(cast)

    typed = [converted(cell, kind).alias(name) for cell, (name, kind) in zip(cells, columns)]
    if strict:
        return rows.select(*typed)
    bad = F.col("_corrupt").isNotNull()
    for cell, (_, kind) in zip(cells, columns):
        bad = bad | converted(cell, kind).isNull()
    rejects = rows.filter(bad).select(F.concat_ws(",", *cells).alias("line"))
    return rows.filter(~bad).select(*typed), rejects
