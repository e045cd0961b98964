"""Helpers shared by the operators: words of a text, Arrow batches, stored intermediate tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import delete_path, scratch_path

SLICE = 256
BATCH_ROWS = 1000


def _word_table() -> bytes:
    """Byte map: A-Z to a-z, other ASCII but digits and letters to a space, the rest as it is."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


WORD_TABLE = _word_table()


def words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, as UTF-8."""
    return text.translate(WORD_TABLE).split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z, as UTF-8."""
    return text.lower().split()


def word_count(text: str | Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, a few rows at a time; null gives an empty text."""
    data = column.cast(pa.large_binary())
    for at in range(0, len(data), SLICE):
        for value in data.slice(at, SLICE).to_pylist():
            yield value or b""


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: a batch of very long texts must still fit beside others in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written by stored() in this process and not yet removed.
WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and no task is run twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession, since: int, until: int) -> None:
    """Remove the folders that stored() wrote between two lengths of ``WRITTEN``: what is computed from them is stored elsewhere."""
    for path in WRITTEN[since:until]:
        delete_path(spark, path)
    del WRITTEN[since:until]


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns of a frame in one struct ``row``, beside computed columns whose names cannot clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def worker_cache(name: str) -> dict[Any, Any]:
    """A dict that lives as long as its Python process; functions arrive by value, so module globals do not.

    A process serves one operator after the other: what another one kept is dropped.
    """
    module = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    if getattr(module, "owner", None) != name:
        module.owner, module.kept = name, {}
    return module.kept
