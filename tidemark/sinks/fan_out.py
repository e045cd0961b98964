"""One batch to several sinks."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str | None]:
    """Hand the batch to every sink at once; the result maps each sink to its error or None.

    A failing sink does not stop the others. The batch is computed once and kept
    on executors (spilling to disk) while the sinks read it.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)

    def deliver(sink: Callable[[DataFrame], None]) -> str | None:
        try:
            sink(kept)
            return None
        except Exception as error:  # each sink's failure is reported, not raised
            return str(error) or type(error).__name__

    try:
        with ThreadPoolExecutor(max_workers=max(1, len(sinks))) as pool:
            return dict(zip(sinks, pool.map(deliver, sinks.values())))
    finally:
        kept.unpersist()
