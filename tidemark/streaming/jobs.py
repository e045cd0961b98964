"""Streaming rollup, ingest, reassembly, counters and alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from tidemark.operators.alerts import AlertRule, judge_notifications
from tidemark.operators.logs import apply_transforms
from tidemark.operators.slices import NO_SLICE, number_slice, time_slice
from tidemark.sinks.routed import with_destination


def stream_rollup(
    sdf: DataFrame, step: str, delay: str, dims: list[str], aggs: dict[str, Column], ts: str = "ts"
) -> DataFrame:
    """Tumbling rollup; a window is emitted once the watermark, ``delay`` behind the newest row, passes its end."""
    grouped = sdf.withWatermark(ts, delay).groupBy(F.window(ts, step).alias("_w"), *dims)
    out = grouped.agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("_w.start").alias("bin"), *dims, *aggs)


def split_late(df: DataFrame, now: datetime | Column, delay_seconds: int, ts: str = "ts") -> tuple[DataFrame, DataFrame, Observation]:
    """Rows in time, rows later than the delay, and an observation counting both while they are read."""
    limit = (now if isinstance(now, Column) else F.lit(now)) - F.make_dt_interval(secs=F.lit(delay_seconds))
    late = F.col(ts) < limit
    seen = Observation()
    observed = df.observe(seen, F.count_if(late).alias("late"), F.count_if(~late).alias("on_time"))
    return observed.filter(~late), observed.filter(late), seen


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """Identity of the stream that a checkpoint belongs to; a restart from it keeps it."""
    (row,) = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).collect()
    return row[0]


def stream_ingest(
    sdf: DataFrame, transforms: list[Callable[[DataFrame], DataFrame]], root: str, checkpoint: str, unrouted: str | None = None
) -> DataStreamWriter:
    """Transform and write each micro-batch to its destinations; call ``start()`` on the result.

    Output is partitioned by destination, stream and batch, and a batch overwrites
    only its own partitions: a batch delivered twice is stored once, and streams that
    share a root never touch each other's rows. Rows without a destination go to
    ``unrouted`` (``root`` with ``-unrouted`` added).
    """
    leftovers = unrouted or f"{root.rstrip('/')}-unrouted"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = with_destination(apply_transforms(batch, transforms))
        stamped = rows.withColumns({"run": F.lit(run_of(batch.sparkSession, checkpoint)), "batch": F.lit(batch_id)})
        stamped = stamped.persist(StorageLevel.MEMORY_AND_DISK)
        routed = F.col("database").isNotNull() & F.col("table").isNotNull()
        try:
            for path, part, folders in ((root, routed, ["database", "table"]), (leftovers, ~routed, [])):
                writer = stamped.filter(part).hint("rebalance", *(folders or ["batch"])).write.mode("overwrite")
                writer.option("partitionOverwriteMode", "dynamic").partitionBy(*folders, "run", "batch").parquet(path)
        finally:
            stamped.unpersist()

    return sdf.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _output_schema(sdf: DataFrame, without: tuple[str, ...], mark: str) -> T.StructType:
    """The stream's own columns, all nullable, and a boolean mark."""
    fields = [T.StructField(f.name, f.dataType) for f in sdf.schema.fields if f.name not in without]
    return T.StructType([*fields, T.StructField(mark, T.BooleanType())])


def with_arbitrary_state(spark: SparkSession) -> None:
    """State variables of processors need Spark's RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# Names of the columns that steer rows between two steps.
SLICE, LANE, OWNER, BORDER, ROLE, BUCKET = "tm_slice", "tm_lane", "tm_owner", "tm_border", "tm_role", "tm_bucket"
LANES = 64
# Groups that a step is called for: each takes the rows of many keys at once, because a call costs far more than a row.
BUCKETS = 128
# What a row is to the second step: finished, the first row of a piece, the last sample of a piece, an open rest, an open rest with its end.
DONE, FIRST, LAST, OPEN, END = range(5)


class _Processor(StatefulProcessor):
    """Frames of one group in, frames of fixed columns out."""

    def __init__(self, out: list[str]):
        self.out = out

    def init(self, handle) -> None:
        self.handle = handle

    def frame(self, rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
        parts = [r for r in rows if len(r)]
        return pd.concat(parts, ignore_index=True).sort_values(order, kind="stable", ignore_index=True) if parts else pd.DataFrame(columns=self.out)

    def finished(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows that need no state, frame by frame."""
        for part in rows:
            yield part[self.out]

    def close(self) -> None:
        pass


def _owned(sdf: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns as one JSON text: pandas would turn a key beside null keys into a float."""
    return sdf.withColumn(OWNER, F.to_json(F.struct(*keys))).drop(*keys)


def _steps(out: T.StructType, keys: list[str]) -> tuple[T.StructType, T.StructType]:
    """Columns between the two steps and behind them, with the owner in place of the keys."""
    plain = [T.StructField(OWNER, T.StringType()), *[f for f in out if f.name not in keys]]
    return T.StructType([*plain, T.StructField(SLICE, T.LongType()), T.StructField(ROLE, T.IntegerType())]), T.StructType(plain)


def bucket(*columns: str) -> Column:
    """Bucket of the keys in these columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def _second_step(
    first: DataFrame, processor: StatefulProcessor, plain: T.StructType, out: T.StructType, keys: list[str], timed: bool, by: Column
) -> DataFrame:
    """Border rows by a text of their owner, finished rows as they are, spread over lanes; only a ``timed`` step keeps the stream running without data."""
    border = F.col(ROLE) != DONE
    lane = F.when(border, -1).otherwise(F.pmod(F.xxhash64(OWNER, SLICE), F.lit(LANES)).cast("int"))
    spread = first.withColumns({LANE: lane, BORDER: F.when(border, by).otherwise("")}).groupBy(LANE, BORDER)
    done = spread.transformWithStateInPandas(processor, plain, "append", "ProcessingTime" if timed else "none")
    owner = F.from_json(OWNER, T.StructType([f for f in out if f.name in keys]))
    return done.withColumn(OWNER, owner).select(*[F.col(OWNER)[f.name].alias(f.name) if f.name in keys else f.name for f in out])


class LinePieces(_Processor):
    """Lines of some slices of streams: whole messages, and the rests before the first and after the last end of each slice."""

    def __init__(self, out: list[str], order: str, message: str, joined: bool):
        super().__init__(out)
        self.order, self.message, self.joined = order, message, joined

    def handleInputRows(self, key, rows, timers):
        rows = [r for r in rows if len(r)]
        if not rows:
            return
        by = [c for c in (OWNER, SLICE) if c in rows[0]]
        lines = self.frame(rows, [*by, self.order])
        lines[self.message] = lines[self.message].fillna("")
        ends = ~lines["is_partial"].astype(bool)
        piece = lines.groupby(by, sort=False).ngroup()
        number = ends.groupby(piece).cumsum() - ends  # the message a line belongs to, within the piece
        inner = (number > 0) & (number < ends.groupby(piece).transform("sum"))
        closing = (piece != piece.shift(-1)) | ends
        texts, stops = lines[self.message].to_list(), np.flatnonzero(closing) + 1
        whole = lines[closing].assign(**{self.message: ["".join(texts[i:j]) for i, j in zip([0, *stops[:-1]], stops)]})
        # The last message of a piece is open if nothing ends it, and so is the first, which may have begun before.
        done = whole[inner[closing]].assign(**{"cut": False, ROLE: DONE})
        rest = whole[~inner[closing]] if self.joined else lines[~inner]
        yield pd.concat([done, rest.assign(**{"cut": False, ROLE: ends[rest.index].map({True: END, False: OPEN})})])[self.out]


class LineJoiner(_Processor):
    """Rests of one stream, in order; the open message waits in the state."""

    def __init__(self, out: list[str], order: str, message: str, longest: int | None, idle_ms: int | None):
        super().__init__(out)
        self.order, self.message, self.longest, self.idle_ms = order, message, longest, idle_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "at long, text string")

    def handleInputRows(self, key, rows, timers):
        if not key[1]:
            yield from self.finished(rows)
            return
        kept = self.open.get() if self.open.exists() else None
        done, left = self.join(kept, self.frame(rows, [self.order]).to_dict("records"))
        if left:
            self.open.update(left)
        elif kept:
            self.open.clear()
        if self.idle_ms:
            for timer in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            if left:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(done, columns=self.out)

    def join(self, kept: tuple | None, rows: list[dict]) -> tuple[list[dict], tuple | None]:
        """Finished messages of ordered rests behind an open message, and what is open then."""
        at, text = kept or (None, "")
        pieces, size, done = [text], len(text), []
        for row in rows:
            pieces.append(row[self.message])
            at, size = int(row[self.order]), size + len(row[self.message])
            cut = row[ROLE] == OPEN
            if not cut or (self.longest and size >= self.longest):
                done.append(row | {self.message: "".join(pieces), "cut": cut})
                pieces, size, at = [], 0, None
        return done, None if at is None else (at, "".join(pieces))

    def handleExpiredTimer(self, key, timers, expired):
        if self.open.exists():
            at, text = self.open.get()
            self.open.clear()
            given = {OWNER: key[1], self.order: at, self.message: text, "cut": True}
            yield pd.DataFrame([given]).reindex(columns=self.out)


class LineJoiners(LineJoiner):
    """Rests of the streams of one bucket; each stream's open message waits in a map state."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "owner string", "at long, text string")

    def handleInputRows(self, key, rows, timers):
        if not key[1]:
            yield from self.finished(rows)
            return
        found = []
        for owner, rests in groupby(self.frame(rows, [OWNER, self.order]).to_dict("records"), lambda r: r[OWNER]):
            kept = self.open.getValue((owner,))
            done, left = self.join(kept, list(rests))
            found += done
            if left:
                self.open.updateValue((owner,), left)
            elif kept:
                self.open.removeKey((owner,))
        yield pd.DataFrame(found, columns=self.out)


def reassemble_stream(
    sdf: DataFrame, keys: list[str], order: str = "offset", message: str = "message",
    longest: int | None = None, idle_ms: int | None = None, slice_width: int = 100_000,
) -> DataFrame:
    """Join partial lines across micro-batches; an unfinished message waits in the state of its stream.

    Positions grow within a stream. Lines are first joined per (stream, slice of
    ``slice_width`` positions), so one stream is worked by many tasks; only what is open at
    the borders of a slice meets the state of the stream. Slices, and then streams, are
    dealt to ``BUCKETS`` groups, so the number of calls does not grow with that of streams;
    with ``idle_ms`` each stream has a timer and a call of its own in the second step. With
    ``longest`` a message that reaches that many characters without an end is given out as
    it is, with ``cut`` set, and so is one whose stream has been idle for ``idle_ms``; a
    finished message leaves no state.
    """
    with_arbitrary_state(sdf.sparkSession)
    out = _output_schema(sdf, ("is_partial",), "cut")
    steps, plain = _steps(out, keys)
    sliced = _owned(sdf, keys).withColumn(SLICE, F.coalesce(number_slice(F.col(order), slice_width), F.lit(NO_SLICE)))
    dealt = sliced.withColumn(BUCKET, bucket(OWNER, SLICE)).groupBy(BUCKET)
    pieces = dealt.transformWithStateInPandas(LinePieces(steps.names, order, message, longest is None), steps, "append", "none")
    kind, by = (LineJoiner, F.col(OWNER)) if idle_ms else (LineJoiners, bucket(OWNER).cast("string"))
    return _second_step(pieces, kind(plain.names, order, message, longest, idle_ms), plain, out, keys, bool(idle_ms), by)


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows equal in all columns begins."""
    return np.logical_or.reduce([np.append(True, c[1:] != c[:-1]) for c in columns])


class SlicedCounter(_Processor):
    """Samples of some (series, lane of slices): changes within each slice, and its first and last sample for the series' state.

    The state is the newest sample of a lane, so a series has at most one of them for each
    lane. What is not newer is late: its slice, or a later one, has been seen that far.
    """

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getMapState("lane_last", "owner string, lane long", "slice long, at long, value double")

    def handleInputRows(self, key, rows, timers):
        data = self.frame(rows, [OWNER, LANE, SLICE, "Timestamp", "Value"])
        if not len(data):
            return
        lane = data.groupby([OWNER, LANE], sort=False).ngroup().to_numpy()
        names = list(data.loc[_begins(lane), [OWNER, LANE]].itertuples(index=False, name=None))
        seen = [self.last.getValue(name) for name in names]
        known = np.array([s is not None for s in seen])
        seen_slice, seen_at, seen_value = (np.array([s[i] if s else 0 for s in seen], kind) for i, kind in enumerate((np.int64, np.int64, float)))
        micros = _micros(data["Timestamp"])
        late = known[lane] & (micros <= seen_at[lane])
        given = data.assign(late=late, **{ROLE: DONE})
        fresh = given[~late]
        if not len(fresh):
            yield given[self.out]
            return
        lane, micros, number, value = lane[~late], micros[~late], fresh[SLICE].to_numpy(), fresh["Value"].to_numpy(float)
        begins = _begins(lane, number)
        goes_on = begins & known[lane] & (seen_slice[lane] == number)
        before = np.append(np.nan, value[:-1])
        before[goes_on] = seen_value[lane[goes_on]]
        first = begins & ~goes_on
        grown = np.where(first | (value < before), value, value - before)
        changed = fresh.assign(**{"Value": grown, ROLE: np.where(first, FIRST, DONE)})
        # The last sample goes on as it was, to be the state of the series.
        last = fresh[np.append(begins[1:], True)].assign(**{ROLE: LAST})
        for i in np.flatnonzero(np.append(_begins(lane)[1:], True)):
            self.last.updateValue(names[lane[i]], (int(number[i]), int(micros[i]), float(value[i])))
        yield pd.concat([given[late], changed, last])[self.out]


class SeriesCounter(_Processor):
    """First and last samples of the slices of the series of one bucket; the newest sample of each series is its state."""

    def __init__(self, out: list[str], idle_ms: int | None):
        super().__init__(out)
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getMapState("series_last", "owner string", "at long, value double", self.idle_ms)

    def handleInputRows(self, key, rows, timers):
        if not key[1]:
            yield from self.finished(rows)
            return
        # The first sample of a slice can be its last one too: it comes before itself.
        borders = self.frame(rows, [OWNER, "Timestamp", ROLE])
        if not len(borders):
            return
        first = (borders[ROLE] == FIRST).to_numpy()
        samples = zip(borders[OWNER], _micros(borders["Timestamp"]).tolist(), borders["Value"].to_numpy(float).tolist(), first.tolist())
        values, late = [], []
        for owner, some in groupby(samples, lambda s: s[0]):
            seen = self.last.getValue((owner,))
            for _, at, value, is_first in some:
                old = seen is not None and at <= seen[0]
                if is_first:
                    late.append(old)
                    values.append(value if old else 0.0 if seen is None else value if value < seen[1] else value - seen[1])
                if not old:
                    seen = (at, value)
            self.last.updateValue((owner,), tuple(seen))
        yield borders[first].assign(Value=values, late=late)[self.out]


def stream_increase(sdf: DataFrame, idle_ms: int | None = None, slice_seconds: int = 86_400, lanes: int = 64) -> DataFrame:
    """Counter increase with the previous sample of each series as state.

    A reset counts from zero, because the following sample is not known yet. Changes are
    taken per (series, lane of time slices), so one series is worked by up to ``lanes``
    tasks; only the first and last samples of slices meet the state of the series. Lanes, and
    then series, are dealt to ``BUCKETS`` groups, so the number of calls does not grow with
    that of series. Rows not newer than what their lane has seen come out unchanged with ``late`` set, and so does
    the first row of a slice that is not newer than the series. A series idle for
    ``idle_ms`` is forgotten and starts anew.
    """
    with_arbitrary_state(sdf.sparkSession)
    out = _output_schema(sdf, (), "late")
    steps, plain = _steps(out, ["SeriesId"])
    sliced = _owned(sdf.filter(~F.isnan("Value")), ["SeriesId"]).withColumn(SLICE, F.coalesce(time_slice(F.col("Timestamp"), slice_seconds), F.lit(NO_SLICE)))
    laned = sliced.withColumn(LANE, F.pmod(SLICE, F.lit(lanes)))
    dealt = laned.withColumn(BUCKET, bucket(OWNER, LANE)).groupBy(BUCKET)
    pieces = dealt.transformWithStateInPandas(SlicedCounter(steps.names), steps, "append", "none")
    return _second_step(pieces, SeriesCounter(plain.names, idle_ms), plain, out, ["SeriesId"], bool(idle_ms), bucket(OWNER).cast("string"))


class LateMarker(_Processor):
    """Marks rows whose window has been given out: its end is not after the watermark."""

    def handleInputRows(self, key, rows, timers):
        closed = timers.getCurrentWatermarkInMs() * 1000
        for part in rows:
            part[ROLE] = part["tm_end"] <= closed
            # Rows in an open window may be older than the watermark, which no step may give out: in the same window, at it.
            part["tm_time"] = part["tm_at"].clip(lower=closed).astype("datetime64[us]")
            yield part[self.out]


def stream_rollup_with_late(
    sdf: DataFrame, step: str, delay: str, dims: list[str], aggs: dict[str, Column], ts: str = "ts", lanes: int = 16
) -> DataFrame:
    """Rollup of :func:`stream_rollup` that also gives out every row that came too late for its window.

    Rows out: ``bin``, the dimensions, the aggregates and ``late_row``. In a bin ``late_row`` is
    null. A late row, or one without a time, comes out as JSON with a null bin and aggregates
    of its own, together with its exact copies. A step before the rollup compares each row's
    window with the watermark and moves late rows to the watermark, so the rollup drops none:
    bins and late rows together are all rows.
    """
    with_arbitrary_state(sdf.sparkSession)
    columns, never = sdf.columns, -(1 << 62)
    timed = sdf.withColumn("tm_row", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).withWatermark(ts, delay)
    end = F.when(F.col(ts).isNull(), never).otherwise(F.unix_micros(F.window(F.coalesce(ts, F.timestamp_micros(F.lit(0))), step)["end"]))
    shaped = timed.withColumns({"tm_end": end, "tm_at": F.coalesce(F.unix_micros(ts), F.lit(never)), LANE: F.pmod(F.xxhash64("tm_row"), F.lit(lanes))})
    kept = [f for f in sdf.schema.fields if f.name != ts]
    steps = [("tm_row", T.StringType()), ("tm_at", T.LongType()), ("tm_time", T.TimestampType()), (ROLE, T.BooleanType())]
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept], *[T.StructField(n, kind) for n, kind in steps]])
    # Without the watermarked column Spark does not drop late rows before this step sees them.
    unmarked = shaped.select(*[f.name for f in kept], "tm_row", "tm_end", "tm_at", LANE).groupBy(LANE)
    marked = unmarked.transformWithStateInPandas(LateMarker(out.names), out, "append", "EventTime", eventTimeColumnName="tm_time")
    late_row = F.when(F.col(ROLE), F.col("tm_row")).alias("late_row")
    restored = marked.withColumn(ts, F.when(F.col("tm_at") != never, F.timestamp_micros("tm_at")))
    grouped = restored.groupBy(F.window("tm_time", step).alias("tm_window"), *dims, late_row).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(F.when(F.col("late_row").isNull(), F.col("tm_window.start")).alias("bin"), *dims, *aggs, "late_row")


def judge_stream_alerts(sdf: DataFrame, rule: AlertRule, correlation: str, within: str, ts: str = "ts", salts: int = 16) -> DataFrame:
    """Alert rows of a stream as notifications, one per correlation id within the watermark delay, with a ``reason`` for invalid ones.

    Rows without an id are each an alert of their own. Repeats of an id are dropped per
    (id, salt) first and per id after, so an id that floods the stream is spread over
    ``salts`` tasks and only a few rows of it meet.
    """
    has_id = F.coalesce(correlation, F.lit("")) != ""
    marked = sdf.withWatermark(ts, within)
    salt = F.pmod(F.xxhash64(*sdf.columns), F.lit(salts).cast("bigint"))
    few = marked.filter(has_id).withColumn("_salt", salt).dropDuplicatesWithinWatermark([correlation, "_salt"]).drop("_salt")
    unique = few.dropDuplicatesWithinWatermark([correlation]).unionByName(marked.filter(~has_id))
    return judge_notifications(unique.drop(ts), rule)


def stream_alerts(
    sdf: DataFrame, rule: AlertRule, correlation: str, within: str, ts: str = "ts", salts: int = 16
) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows of :func:`judge_stream_alerts`: two streams with a state of their own each, if both are started."""
    judged = judge_stream_alerts(sdf, rule, correlation, within, ts, salts)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
