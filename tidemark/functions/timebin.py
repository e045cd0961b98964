"""Time bins, windows and epoch conversions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

MICROS = 1_000_000
# Fixed value: seconds from 0001-01-01 to 1970-01-01, the origin of zero-time truncation.
YEAR_ONE_OFFSET_S = 62_135_596_800


def bin_micros(micros: Column, step_seconds: int | Column, origin: str = "epoch") -> Column:
    """Start of the bin, in microseconds since the epoch."""
    step = step_seconds * MICROS if isinstance(step_seconds, int) else step_seconds * F.lit(MICROS)
    step = F.lit(step) if isinstance(step, int) else step
    shift = F.lit(YEAR_ONE_OFFSET_S * MICROS if origin == "year-one" else 0)
    return micros - F.pmod(micros + shift, step)


def time_bin(ts: Column, step_seconds: int | Column, origin: str = "epoch") -> Column:
    """Timestamp of the bin start.

    ``origin="year-one"`` counts bins from 0001-01-01; it differs from the epoch
    origin only for steps that do not divide a day.
    """
    return F.timestamp_micros(bin_micros(F.unix_micros(ts), step_seconds, origin))


def in_window(ts: Column, start: datetime | Column, end: datetime | Column, day: Column | None = None) -> Column:
    """Half-open ``[start, end)`` predicate.

    Plain comparisons against constants reach the Parquet scan. Pass the day
    partition column to prune partitions as well.
    """
    lo = start if isinstance(start, Column) else F.lit(start)
    hi = end if isinstance(end, Column) else F.lit(end)
    cond = (ts >= lo) & (ts < hi)
    if day is not None:
        cond = cond & (day >= F.to_date(lo)) & (day <= F.to_date(hi))
    return cond


def epoch_to_nanos(x: Column) -> Column:
    """Nanoseconds of an epoch value that is milliseconds when it fits in 53 bits, else nanoseconds."""
    is_millis = (x >= F.lit(0)) & (x < F.lit(1 << 53))
    return F.when(is_millis & (x > F.lit((1 << 63) // 1_000_000)), F.lit(None)).when(
        is_millis, x * F.lit(1_000_000)
    ).otherwise(x)


def nanos_to_timestamp(ns: Column) -> Column:
    """Microsecond timestamp of a nanosecond count, rounding down."""
    return F.timestamp_micros(floor_div(ns, 1000))


def epoch_to_timestamp(x: Column) -> Column:
    """Timestamp of an epoch value in milliseconds (fits in 53 bits) or nanoseconds."""
    is_millis = (x >= F.lit(0)) & (x < F.lit(1 << 53))
    return F.when(is_millis, F.timestamp_millis(x)).otherwise(nanos_to_timestamp(x))


def floor_div(x: Column, n: int | Column) -> Column:
    """Integer division rounding down, exact for any long."""
    step = (F.lit(n) if isinstance(n, int) else n).cast("bigint")
    return F.call_function("div", x - F.pmod(x, step), step)


# Fixed value: shape of an RFC 3339 time.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def rfc3339_to_timestamp(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, null when it is not one."""
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def rfc3339_to_nanos(text: Column) -> Column:
    """Nanoseconds since the epoch of an RFC 3339 text; digits below a microsecond are kept."""
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0")
    below_micro = F.substring(fraction, 7, 3).cast("bigint")
    return F.unix_micros(rfc3339_to_timestamp(text)) * F.lit(1000) + below_micro


def nanos_to_rfc3339(ns: Column) -> Column:
    """RFC 3339 text with nine fractional digits."""
    head = F.date_format(nanos_to_timestamp(ns), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(head, F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))
