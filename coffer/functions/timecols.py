"""Instant and calendar-day expressions.

Canonical instants are ``TIMESTAMP_NTZ`` holding UTC wall-clock time, so the
expressions below never depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.schemas import SHEET_TZ


def as_utc_ntz(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a UTC ``TIMESTAMP_NTZ``.

    NTZ input is taken as UTC already. Session-zoned ``TIMESTAMP`` input is an
    absolute instant; its wall clock in the session zone is moved to UTC.
    Strings are read as UTC wall-clock times.
    """
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, T.TimestampType):
        tz = df.sparkSession.conf.get("spark.sql.session.timeZone")
        return F.convert_timezone(F.lit(tz), F.lit("UTC"), col.cast(T.TimestampNTZType()))
    if isinstance(dtype, T.DateType):
        return col.cast(T.TimestampNTZType())
    return col.try_cast(T.TimestampNTZType())


def local_day(ts: Column | str, tz: str = SHEET_TZ) -> Column:
    """Calendar day of a UTC instant in time zone ``tz`` (DST-aware)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts))


def utc_day(ts: Column | str) -> Column:
    """UTC calendar day of a UTC instant (``CONVERT(date, ts)``)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(ts)


def to_second(ts: Column | str) -> Column:
    """UTC NTZ instant truncated to whole seconds.

    NTZ arithmetic only: ``date_trunc`` would round-trip through the session
    zone and move wall-clock times that fall in a DST gap there.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)
    return F.timestamp_add("MICROSECOND", -F.pmod(micros, F.lit(1000000)), ts)


def day_spine(start: Column, end: Column) -> Column:
    """Inclusive daily calendar ``[start, end]`` as an array of dates (H7/H8).

    Empty when ``end < start``; explode it to get one row per day.
    """
    return F.when(
        end >= start, F.sequence(start, end, F.expr("INTERVAL 1 DAY"))
    ).otherwise(F.array().cast("array<date>"))


_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def utc_ntz_to_instant(ts: Column | str) -> Column:
    """The absolute instant (session-zoned ``TIMESTAMP``) of a UTC NTZ time —
    what watermarks and event-time windows require. Zone-independent: built
    from epoch microseconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), ts))


def instant_to_utc_ntz(ts: Column | str) -> Column:
    """UTC wall-clock NTZ time of an absolute instant (zone-independent)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.expr(_EPOCH_NTZ))
