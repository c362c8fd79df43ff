"""Trading days and sessions as column expressions. Timestamps are TIMESTAMP_NTZ in UTC, so no session setting matters."""

from __future__ import annotations

from datetime import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Scheme, Session


def micros_of(t: time) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond


def to_local(ts: Column, scheme: Scheme) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(scheme.timezone), ts)


def to_utc(local: Column, scheme: Scheme) -> Column:
    """A local time that a clock change skips moves on by the gap; one that occurs twice is the first."""
    return F.convert_timezone(F.lit(scheme.timezone), F.lit("UTC"), local)


def micros_of_day(local: Column) -> Column:
    return (F.hour(local).cast("long") * 3600 + F.minute(local) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("long")


def _inside(tod: Column, s: Session) -> Column:
    start, end = micros_of(s.start), micros_of(s.end)
    return ((tod >= start) | (tod < end)) if s.crosses_midnight else ((tod >= start) & (tod < end))


def session_of(local: Column, scheme: Scheme) -> Column:
    """The first session in the scheme's order that holds the time; closed wins; else none."""
    tod = micros_of_day(local)
    out = F.when(_inside(tod, scheme.closed), "closed") if scheme.closed else F
    for s in scheme.sessions:
        out = out.when(_inside(tod, s), s.name)
    return out.otherwise("none")


def trading_day_of(local: Column, scheme: Scheme) -> Column:
    """The local date, the next one from the boundary on; null in the closed window."""
    shift = 24 * 60 - micros_of(scheme.boundary) // 60_000_000
    day = (local + F.expr(f"INTERVAL {shift} MINUTE")).cast("date")
    return F.when(~_inside(micros_of_day(local), scheme.closed), day) if scheme.closed else day


def with_session(df: DataFrame, scheme: Scheme, ts: str = "ts_event") -> DataFrame:
    """Adds local_ts, trading_day and session."""
    local = df.withColumn("local_ts", to_local(F.col(ts), scheme))
    return local.withColumns({"trading_day": trading_day_of(F.col("local_ts"), scheme), "session": session_of(F.col("local_ts"), scheme)})


def instant_on(day: Column, at: time, scheme: Scheme, day_shift: int = 0) -> Column:
    """The UTC instant of a local time on a date."""
    midnight = F.date_add(day, day_shift).cast("timestamp_ntz")
    return to_utc(midnight + F.expr(f"INTERVAL {micros_of(at) // 1_000_000} SECOND"), scheme)


def day_bounds(day: Column, scheme: Scheme) -> tuple[Column, Column]:
    return instant_on(day, scheme.boundary, scheme, -1), instant_on(day, scheme.boundary, scheme)
