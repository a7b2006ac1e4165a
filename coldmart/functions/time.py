"""Instants in UTC, calendars in Japan Standard Time.

JST has had no daylight saving since 1951, so slot boundaries are computed with integer
arithmetic on the UTC instant plus nine hours, which Catalyst keeps inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JST = "Asia/Tokyo"
JST_OFFSET = 9 * 3600
SLOT_SECONDS = 900
DAY_SECONDS = 86400


def plus_millis(t: Column, millis: Column) -> Column:
    """``t`` moved by a whole number of milliseconds; microseconds survive."""
    return F.timestamp_micros(F.unix_micros(t) + millis.cast("bigint") * F.lit(1000))


def held_until(t: Column, held_seconds: Column) -> Column:
    return plus_millis(t, F.round(held_seconds * F.lit(1000)))


def corrected_at(
    ts: Column, uptime: Column, synced: Column, ref_ts: Column, ref_uptime: Column
) -> Column:
    """A synced clock is believed; otherwise the boot's anchor places the record."""
    moved = plus_millis(ref_ts, F.round((uptime - ref_uptime) * F.lit(1000)))
    return F.when(F.coalesce(synced, F.lit(False)) | ref_ts.isNull(), ts).otherwise(moved)


def whole_millis_between(start: Column, end: Column) -> Column:
    """``end - start`` in whole milliseconds, cut off towards zero."""
    return F.call_function("div", F.unix_micros(end) - F.unix_micros(start), F.lit(1000))


def group_start(t: Column, factor: int | Column, slot_seconds: int = SLOT_SECONDS) -> Column:
    """Start of the clock-aligned group of ``factor`` slots, counted from JST midnight."""
    span = (factor if isinstance(factor, Column) else F.lit(factor)) * F.lit(slot_seconds)
    into_day = F.pmod(F.unix_seconds(t) + F.lit(JST_OFFSET), F.lit(DAY_SECONDS))
    return F.timestamp_seconds(
        F.unix_seconds(t) - into_day + (into_day - F.pmod(into_day, span))
    )


def _local(t: Column) -> Column:
    return F.from_utc_timestamp(t, JST)


def jst_date(t: Column) -> Column:
    return F.to_date(_local(t))


def date_key(t: Column) -> Column:
    return F.date_format(_local(t), "yyyyMMdd").cast("bigint")


def slot_key(t: Column) -> Column:
    return F.date_format(_local(t), "yyyyMMddHHmm")


def jst_hour(t: Column) -> Column:
    return F.hour(_local(t)).cast("bigint")


def jst_minute(t: Column) -> Column:
    return F.minute(_local(t)).cast("bigint")


def iso_week_key(t: Column) -> Column:
    day = jst_date(t)
    return F.format_string(
        "%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.extract(F.lit("WEEK"), day)
    )
