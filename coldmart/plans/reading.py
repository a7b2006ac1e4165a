"""Point-in-time and range reads of the star.

Every range read adds the matching predicate on the partition column: Spark cannot infer
that a bound on an instant is also a bound on its JST date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.functions import iso_week_key

JST = dt.timezone(dt.timedelta(hours=9))

# The columns each read answers with.
STATE_COLUMNS = [
    "updated_at", "setpoint_celsius", "interior_temperature_celsius", "state_of_charge_percent",
    "battery_state", "external_input", "input_watts", "charge_watts", "discharge_watts",
    "ambient_temperature_celsius",
]
SLOT_COLUMNS = [
    "slot_started_at", "covered_seconds", "state_of_charge_start_percent",
    "state_of_charge_end_percent", "state_of_charge_delta_percent", "discharged_watt_hours",
    "charged_watt_hours", "interior_temperature_celsius", "ambient_temperature_celsius",
    "external_input_ratio",
]
EPISODE_COLUMNS = [
    "pulldown_key", "started_at", "reached_at", "ended_at", "trigger", "outcome",
    "interior_temperature_start_celsius", "setpoint_celsius", "state_of_charge_start_percent",
    "state_of_charge_delta_percent", "duration_seconds", "elapsed_seconds",
    "discharged_watt_hours", "charged_watt_hours", "ambient_temperature_celsius",
    "external_input_ratio",
]


def utc(moment: dt.datetime) -> dt.datetime:
    return moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)


def instant(moment: dt.datetime) -> Column:
    whole = utc(moment) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(whole // dt.timedelta(microseconds=1)))


def jst_day(moment: dt.datetime) -> dt.date:
    return utc(moment).astimezone(JST).date()


def in_window(
    column: str,
    start: dt.datetime | None,
    end: dt.datetime | None,
    closed: str,
    partition: str | None = "partition_date",
) -> Column:
    """``column`` between two instants; ``closed`` is one of ``(]``, ``[)`` and ``[]``.

    ``partition`` is the column holding the JST date of ``column``, if the table has one.
    """
    left, right = closed
    value, condition = F.col(column), F.lit(True)
    if start is not None:
        bound = instant(start)
        condition = condition & (value >= bound if left == "[" else value > bound)
        if partition:
            condition = condition & (F.col(partition) >= F.lit(jst_day(start)))
    if end is not None:
        bound = instant(end)
        condition = condition & (value <= bound if right == "]" else value < bound)
        if partition:
            condition = condition & (F.col(partition) <= F.lit(jst_day(end)))
    return condition


def latest_state(
    fact: DataFrame, moment: dt.datetime | None = None, device: str = "serial_number"
) -> DataFrame:
    """Each device's last report, optionally at or before ``moment``; one partial aggregate."""
    rows = fact if moment is None else fact.filter(in_window("updated_at", None, moment, "[]"))
    return (
        rows.groupBy(device)
        .agg(
            F.max_by(
                F.struct(*STATE_COLUMNS), F.struct("updated_at", "state_update_key")
            ).alias("s")
        )
        .select(device, "s.*")
    )


def energy_between(
    fact: DataFrame, start: dt.datetime, end: dt.datetime, by: tuple[str, ...] = ()
) -> DataFrame:
    """Battery energy out and in during ``(start, end]``; 0.0 when nothing was recorded."""
    rows = fact.filter(in_window("updated_at", start, end, "(]"))
    return rows.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(name), F.lit(0.0)).alias(name)
            for name in ("discharged_watt_hours", "charged_watt_hours")
        ]
    )


def weeks_with_updates(fact: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    return (
        fact.filter(in_window("updated_at", start, end, "[)"))
        .select(iso_week_key(F.col("updated_at")).alias("week_key"))
        .distinct()
    )


def state_updates_between(
    fact: DataFrame, start: dt.datetime, end: dt.datetime, device: str = "serial_number"
) -> DataFrame:
    """Reports in ``[start, end]``; order them where they are shown, not here."""
    return fact.filter(in_window("updated_at", start, end, "[]")).select(device, *STATE_COLUMNS)


def snapshots(
    snapshot: DataFrame, start: dt.datetime, end: dt.datetime, device: str = "serial_number"
) -> DataFrame:
    """Slots starting in ``[start, end)``, holes included."""
    return snapshot.filter(in_window("slot_started_at", start, end, "[)")).select(
        device, *SLOT_COLUMNS
    )


def finished_pulldowns_between(
    pulldowns: DataFrame, start: dt.datetime, end: dt.datetime, device: str = "serial_number"
) -> DataFrame:
    """Episodes that ended in ``(start, end]``.

    Filed under the day they started, which is never after the day they ended.
    """
    return pulldowns.filter(
        F.col("outcome").isNotNull()
        & in_window("ended_at", start, end, "(]", partition=None)
        & (F.col("partition_date") <= F.lit(jst_day(end)))
    ).select(device, *EPISODE_COLUMNS)
