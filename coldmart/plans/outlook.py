"""Where each battery stands, where it is going, and what the week cost."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldmart.functions import jst_date
from coldmart.functions.time import DAY_SECONDS, SLOT_SECONDS
from coldmart.operators.folding import discharge_slope, fold, latest_stretch
from coldmart.plans.reading import (
    JST,
    energy_between,
    finished_pulldowns_between,
    in_window,
    instant,
    jst_day,
    latest_state,
    utc,
)

DEVICE = "serial_number"
# Reasons for giving no outlook.
PLUGGED_IN, NO_SLOPE = "plugged_in", "no_slope"
MORNING_HOUR = 7


def next_morning_after(now: dt.datetime, hour: int = MORNING_HOUR) -> dt.datetime:
    local = utc(now).astimezone(JST)
    morning = local.replace(hour=hour, minute=0, second=0, microsecond=0)
    return morning if morning > local else morning + dt.timedelta(days=1)


def jst_midnight_before(now: dt.datetime) -> dt.datetime:
    return utc(now).astimezone(JST).replace(hour=0, minute=0, second=0, microsecond=0)


def days_between(start: dt.datetime, end: dt.datetime) -> list[dt.date]:
    """The JST dates touched by ``[start, end)``."""
    first, last = jst_day(start), jst_day(end - dt.timedelta(microseconds=1))
    return [first + dt.timedelta(days=n) for n in range((last - first).days + 1)]


def plugged_in() -> Column:
    return (F.col("battery_state") == "charging") | F.col("external_input")


def outlook(latest: DataFrame, slope: DataFrame, target: dt.datetime) -> DataFrame:
    """A straight line from each device's last charge to ``target``, or the reason there is none."""
    known = F.col("slope_percent_per_hour").isNotNull() & ~plugged_in()
    charge, rate = F.col("state_of_charge_percent"), F.col("slope_percent_per_hour")
    hours = (F.unix_micros(instant(target)) - F.unix_micros("updated_at")) / F.lit(3.6e9)
    projected = F.least(F.lit(100.0), F.greatest(F.lit(0.0), charge + rate * hours))
    return latest.join(slope, DEVICE, "left").select(
        *latest.columns,
        "slope_percent_per_hour",
        F.when(known, projected).alias("projected_percent"),
        F.when(plugged_in(), PLUGGED_IN).when(rate.isNull(), NO_SLOPE).alias("refused"),
        F.when(known & (rate < 0), charge / -rate).alias("hours_remaining"),
    )


def empty_before(outlooks: DataFrame, now: dt.datetime) -> DataFrame:
    """Adds when the battery runs out and whether that is before the next morning."""
    empty = F.timestamp_micros(
        F.unix_micros(instant(now)) + F.round(F.col("hours_remaining") * F.lit(3.6e9)).cast("bigint")
    )
    return outlooks.withColumn("empty_at", empty).withColumn(
        "empty_before_morning",
        F.coalesce(F.col("empty_at") < instant(next_morning_after(now)), F.lit(False)),
    )


def energy_vs_previous(fact: DataFrame, now: dt.datetime, dead_band: float = 1.0) -> DataFrame:
    """The last day's energy per device, and how it compares with the day before."""
    day = dt.timedelta(days=1)
    middle = instant(now - day)
    today = F.col("updated_at") > middle
    rows = fact.filter(in_window("updated_at", now - 2 * day, now, "(]"))
    sums = rows.groupBy(DEVICE).agg(
        *[
            F.coalesce(F.sum(F.when(part, F.col(name))), F.lit(0.0)).alias(f"{when}_{name}")
            for when, part in (("today", today), ("yesterday", ~today))
            for name in ("discharged_watt_hours", "charged_watt_hours")
        ]
    )
    before, after = F.col("yesterday_discharged_watt_hours"), F.col("today_discharged_watt_hours")
    return sums.withColumn(
        "against_yesterday",
        F.when(before == 0, "nothing_to_compare")
        .when(F.abs(after - before) < dead_band, "about_the_same")
        .when(after > before, "more")
        .otherwise("less"),
    )


def plugged_share(stretch: DataFrame) -> DataFrame:
    """What was recorded last without a hole, and the share of it spent on external power."""
    covered = F.col("covered_seconds")
    return stretch.groupBy(DEVICE).agg(
        F.min("slot_started_at").alias("recorded_from"),
        F.timestamp_seconds(F.unix_seconds(F.max("slot_started_at")) + SLOT_SECONDS).alias(
            "recorded_until"
        ),
        F.try_divide(
            F.sum(covered * F.coalesce("external_input_ratio", F.lit(0.0))), F.sum(covered)
        ).alias("plugged_share"),
    )


def reached_episodes(finished: DataFrame) -> DataFrame:
    """Per device: how many episodes reached the setpoint, and the last of them."""
    reached = finished.filter(F.col("duration_seconds").isNotNull())
    last = F.struct("ended_at", "pulldown_key")
    return reached.groupBy(DEVICE).agg(
        F.count(F.lit(1)).alias("reached_count"),
        F.max_by("duration_seconds", last).alias("last_duration_seconds"),
        F.max_by("interior_temperature_start_celsius", last).alias("last_start_celsius"),
    )


def daily_summary(
    fact: DataFrame, snapshot: DataFrame, pulldowns: DataFrame, now: dt.datetime
) -> DataFrame:
    """One row per device heard from by ``now``: last state then, energy, outlook, last recording."""
    day = dt.timedelta(days=1)
    slots = snapshot.filter(in_window("slot_started_at", now - 2 * day, now, "[)"))
    latest = latest_state(fact, now)
    expected = empty_before(outlook(latest, discharge_slope(slots), next_morning_after(now)), now)
    return (
        expected.join(energy_vs_previous(fact, now), DEVICE, "left")
        .join(plugged_share(latest_stretch(slots)), DEVICE, "left")
        .join(
            reached_episodes(finished_pulldowns_between(pulldowns, now - day, now)), DEVICE, "left"
        )
        .withColumn("reached_count", F.coalesce("reached_count", F.lit(0).cast("bigint")))
        .withColumn(
            "against_yesterday", F.coalesce("against_yesterday", F.lit("nothing_to_compare"))
        )
        .fillna(
            0.0,
            [
                f"{w}_{n}_watt_hours"
                for w in ("today", "yesterday")
                for n in ("discharged", "charged")
            ],
        )
    )


# ------------------------------------------------------------------ the week


def week_window(now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    end = jst_midnight_before(now)
    return end - dt.timedelta(days=7), end


def week_hours(snapshot: DataFrame, now: dt.datetime) -> DataFrame:
    start, end = week_window(now)
    return fold(snapshot.filter(in_window("slot_started_at", start, end, "[)")), 4)


def weekly_totals(hours: DataFrame) -> DataFrame:
    """Energy in and out, hours on external power, and what breaking even would take."""
    covered, ratio = F.col("covered_seconds"), F.coalesce("external_input_ratio", F.lit(0.0))
    series = Window.partitionBy(DEVICE)
    seen = F.when(covered > 0, F.col("slot_started_at"))
    spanned = hours.withColumn("_first", F.min(seen).over(series)).withColumn(
        "_last", F.max(seen).over(series)
    )
    hole = (covered == 0) & F.col("slot_started_at").between(F.col("_first"), F.col("_last"))
    sums = spanned.groupBy(DEVICE).agg(
        F.sum("discharged_watt_hours").alias("discharged_watt_hours"),
        F.sum("charged_watt_hours").alias("charged_watt_hours"),
        (F.sum(ratio * covered) / F.lit(3600.0)).alias("external_input_hours"),
        F.coalesce(F.sum(F.when(ratio > 0, F.col("charged_watt_hours"))), F.lit(0.0)).alias(
            "_plugged"
        ),
        F.count_if(F.coalesce(hole, F.lit(False))).alias("gap_hours"),
    )
    deficit = F.col("discharged_watt_hours") - F.col("charged_watt_hours")
    watts = F.col("average_charge_watts")
    return (
        sums.withColumn("net_watt_hours", -deficit)
        .withColumn(
            "average_charge_watts",
            F.when(
                F.col("external_input_hours") > 0, F.col("_plugged") / F.col("external_input_hours")
            ),
        )
        .withColumn(
            "balancing_hours", F.when((watts != 0) & (deficit > 0), deficit / watts)
        )
        .drop("_plugged")
    )


def _spine(devices: DataFrame, days: list[dt.date]) -> DataFrame:
    listed = F.array(*[F.lit(day) for day in days])
    return devices.select(DEVICE).distinct().select(DEVICE, F.explode(listed).alias("day"))


def daily_energy(hours: DataFrame, devices: DataFrame, days: list[dt.date]) -> DataFrame:
    """Energy and the lowest and highest charge per JST day; a day without data stays."""
    heard = F.col("covered_seconds") > 0
    ends = ("state_of_charge_start_percent", "state_of_charge_end_percent")
    per_day = hours.groupBy(DEVICE, jst_date(F.col("slot_started_at")).alias("day")).agg(
        F.sum("discharged_watt_hours").alias("discharged_watt_hours"),
        F.sum("charged_watt_hours").alias("charged_watt_hours"),
        F.min(F.when(heard, F.least(*ends))).alias("lowest_percent"),
        F.max(F.when(heard, F.greatest(*ends))).alias("highest_percent"),
    )
    return (
        _spine(devices, days)
        .join(per_day, [DEVICE, "day"], "left")
        .fillna(0.0, ["discharged_watt_hours", "charged_watt_hours"])
    )


def missing_days(hours: DataFrame, devices: DataFrame, days: list[dt.date]) -> DataFrame:
    covered = (
        hours.filter(F.col("covered_seconds") > 0)
        .select(DEVICE, jst_date(F.col("slot_started_at")).alias("day"))
        .distinct()
    )
    return _spine(devices, days).join(covered, [DEVICE, "day"], "left_anti")


def trigger_stats(episodes: DataFrame) -> DataFrame:
    """Episodes per trigger and how long the ones that reached the setpoint took."""
    return episodes.groupBy(DEVICE, "trigger").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("duration_seconds").alias("mean_duration_seconds"),
    )


def weekly_summary(
    snapshot: DataFrame, pulldowns: DataFrame, devices: DataFrame, now: dt.datetime
) -> DataFrame:
    """One row per device: totals, days without data, and episodes by trigger."""
    start, end = week_window(now)
    days = days_between(start, end)
    hours = week_hours(snapshot, now)
    absent = (
        missing_days(hours, devices, days)
        .groupBy(DEVICE)
        .agg(F.sort_array(F.collect_list("day")).alias("missing_days"))  # at most seven
    )
    triggers = (
        trigger_stats(finished_pulldowns_between(pulldowns, start, end))
        .groupBy(DEVICE)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("trigger", "episodes", "mean_duration_seconds"))
            ).alias("triggers")  # at most three
        )
    )
    return (
        devices.select(DEVICE)
        .distinct()
        .join(weekly_totals(hours), DEVICE, "left")
        .join(absent, DEVICE, "left")
        .join(triggers, DEVICE, "left")
    )


__all__ = [
    "DAY_SECONDS",
    "daily_energy",
    "daily_summary",
    "days_between",
    "empty_before",
    "energy_between",
    "energy_vs_previous",
    "missing_days",
    "next_morning_after",
    "outlook",
    "plugged_share",
    "reached_episodes",
    "trigger_stats",
    "week_hours",
    "week_window",
    "weekly_summary",
    "weekly_totals",
]
