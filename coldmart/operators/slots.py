"""Held intervals allocated to a dense grid of quarter hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldmart.functions import date_key, jst_date, slot_key
from coldmart.functions.measures import share_of_time, weighted_mean
from coldmart.functions.time import SLOT_SECONDS, jst_hour, jst_minute
from coldmart.operators.ordered import MICROS

ENERGIES = {
    "discharged_watt_hours": "discharge_watts",
    "charged_watt_hours": "charge_watts",
    "input_watt_hours": "input_watts",
    "usb_a_output_watt_hours": "usb_a_output_watts",
    "usb_c_output_watt_hours": "usb_c_output_watts",
}
MEANS = (
    "ambient_temperature_celsius",
    "ambient_humidity_percent",
    "interior_temperature_celsius",
    "setpoint_celsius",
)
_MILLIS_PER_HOUR = 3_600_000.0


def _slot_of(micros: Column, span: int) -> Column:
    return micros - F.pmod(micros, F.lit(span))


def allocate(updates: DataFrame, seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per (report, slot it reaches into), with the overlap in milliseconds.

    The slots of a report follow from its own two ends, so the theta join against the slot
    spine becomes an ``explode``: narrow, no shuffle, no spine. A report's own slot is
    always emitted; ``_counts`` is false where the interval is empty and starts exactly on
    the boundary, which overlaps nothing but still says the series was alive then.
    """
    span = seconds * MICROS
    start, until = F.unix_micros("updated_at"), F.col("_until")
    first = _slot_of(start, span)
    last = F.greatest(first, _slot_of(until - F.lit(1), span))
    return (
        updates.withColumn(
            "_until",
            start + F.round(F.col("held_seconds") * F.lit(1000)).cast("bigint") * F.lit(1000),
        )
        .withColumn("_slot", F.explode(F.sequence(first, last, F.lit(span))))
        .withColumn("_counts", until > F.col("_slot"))
        .withColumn(
            "_overlap",
            F.call_function(
                "div",
                F.least(until, F.col("_slot") + F.lit(span)) - F.greatest(start, F.col("_slot")),
                F.lit(1000),
            ),
        )
    )


def slot_aggregate(pieces: DataFrame, device: str = "serial_number") -> DataFrame:
    """One row per device and touched slot.

    Watts and overlaps are whole numbers, so energies are summed exactly and divided once:
    the same bits whatever order the pieces arrive in.
    """
    counts, overlap = F.col("_counts"), F.col("_overlap")
    order = [
        F.when(counts, F.struct("updated_at", "state_update_key")),
    ]
    zero = F.lit(0).cast("bigint")
    lasting = F.sum(overlap)
    return pieces.groupBy(device, "_slot").agg(
        F.max("_until").alias("_last_until"),
        F.count_if(counts).alias("update_count"),
        F.least(F.lit(float(SLOT_SECONDS)), lasting / F.lit(1000.0)).alias("covered_seconds"),
        _kept_by(F.max_by, "cooler_key", order).alias("cooler_key"),
        _kept_by(F.max_by, "battery_key", order).alias("battery_key"),
        _kept_by(F.min_by, "state_of_charge_percent", order).alias("state_of_charge_start_percent"),
        _kept_by(F.max_by, "state_of_charge_percent", order).alias("state_of_charge_end_percent"),
        *[
            (F.sum(F.col(watts) * overlap) / F.lit(_MILLIS_PER_HOUR)).alias(name)
            for name, watts in ENERGIES.items()
        ],
        *[weighted_mean(F.col(name), overlap).alias(name) for name in MEANS],
        share_of_time(F.col("external_input"), overlap).alias("external_input_ratio"),
        share_of_time(F.col("battery_state") == "charging", overlap).alias("charging_ratio"),
        F.coalesce(F.sum(F.when(counts, overlap)), zero).alias("_counted"),
    )


def _kept_by(pick, value: str, order: list[Column]) -> Column:
    # Wrapped so that a NULL value of the chosen row is kept as that row's value.
    return pick(F.struct(F.col(value).alias("v")), order[0])["v"]


def slot_snapshot(
    fact: DataFrame, device: str = "serial_number", seconds: int = SLOT_SECONDS
) -> DataFrame:
    """Every quarter hour from a device's first slot to the one its last hold runs into.

    One shuffle of pieces that are combined before they move; the holes are then filled
    from the distance to the next touched slot. That window sees one row per slot, which
    the calendar bounds (about 35,000 a year), however many reports a device sends.
    """
    span = seconds * MICROS
    touched = slot_aggregate(allocate(fact, seconds), device)
    whole = Window.partitionBy(device)
    series = whole.orderBy("_slot")
    last_slot = F.greatest(
        F.min("_slot").over(whole),
        _slot_of(F.max("_last_until").over(whole) - F.lit(1000), span),
    )
    filled = (
        touched.withColumn("_last_slot", last_slot)
        .withColumn("_next", F.lead("_slot").over(series))
        .filter(F.col("_slot") <= F.col("_last_slot"))
        .withColumn(
            "_here",
            F.explode(
                F.sequence(
                    F.col("_slot"),
                    # The next touched slot may lie past the end and be cut off itself.
                    F.least(
                        F.coalesce(F.col("_next") - F.lit(span), F.col("_last_slot")),
                        F.col("_last_slot"),
                    ),
                    F.lit(span),
                )
            ),
        )
    )
    real = (F.col("_here") == F.col("_slot")) & (F.col("update_count") > 0)
    started = F.timestamp_micros("_here")

    def kept(name: str) -> Column:
        return F.when(real, F.col(name)).alias(name)

    return filled.select(
        device,
        slot_key(started).alias("slot_key"),
        kept("cooler_key"),
        kept("battery_key"),
        date_key(started).alias("date_key"),
        jst_date(started).alias("partition_date"),
        jst_hour(started).alias("hour_of_day"),
        jst_minute(started).alias("minute_of_hour"),
        started.alias("slot_started_at"),
        kept("state_of_charge_start_percent"),
        kept("state_of_charge_end_percent"),
        F.when(
            real, F.col("state_of_charge_end_percent") - F.col("state_of_charge_start_percent")
        ).alias("state_of_charge_delta_percent"),
        *[kept(name) for name in ENERGIES],
        *[kept(name) for name in MEANS],
        kept("external_input_ratio"),
        kept("charging_ratio"),
        F.when(real, F.col("covered_seconds")).otherwise(F.lit(0.0)).alias("covered_seconds"),
        F.when(real, F.col("update_count")).otherwise(F.lit(0).cast("bigint")).alias("update_count"),
    )


def observed_span(fact: DataFrame, device: str = "serial_number") -> DataFrame:
    """First and last instant and slot of each device, from the fact alone."""
    until = F.unix_micros("updated_at") + F.round(F.col("held_seconds") * 1000).cast("bigint") * 1000
    span = SLOT_SECONDS * MICROS
    ends = fact.groupBy(device).agg(
        F.min(F.unix_micros("updated_at")).alias("_first"), F.max(until).alias("_last")
    )
    first_slot = _slot_of(F.col("_first"), span)
    last_slot = F.greatest(first_slot, _slot_of(F.col("_last") - F.lit(1000), span))
    return ends.select(
        device,
        F.timestamp_micros("_first").alias("first_at"),
        F.timestamp_micros("_last").alias("last_at"),
        F.timestamp_micros(first_slot).alias("first_slot"),
        F.timestamp_micros(last_slot).alias("last_slot"),
    )


__all__ = ["allocate", "observed_span", "slot_aggregate", "slot_snapshot"]
