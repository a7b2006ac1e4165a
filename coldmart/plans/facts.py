"""The atomic fact; the snapshot and the episodes are operators over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldmart.functions import date_key, jst_date, watt_hours
from coldmart.operators.asof import asof_version, lookup_or_absent
from coldmart.schemas import STATE_UPDATE, conform


def state_update_fact(
    updates: DataFrame, devices: DataFrame, batteries: DataFrame
) -> DataFrame:
    """One row per report, with the device version and battery valid at its moment."""
    versioned = asof_version(
        updates, devices, "serial_number", F.col("updated_at"), ["cooler_key"]
    )
    packs = batteries.filter(~F.col("is_absent")).select(
        "battery_key", F.col("serial_number").alias("_pack")
    )
    keyed = lookup_or_absent(
        versioned, packs, F.col("battery_serial_number") == F.col("_pack"), "battery_key"
    )
    held = F.col("held_seconds")
    derived = keyed.select(
        *[
            F.col(name)
            for name in STATE_UPDATE.fieldNames()
            if name in keyed.columns
        ],
        date_key(F.col("updated_at")).alias("date_key"),
        jst_date(F.col("updated_at")).alias("partition_date"),
        watt_hours(F.col("discharge_watts"), held).alias("discharged_watt_hours"),
        watt_hours(F.col("charge_watts"), held).alias("charged_watt_hours"),
        watt_hours(F.col("input_watts"), held).alias("input_watt_hours"),
    )
    return conform(derived, STATE_UPDATE)


def star(fact: DataFrame, devices: DataFrame, batteries: DataFrame, days: DataFrame) -> DataFrame:
    """The fact with its dimensions' attributes, joined on the surrogate keys."""
    return (
        fact.join(
            devices.select("cooler_key", "model", "chip", "firmware_version"), "cooler_key", "left"
        )
        .join(
            batteries.select(
                "battery_key", F.col("serial_number").alias("battery_serial_number"), "is_absent"
            ),
            "battery_key",
            "left",
        )
        .join(days.drop("date"), "date_key", "left")
    )
