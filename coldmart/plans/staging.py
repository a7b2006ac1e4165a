"""Raw records to staged reports and handshakes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.functions import corrected_at, string_key
from coldmart.operators.asof import clock_anchor_join
from coldmart.operators.dedup import one_copy
from coldmart.operators.holds import held_seconds
from coldmart.schemas import REQUIRED_PAYLOAD

REPORT_KEYS = ("boot_id", "uptime_seconds")


def is_complete() -> Column:
    """A decoded report with its key, its time and every required field."""
    needed = ["payload", *REPORT_KEYS, "ts", *[f"payload.{name}" for name in REQUIRED_PAYLOAD]]
    return reduce(and_, [F.col(name).isNotNull() for name in needed])


def complete_reports(raw_cooler: DataFrame) -> DataFrame:
    return raw_cooler.filter(is_complete()).select(
        "boot_id", "uptime_seconds", "ts", "ts_synced", "model", "address", "payload", "environment"
    )


def clock_reference(raw_cooler: DataFrame, raw_events: DataFrame) -> DataFrame:
    """The first record of each boot made with a synced clock, over both streams."""
    columns = ["boot_id", "ts", "uptime_seconds", "ts_synced"]
    both = raw_cooler.select(*columns).unionByName(raw_events.select(*columns))
    usable = (
        F.col("ts_synced")
        & F.col("boot_id").isNotNull()
        & F.col("ts").isNotNull()
        & F.col("uptime_seconds").isNotNull()
    )
    return (
        both.filter(usable)
        .groupBy("boot_id")
        .agg(F.min(F.struct("uptime_seconds", "ts")).alias("anchor"))
        .select(
            "boot_id",
            F.col("anchor.ts").alias("reference_ts"),
            F.col("anchor.uptime_seconds").alias("reference_uptime_seconds"),
        )
    )


def repaired(df: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name`` holding the instant each record was really made."""
    return (
        clock_anchor_join(df, anchors)
        .withColumn(
            name,
            corrected_at(
                F.col("ts"),
                F.col("uptime_seconds"),
                F.col("ts_synced"),
                F.col("reference_ts"),
                F.col("reference_uptime_seconds"),
            ),
        )
        .drop("reference_ts", "reference_uptime_seconds")
    )


def state_update_key() -> Column:
    return string_key(F.concat_ws("/", "boot_id", F.col("uptime_seconds").cast("string")))


def flatten_report(df: DataFrame) -> DataFrame:
    # Fields of the payload that keep their names.
    plain = [
        "serial_number", "battery_serial_number", "display_unit", "protection_level",
        "brightness", "battery_state", "setpoint_celsius", "interior_temperature_celsius",
        "state_of_charge_percent", "input_watts", "usb_a_output_watts", "usb_c_output_watts",
        "charge_watts", "discharge_watts",
    ]
    return df.select(
        state_update_key().alias("state_update_key"),
        "boot_id",
        "uptime_seconds",
        "updated_at",
        F.col("ts").alias("updated_at_raw"),
        (F.col("updated_at") != F.col("ts")).alias("timestamp_corrected"),
        "model",
        "address",
        "held_seconds",
        *[F.col(f"payload.{name}").alias(name) for name in plain],
        (F.col("payload.input_watts") > 0).alias("external_input"),
        F.col("environment.temperature_celsius").alias("ambient_temperature_celsius"),
        F.col("environment.humidity_percent").alias("ambient_humidity_percent"),
    )


def state_updates(
    raw_cooler: DataFrame, anchors: DataFrame, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """One flat row per state report: one copy, repaired clock, held seconds."""
    complete = complete_reports(raw_cooler)
    kept = repaired(one_copy(complete, REPORT_KEYS, order), anchors, "updated_at")
    return flatten_report(held_seconds(kept, copies=complete))


def negotiations(
    raw_events: DataFrame, anchors: DataFrame, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """Handshakes that name a serial number, one copy each, with repaired clocks."""
    shaken = raw_events.filter(
        (F.col("kind") == "ble_negotiated")
        & F.col("boot_id").isNotNull()
        & F.col("uptime_seconds").isNotNull()
        & F.col("ts").isNotNull()
        & F.col("serial").isNotNull()
    ).select(
        "boot_id", "uptime_seconds", "ts", "ts_synced", "serial", "address", "chip", "firmware"
    )
    return repaired(one_copy(shaken, REPORT_KEYS, order), anchors, "negotiated_at").select(
        "boot_id",
        "uptime_seconds",
        "negotiated_at",
        F.col("serial").alias("serial_number"),
        F.col("address").alias("bluetooth_address"),
        "chip",
        F.col("firmware").alias("firmware_version"),
    )
