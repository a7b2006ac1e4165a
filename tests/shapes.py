"""Small frames in the shapes of the star."""

from __future__ import annotations

import datetime as dt

from coldmart import schemas

UTC = dt.timezone.utc
DAY0 = dt.datetime(2026, 5, 10, tzinfo=UTC)


def at(seconds: float, base: dt.datetime = DAY0) -> dt.datetime:
    return base + dt.timedelta(seconds=seconds)


def when(value: dt.datetime | None) -> float | None:
    """A collected (naive UTC) timestamp in seconds after DAY0."""
    return None if value is None else (value.replace(tzinfo=UTC) - DAY0).total_seconds()


def frame(spark, schema, rows: list[dict], **defaults):
    names = schema.fieldNames()
    return spark.createDataFrame(
        [tuple((defaults | row).get(n) for n in names) for row in rows], schema
    )


FACT_DEFAULTS = dict(
    serial_number="D1", cooler_key=5, battery_key=6, boot_id="boot-a", battery_state="discharging",
    external_input=False, setpoint_celsius=-18, interior_temperature_celsius=-18,
    state_of_charge_percent=70, input_watts=0, charge_watts=0, discharge_watts=0,
    usb_a_output_watts=0, usb_c_output_watts=0, held_seconds=300.0, ambient_temperature_celsius=21.0,
    ambient_humidity_percent=40.0, discharged_watt_hours=0.0, charged_watt_hours=0.0,
    input_watt_hours=0.0,
)


def fact(spark, rows: list[dict]):
    filled = []
    for number, row in enumerate(rows):
        row = FACT_DEFAULTS | {"state_update_key": f"k{number:04d}"} | row
        row["updated_at"] = at(row.pop("t"))
        row["partition_date"] = (row["updated_at"] + dt.timedelta(hours=9)).date()
        for energy, watts in (("discharged", "discharge"), ("charged", "charge"), ("input", "input")):
            row[f"{energy}_watt_hours"] = row[f"{watts}_watts"] * row["held_seconds"] / 3600
        filled.append(row)
    return frame(spark, schemas.STATE_UPDATE, filled)


SLOT_DEFAULTS = dict(
    serial_number="D1", covered_seconds=900.0, state_of_charge_start_percent=50,
    state_of_charge_end_percent=50, discharged_watt_hours=0.0, charged_watt_hours=0.0,
    input_watt_hours=0.0, usb_a_output_watt_hours=0.0, usb_c_output_watt_hours=0.0,
    external_input_ratio=0.0, charging_ratio=0.0, update_count=1,
)


def slots(spark, rows: list[dict]):
    filled = []
    for row in rows:
        row = SLOT_DEFAULTS | row
        started = row.pop("start")
        row["slot_started_at"] = started
        row["partition_date"] = (started + dt.timedelta(hours=9)).date()
        filled.append(row)
    return frame(spark, schemas.SNAPSHOT, filled)


PAYLOAD = dict(
    setpoint_celsius=-18, interior_temperature_celsius=4, display_unit="C", input_watts=0,
    usb_a_output_watts=0, usb_c_output_watts=0, charge_watts=0, discharge_watts=40,
    battery_state="discharging", state_of_charge_percent=80, protection_level="M",
    brightness="mid", serial_number="D1", battery_serial_number="P1",
)


def raw(spark, rows: list[dict]):
    """raw_cooler rows; ``payload`` is merged over a complete one, ``air`` is a temperature."""
    names = schemas.RAW_COOLER.fieldNames()
    out = []
    for row in rows:
        row = dict(boot_id="boot-a", ts_synced=True, type="cooler", model="everfrost", address="A1",
                   cmd="4402", frames=["00"], plain="00") | row
        if row.get("payload", {}) is not None:
            row["payload"] = tuple((PAYLOAD | row.get("payload", {})).values())
        air = row.pop("air", 20.0)
        row["environment"] = None if air is None else ("dht20", air, 50.0)
        out.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(out, schemas.RAW_COOLER)
