"""Declared types of the raw streams, the star and the signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
    "STRINGS": T.ArrayType(T.StringType()),
}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """``name TYPE, name TYPE, ...`` as a struct; works before there is a session."""
    types = _TYPES | nested
    fields = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, types[kind]) for name, kind in fields])


PAYLOAD = _struct(
    "setpoint_celsius BIGINT, interior_temperature_celsius BIGINT, display_unit STRING, "
    "input_watts BIGINT, usb_a_output_watts BIGINT, usb_c_output_watts BIGINT, "
    "charge_watts BIGINT, discharge_watts BIGINT, battery_state STRING, "
    "state_of_charge_percent BIGINT, protection_level STRING, brightness STRING, "
    "serial_number STRING, battery_serial_number STRING"
)
ENVIRONMENT = _struct("sensor STRING, temperature_celsius DOUBLE, humidity_percent DOUBLE")

_STAMP = "ts TIMESTAMP, uptime_seconds DOUBLE, boot_id STRING, ts_synced BOOLEAN, type STRING"

RAW_COOLER = _struct(
    f"{_STAMP}, model STRING, address STRING, pattern STRING, cmd STRING, "
    "frames STRINGS, plain STRING, payload PAYLOAD, environment ENVIRONMENT, error STRING",
    PAYLOAD=PAYLOAD,
    ENVIRONMENT=ENVIRONMENT,
)
RAW_EVENTS = _struct(
    f"{_STAMP}, kind STRING, address STRING, name STRING, error STRING, variant STRING, "
    "mtu BIGINT, chip STRING, firmware STRING, serial STRING, secret STRING, cmd STRING, "
    "sensor STRING, uploaded_chunk_count BIGINT, uploaded_line_count BIGINT, "
    "command_id STRING, source STRING, reason STRING, setting STRING, value STRING, "
    "frames STRINGS, count BIGINT, expected BIGINT, received BIGINT"
)
STREAMS = {"cooler": RAW_COOLER, "events": RAW_EVENTS}

# Every required field of a decoded body; the battery serial alone may be missing.
REQUIRED_PAYLOAD = [f.name for f in PAYLOAD.fields if f.name != "battery_serial_number"]

# The enumerations of the raw contract.
BATTERY_STATES = ("idle", "charging", "discharging", "full", "absent")
DISPLAY_UNITS = ("C", "F")
PROTECTION_LEVELS = ("L", "M", "H")
BRIGHTNESS_LEVELS = ("low", "mid", "high")
TRIGGERS = ("start_up", "setpoint_change", "rise")
OUTCOMES = ("reached", "interrupted")

STATE_UPDATE = _struct(
    "state_update_key STRING, serial_number STRING, cooler_key BIGINT, battery_key BIGINT, "
    "date_key BIGINT, partition_date DATE, updated_at TIMESTAMP, updated_at_raw TIMESTAMP, "
    "timestamp_corrected BOOLEAN, boot_id STRING, uptime_seconds DOUBLE, "
    "external_input BOOLEAN, battery_state STRING, display_unit STRING, "
    "protection_level STRING, brightness STRING, setpoint_celsius BIGINT, "
    "interior_temperature_celsius BIGINT, state_of_charge_percent BIGINT, "
    "input_watts BIGINT, usb_a_output_watts BIGINT, usb_c_output_watts BIGINT, "
    "charge_watts BIGINT, discharge_watts BIGINT, ambient_temperature_celsius DOUBLE, "
    "ambient_humidity_percent DOUBLE, held_seconds DOUBLE, discharged_watt_hours DOUBLE, "
    "charged_watt_hours DOUBLE, input_watt_hours DOUBLE"
)
SNAPSHOT = _struct(
    "serial_number STRING, slot_key STRING, cooler_key BIGINT, battery_key BIGINT, "
    "date_key BIGINT, partition_date DATE, hour_of_day BIGINT, minute_of_hour BIGINT, "
    "slot_started_at TIMESTAMP, state_of_charge_start_percent BIGINT, "
    "state_of_charge_end_percent BIGINT, state_of_charge_delta_percent BIGINT, "
    "discharged_watt_hours DOUBLE, charged_watt_hours DOUBLE, input_watt_hours DOUBLE, "
    "usb_a_output_watt_hours DOUBLE, usb_c_output_watt_hours DOUBLE, "
    "ambient_temperature_celsius DOUBLE, ambient_humidity_percent DOUBLE, "
    "interior_temperature_celsius DOUBLE, setpoint_celsius DOUBLE, "
    "external_input_ratio DOUBLE, charging_ratio DOUBLE, covered_seconds DOUBLE, "
    "update_count BIGINT"
)
PULLDOWN = _struct(
    "serial_number STRING, pulldown_key STRING, cooler_key BIGINT, battery_key BIGINT, "
    "date_key BIGINT, partition_date DATE, started_at TIMESTAMP, reached_at TIMESTAMP, "
    "ended_at TIMESTAMP, trigger STRING, outcome STRING, "
    "interior_temperature_start_celsius BIGINT, setpoint_celsius BIGINT, "
    "state_of_charge_start_percent BIGINT, state_of_charge_delta_percent BIGINT, "
    "duration_seconds DOUBLE, elapsed_seconds DOUBLE, discharged_watt_hours DOUBLE, "
    "charged_watt_hours DOUBLE, ambient_temperature_celsius DOUBLE, "
    "external_input_ratio DOUBLE, covered_seconds DOUBLE, update_count BIGINT"
)
COOLER = _struct(
    "cooler_key BIGINT, serial_number STRING, model STRING, bluetooth_address STRING, "
    "chip STRING, firmware_version STRING, valid_from TIMESTAMP, valid_to TIMESTAMP, "
    "is_current BOOLEAN"
)
BATTERY = _struct(
    "battery_key BIGINT, serial_number STRING, is_absent BOOLEAN, first_seen_at TIMESTAMP"
)
CALENDAR = _struct(
    "date_key BIGINT, date DATE, day_of_week INT, iso_week INT, iso_year INT, month INT, "
    "is_weekend BOOLEAN, is_japanese_holiday BOOLEAN"
)
SIGNAL = _struct(
    "event STRING, run_id STRING, published_at TIMESTAMP, rows_arrived BIGINT, "
    "build_passed BOOLEAN, contract_id STRING, passed BOOLEAN, failed_checks STRINGS"
)

MARTS = {
    "fact_cooler_state_update": STATE_UPDATE,
    "fact_cooler_snapshot": SNAPSHOT,
    "fact_cooler_pulldown": PULLDOWN,
    "dim_cooler": COOLER,
    "dim_battery": BATTERY,
    "dim_date": CALENDAR,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in exactly the declared columns, order and types; a missing column raises."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if missing or extra:
        raise ValueError(f"schema mismatch: missing {missing}, undeclared {extra}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
