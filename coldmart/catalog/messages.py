"""Archived messages for the byte queries: a table written once per session and scale.

The bytes come from ``struct`` and a plain exclusive or, not from the functions that the queries
try. Reading the table is what the queries' time and plan show.
"""

from __future__ import annotations

import functools
import operator
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from coldmart.catalog import adapters
from coldmart.session import shared_folder, tune

# Fixed values of the wire format.
STATES = {"idle": 0, "charging": 1, "discharging": 2, "full": 3, "absent": 4}
HEADER, PATTERN_AND_COMMAND = b"\xff\x09", bytes.fromhex("03010f4402")

_written: dict[tuple[str, str], str] = {}


def _body(row: dict) -> bytes:
    """A state report; a quarter displays °F, some lack the unit or have an unknown state."""
    number, fahrenheit = row["event_id"], row["event_id"] % 4 == 0

    def shown(celsius: int) -> bytes:
        return struct.pack("<b", round(celsius * 9 / 5 + 32) if fahrenheit else celsius)

    pack = row["battery_serial_number"]
    pack = f"BATTERY-{pack.split('-')[-1]:>09}".encode() if pack else bytes(17)
    battery = b"\x06\x10\x11" + pack + bytes(10)
    battery += struct.pack("<BB", 9 if number % 17 == 0 else STATES[row["battery_state"]], row["state_of_charge_percent"])
    battery += struct.pack("<HH", row["charge_watts"], row["discharge_watts"])
    parameters = {
        0xA1: b"\x31",
        0xA2: b"\x00" + row["serial_number"].encode(),
        0xA6: b"\x01" + shown(row["setpoint_celsius"]),
        0xA7: b"\x01" + shown(row["interior_temperature_celsius"]),
        0xAD: b"\x01\x01",
        0xAF: b"\x01\x01",
        0xB0: b"\x01\x01" if fahrenheit else b"\x01\x00",
        0xB1: b"\x02" + struct.pack("<H", row["input_watts"]),
        0xD0: battery,
    }
    if number % 19 == 0:
        del parameters[0xB0]
    return b"".join(bytes([key, len(value)]) + value for key, value in parameters.items())


def _frame(payload: bytes, number: int) -> str:
    """One notification; every 37th states a wrong length, every 23rd a wrong checksum."""
    size = len(payload) + 10 + (number % 37 == 0)
    head = HEADER + struct.pack("<H", size) + PATTERN_AND_COMMAND + payload
    check = functools.reduce(operator.xor, head) ^ (number % 23 == 0)
    return (head + bytes([check])).hex().upper()


def _message(row: dict) -> tuple[int, str, str, list[str]]:
    """Every third message comes in two fragments, some of them out of order or alone."""
    number, body = row["event_id"], _body(row)
    parts = [body]
    if number % 3 == 0:
        parts = [b"\x12" + body[:50], b"\x22" + body[50:]]
        if number % 31 == 0:
            parts = parts[:1]
        elif number % 29 == 0:
            parts.reverse()
    plain = body[:-3] if number % 13 == 0 else body
    return number, "4402", plain.hex().upper(), [_frame(p, number) for p in parts]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id``, ``cmd``, ``plain`` and ``frames`` of every report of the ``events`` table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        tune(spark)
        _written[key] = f"{shared_folder(spark)}/coldmart/messages-{uuid.uuid4().hex}"
        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
        names = ["event_id", "cmd", "plain", "frames"]

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(zip(*map(_message, batch.to_pylist()))) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

        told = adapters.reports(adapters.events(spark, sf_dir)).select(
            "event_id", "serial_number", "battery_serial_number", "setpoint_celsius", "interior_temperature_celsius",
            "state_of_charge_percent", "input_watts", "charge_watts", "discharge_watts", "battery_state",
        )
        # Dealt out again, as the encoding costs more than the reading.
        dealt = told.repartition(spark.sparkContext.defaultParallelism, "event_id")
        built = dealt.mapInArrow(build, "event_id long, cmd string, plain string, frames array<string>")
        built.write.parquet(_written[key])
    return spark.read.parquet(_written[key])
