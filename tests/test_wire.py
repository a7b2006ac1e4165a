from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from coldmart.functions import parameters, wire
from coldmart.operators.wire import audit_frames, backfill_payload, explode_tlv
from coldmart.schemas import PAYLOAD

RAW = "cmd STRING, plain STRING, frames ARRAY<STRING>"


def tlv(key: int, body: bytes) -> bytes:
    return bytes([key, len(body)]) + body


def battery(serial=b"PACK-000000000001", usb=(0, 0), state=2, soc=81, charge=0, discharge=300) -> bytes:
    body = b"\x06\x10\x11" + serial + bytes(4) + struct.pack("<HH", *usb) + bytes(2)
    return body + bytes([state, soc]) + struct.pack("<HH", charge, discharge)


def body(prefix=b"", drop=(), **given) -> bytes:
    parts = {
        0xA1: b"\x31", 0xA2: b"\x00DEVICE-1", 0xA6: b"\x01\xec", 0xA7: b"\x01\x05", 0xAD: b"\x01\x02",
        0xAF: b"\x01\x00", 0xB0: b"\x01\x00", 0xB1: b"\x02\x2c\x01", 0xD0: battery(),
    } | {int(k, 16): v for k, v in given.items()}
    return prefix + b"".join(tlv(k, v) for k, v in parts.items() if k not in drop)


def built(payload: bytes) -> bytes:
    head = b"\xff\x09" + struct.pack("<H", len(payload) + 10) + bytes.fromhex("03010f4402") + payload
    check = 0
    for byte in head:
        check ^= byte
    return head + bytes([check])


def decode(spark, plain, cmd="4402"):
    text = plain.hex() if isinstance(plain, bytes) else plain
    df = spark.createDataFrame([(cmd, text, ["ff"])], RAW).withColumn("payload", F.lit(None).cast(PAYLOAD))
    row = backfill_payload(df).first()
    return (row["payload"].asDict() if row["payload"] else None), row["payload_error"]


def test_a_state_report_is_read(spark):
    payload, error = decode(spark, body())
    assert error is None
    assert payload == dict(
        setpoint_celsius=-20, interior_temperature_celsius=5, display_unit="C", input_watts=300,
        usb_a_output_watts=0, usb_c_output_watts=0, charge_watts=0, discharge_watts=300, battery_state="discharging",
        state_of_charge_percent=81, protection_level="L", brightness="high", serial_number="DEVICE-1",
        battery_serial_number="PACK-000000000001",
    )
    payload, _ = decode(spark, body(prefix=b"\x00", D0=battery(bytes(17), (7, 513), 4, 0, 65535, 0)), "4840")
    assert payload["battery_serial_number"] is None and payload["battery_state"] == "absent"
    assert (payload["usb_a_output_watts"], payload["usb_c_output_watts"], payload["charge_watts"]) == (7, 513, 65535)


def test_fahrenheit_becomes_celsius_and_back(spark):
    payload, _ = decode(spark, body(A6=b"\x01\xfc", A7=b"\x01\x29", B0=b"\x01\x01"))
    assert (payload["setpoint_celsius"], payload["interior_temperature_celsius"], payload["display_unit"]) == (-20, 5, "F")
    degrees = spark.range(-20, 21).select(F.col("id").alias("c"))
    shown = wire.shown_degrees(F.col("c"), F.lit("F"))
    assert degrees.filter(wire.celsius(shown, F.lit("F")) != F.col("c")).count() == 0
    assert degrees.filter(wire.shown_degrees(F.col("c"), F.lit("C")) != F.col("c")).count() == 0


@pytest.mark.parametrize(
    "plain, error",
    [
        (None, "no_body"), ("zz", "not_hex"), ("abc", "not_hex"), (body()[:-1], "parameter_past_end"),
        (body() + b"\xb0", "truncated_parameter"), (body(drop=[0xB0]), "missing_B0"), (body(drop=[0xD0]), "missing_D0"),
        (body(D0=battery()[:-1]), "short_battery"), (body(A6=b""), "no_value"), (body(B0=b"\x01\x07"), "unknown_display_unit"),
        (body(D0=battery(state=9)), "unknown_battery_state"), (body(AF=b"\x01\x03"), "unknown_protection_level"),
        (body(AD=b"\x01\x03"), "unknown_brightness"), (b"", "missing_A2"),
    ],
)
def test_what_cannot_be_read_says_why(spark, plain, error):
    assert decode(spark, plain) == (None, error)


def test_a_repeated_parameter_replaces_the_first_and_a_lone_byte_is_a_value(spark):
    payload, _ = decode(spark, body() + tlv(0xA7, b"\x01\xff") + tlv(0xB1, b"\x09"))
    assert (payload["interior_temperature_celsius"], payload["input_watts"]) == (-1, 9)


def test_other_commands_keep_what_they_have(spark):
    df = spark.createDataFrame([("4489", body().hex(), ["ff"])], RAW).withColumn(
        "payload", F.named_struct(*[x for f in PAYLOAD.fields for x in (F.lit(f.name), F.lit("1").cast(f.dataType))])
    )
    row = backfill_payload(df).first()
    assert row["payload"]["serial_number"] == "1" and row["payload_error"] is None


def test_parameters_of_any_message_are_laid_out(spark):
    plain = b"\x00" + b"".join([tlv(0xA1, b"\x31"), tlv(0xA2, b"\x00h\xc3"), tlv(0xA3, b"\x05" + struct.pack("<f", -2.5)),
                                tlv(0xA4, b"\x02\xfe\xff"), tlv(0xA5, b"\x01\x07"), tlv(0xA6, b""), tlv(0xA7, b"ESP32")])
    df = spark.createDataFrame([("0829", plain.hex(), None), ("0829", None, [built(plain).hex()]), ("0829", "a105aa", None)], RAW)
    rows = explode_tlv(df).collect()
    assert [r["error"] for r in rows if r["key"] is None] == ["parameter_past_end"]
    rows = [r for r in rows if r["key"] is not None]
    assert len(rows) == 14 and all(r["prefix"] for r in rows)
    sealed = {r["key"]: r for r in rows if r["plain"] is None}
    clear = {r["key"]: r for r in rows if r["plain"] is not None}
    assert {k: r["hex"] for k, r in sealed.items()} == {k: r["hex"] for k, r in clear.items()}
    assert (clear["A1"]["type_byte"], clear["A1"]["uint_le"], clear["A1"]["ascii"]) == (None, "49", "1")
    assert clear["A2"]["text"] == "h�" and clear["A2"]["ascii"] is None
    assert clear["A3"]["f32"] == -2.5
    assert (clear["A4"]["i16"], clear["A4"]["value_uint_le"], clear["A4"]["int_le"]) == (-2, "65534", "-510")
    assert (clear["A5"]["u8"], clear["A6"]["length"], clear["A6"]["uint_le"]) == (7, 0, "0")
    assert (clear["A7"]["ascii"], clear["A7"]["type_byte"]) == ("ESP32", "45")


@pytest.mark.parametrize(
    "value",
    [b"", b"\x01", b"\xff", bytes(7), b"\x80" * 7, b"\x01" * 8, b"\xff" * 8, b"\x00" * 20 + b"\x80", bytes(range(250)), b"\xfe" * 255],
)
def test_numbers_of_any_length_are_read(spark, value):
    df = spark.createDataFrame([("x", tlv(0xA3, value).hex(), None)], RAW)
    (row,) = explode_tlv(df).collect()
    want = [int.from_bytes(value, "little"), int.from_bytes(value, "little", signed=True)]
    assert [int(row["uint_le"]), int(row["int_le"])] == want
    if len(value) > 1:
        assert int(row["value_uint_le"]) == int.from_bytes(value[1:], "little")


def test_texts_are_utf8_and_empty_bodies_are_looked_up_in_frames(spark):
    texts = ["é", "冷蔵"]
    spoilt = [b"\x00a\xff\xe3\x81b", b"\x00\xf0\x9f\x98"]
    bodies = [tlv(0xA2, b"\x00" + t.encode()) for t in texts] + [tlv(0xA2, b) for b in spoilt]
    df = spark.createDataFrame([("x", "", [built(b).hex()]) for b in bodies], RAW)
    got = [r["text"] for r in explode_tlv(df).collect()]
    assert got == texts + [b[1:].decode("utf-8", "replace") for b in spoilt]
    bad = spark.createDataFrame([("x", "zz", None), ("x", None, None), ("x", "", []), ("x", None, ["00"])], RAW)
    assert [r["error"] for r in explode_tlv(bad).collect()] == ["not_hex", "no_frames", "no_frames", "not_a_frame"]


def test_a_long_number_in_a_report_is_read_or_named(spark):
    payload, _ = decode(spark, body(B1=b"\x02\x2c\x01" + bytes(9)))
    assert payload["input_watts"] == 300
    payload, _ = decode(spark, body(A6=b"\x01\xec" + b"\xff" * 9))
    assert payload["setpoint_celsius"] == -20
    assert decode(spark, body(B1=b"\x02" + b"\x01" * 9)) == (None, "number_out_of_range")


def test_infinities_are_no_reading(spark):
    df = spark.createDataFrame(
        [("x", tlv(0xA3, b"\x05" + struct.pack("<f", v)).hex(), None) for v in (float("inf"), float("nan"), 0.0, 1e-45, 3.0e38)], RAW)
    got = [r["f32"] for r in explode_tlv(df).collect()]
    assert got[:3] == [None, None, 0.0]
    assert got[3:] == [struct.unpack("<f", struct.pack("<f", v))[0] for v in (1e-45, 3.0e38)]


def fragments(*order, total=3):
    pieces = [b"one", b"two", b"three"]
    return [built(bytes([n << 4 | total]) + pieces[n - 1]).hex() for n in order]


@pytest.mark.parametrize(
    "frames, status",
    [
        ([built(b"abc").hex()], "ok"), (fragments(1, 2, 3), "ok"), (fragments(1, 3, 2), "out_of_order"),
        (fragments(2, 3), "out_of_order"), (fragments(1, 2), "incomplete"), ([], "no_frames"), (None, "no_frames"),
        (["0001"], "not_a_frame"), (["xyz"], "not_a_frame"), ([built(b"abc").hex()[:-4]], "bad_length"),
        ([built(b"abc").hex()[:-2] + "00"], "bad_checksum"), ([fragments(1)[0], built(b"").hex()], "empty_fragment"),
    ],
)
def test_frames_are_audited(spark, frames, status):
    (row,) = audit_frames(spark.createDataFrame([("4402", None, frames)], RAW)).collect()
    assert (row["status"], row["messages"], row["notifications"]) == (status, 1, len(frames or []))


def walked(message: bytes):
    """Parameters of a message, one after another, or what is wrong with it."""
    at, out = (1 if message[:1] == b"\0" else 0), []
    while at < len(message):
        if at + 2 > len(message):
            return "truncated_parameter"
        key, count = message[at], message[at + 1]
        if at + 2 + count > len(message):
            return "parameter_past_end"
        out.append((f"{key:02X}", message[at + 2 : at + 2 + count]))
        at += 2 + count
    return out


def test_many_messages_at_once_are_read_as_one_by_one(spark):
    of = random.Random(7)

    def message():
        sound = b"".join(tlv(of.randrange(256), of.randbytes(of.choice([0, 1, 2, 3, 5, 9, 40, 255]))) for _ in range(of.randrange(6)))
        return of.choice([b"", b"\0"]) + sound[: len(sound) - of.choice([0, 0, 0, 1, 3])]

    bodies = [message() for _ in range(600)] + [b"\0", b"", tlv(1, b"") * 3000]
    df = spark.createDataFrame([(str(k), b.hex(), []) for k, b in enumerate(bodies)], RAW).repartition(3)
    rows = explode_tlv(df, carry=["cmd"]).collect()
    assert rows[0].asDict().keys() == {"cmd", *parameters_names()}
    got = {}
    for r in rows:
        got.setdefault(int(r["cmd"]), []).append(r)
    for k, body_ in enumerate(bodies):
        want, have = walked(body_), got.get(k, [])
        if not body_:
            assert [r["error"] for r in have] == ["no_frames"]
        elif isinstance(want, str):
            assert [(r["error"], r["key"], r["hex"]) for r in have] == [(want, None, None)]
        else:
            assert [(r["key"], r["hex"], int(r["uint_le"]), int(r["int_le"])) for r in have] == [
                (key, v.hex().upper(), int.from_bytes(v, "little"), int.from_bytes(v, "little", signed=True)) for key, v in want
            ]
            assert all(r["prefix"] == (body_[:1] == b"\0") for r in have)


def parameters_names():
    return [part.split()[0] for part in parameters.READINGS.split(", ")]


def test_an_archive_without_messages_has_no_parameters(spark):
    df = spark.createDataFrame([], RAW)
    assert explode_tlv(df).collect() == []
    assert explode_tlv(df).columns == ["cmd", "plain", "frames", *parameters_names()]
