from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from coldmart.plans import dims
from coldmart.sources.seeds import UNITS, band_rows, read_seed
from coldmart.operators.bands import band, with_band
from shapes import at, when

SHAKEN = (
    "serial_number STRING, bluetooth_address STRING, chip STRING, firmware_version STRING, "
    "negotiated_at TIMESTAMP"
)
SEEN = "serial_number STRING, address STRING, model STRING, updated_at TIMESTAMP"


def versions(spark, shaken, seen):
    rows = dims.device_versions(
        spark.createDataFrame([("D1", a, "chip", f, at(t)) for a, f, t in shaken], SHAKEN),
        spark.createDataFrame([("D1", a, "everfrost", at(t)) for a, t in seen], SEEN),
    ).collect()
    return sorted(
        ((r["firmware_version"], when(r["valid_from"]), when(r["valid_to"]), r["is_current"], r["cooler_key"], r["bluetooth_address"])
         for r in rows),
        key=lambda v: (v[1], v[0] is not None, v[2] is None),
    )


def windows(rows):
    return [r[:4] for r in rows]


def test_a_new_firmware_closes_the_row_before_it_and_a_repeat_changes_nothing(spark):
    got = versions(spark, [("A", "1", 100), ("A", "2", 500), ("A", "2", 900)], [("A", 20)])
    assert windows(got) == [(None, 20, 100, False), ("1", 100, 500, False), ("2", 500, None, True)]


def test_keys_do_not_move_when_an_earlier_handshake_arrives_later(spark):
    first = versions(spark, [("A", "1", 1000)], [("A", 1060)])
    later = versions(spark, [("A", "1", 1000), ("A", "1", 400)], [("A", 1060), ("A", 460)])
    assert windows(first) == [(None, 1000, 1000, False), ("1", 1000, None, True)]
    assert windows(later) == [(None, 400, 400, False), ("1", 400, None, True)]
    assert [r[4] for r in first] == [r[4] for r in later]


def test_the_unknown_member_lasts(spark):
    alone = versions(spark, [], [("A", 60)])
    shaken = versions(spark, [("A", "1", 10)], [("A", 60), ("B", 90)])
    only = versions(spark, [("A", "1", 10)], [])
    assert windows(alone) == [(None, 60, None, True)]
    assert windows(shaken) == [(None, 10, 10, False), ("1", 10, None, True)]
    assert windows(only) == [(None, 10, 10, False), ("1", 10, None, True)]
    assert alone[0][4] == shaken[0][4] == only[0][4]
    assert shaken[0][5] == "B"


def test_returning_to_an_old_firmware_is_a_row_and_a_key_of_its_own(spark):
    got = versions(spark, [("A", "1", 10), ("A", "2", 20), ("A", "1", 30)], [("A", 5)])
    assert windows(got)[1:] == [("1", 10, 20, False), ("2", 20, 30, False), ("1", 30, None, True)]
    assert len({r[4] for r in got}) == 4


def test_an_unrecorded_address_is_not_a_new_version(spark):
    got = versions(spark, [(None, "1", 10), ("A", "1", 20)], [("A", 5)])
    assert windows(got) == [(None, 5, 10, False), ("1", 10, None, True)]


def test_history_does_not_depend_on_chunks(spark):
    rows = [("D", n * 97, str(n * 7 % 3)) for n in range(60)]
    df = spark.createDataFrame([(d, at(t), v) for d, t, v in rows], "d STRING, t TIMESTAMP, v STRING")
    results = [
        sorted(map(tuple, dims.version_changes(df, "d", "t", "v", chunk).collect()))
        for chunk in (60, 1000, 10**6)
    ]
    assert results[0] == results[1] == results[2]
    assert [r[-1] for r in results[0] if r[2] == "0"] == list(range(1, 21))


def test_batteries_and_the_absent_one(spark):
    seen = spark.createDataFrame(
        [("P1", at(9)), ("P1", at(3)), (None, at(1)), ("P2", at(7))],
        "battery_serial_number STRING, updated_at TIMESTAMP",
    )
    rows = {r["serial_number"]: r for r in dims.battery_dim(seen).collect()}
    assert when(rows["P1"]["first_seen_at"]) == 3.0 and when(rows["P2"]["first_seen_at"]) == 7.0
    assert rows[None]["battery_key"] == 0 and rows[None]["is_absent"]
    assert min(rows["P1"]["battery_key"], rows["P2"]["battery_key"]) >= 1


def test_the_calendar_is_iso_and_knows_holidays(spark):
    days = {r["date"]: r for r in dims.calendar(spark).collect()}
    assert len(days) == 730
    edge = days[dt.date(2027, 1, 1)]
    assert (edge["iso_year"], edge["iso_week"], edge["day_of_week"]) == (2026, 53, 5)
    assert edge["is_japanese_holiday"] and not edge["is_weekend"]
    sunday = days[dt.date(2026, 5, 10)]
    assert sunday["is_weekend"] and sunday["day_of_week"] == 7 and not sunday["is_japanese_holiday"]
    assert sum(d["is_japanese_holiday"] for d in days.values()) == 35


def test_bands_are_half_open_and_null_has_none(spark):
    values = spark.createDataFrame([(v,) for v in (None, -1.0, 19.99, 20.0, 50.0, 95.0, 500.0)], "v DOUBLE")
    out = with_band(values, F.col("v"), band(spark, "state_of_charge"), "b").collect()
    assert [r["b_key"] for r in out] == [None, 1, 1, 2, 3, 5, 5]
    labels = [row[2] for row in band_rows("input_power")]
    assert labels == ["0 W", "< 10 W", "10..40 W", "40..70 W", ">= 70 W"]
    assert {n: band(spark, n).count() for n in UNITS}["ambient_temperature"] == 9


def test_any_number_of_bands_will_do(spark):
    edges = [-(2.0**40), -7.5, -1.0, -0.25, 0.0, 0.3, 1.0, 2.0, *[3.0 + k / 4 for k in range(1500)], 2.0**70]
    bounds = list(zip([None, *edges], [*edges, None]))
    bands = spark.createDataFrame(
        [(k, str(k), a, b, k) for k, (a, b) in enumerate(bounds)],
        "band_key BIGINT, label STRING, lower DOUBLE, upper DOUBLE, sort_order BIGINT",
    )
    asked = [None, float("-inf"), -1e300, -8.0, -7.5, -0.5, 0.0, 0.29, 0.3, 1.5, 100.1, 1e9, 2.0**70, float("inf")]
    values = spark.createDataFrame([(k, v) for k, v in enumerate(asked)], "n INT, v DOUBLE")
    got = {r["n"]: r["b_key"] for r in with_band(values, F.col("v"), bands, "b").collect()}
    for k, v in enumerate(asked):
        want = None if v is None else sum(e <= v for e in edges)
        assert got[k] == want, v


def test_a_seed_can_be_read_from_a_folder(spark, tmp_path):
    (tmp_path / "band_watts.csv").write_text(
        "band,band_key,label,lower_watts,upper_watts,sort_order\nx,1,low,,5,1\nx,2,high,5,,2\n"
    )
    rows = read_seed(spark, "band_watts", str(tmp_path)).collect()
    assert [(r["lower_watts"], r["upper_watts"]) for r in rows] == [(None, 5.0), (5.0, None)]
