from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from coldmart import schemas
from coldmart.operators.dedup import copies_disagree, one_copy
from coldmart.operators.holds import held_seconds
from coldmart.plans import staging
from shapes import at, frame, raw, when

ANCHOR = "boot_id STRING, reference_ts TIMESTAMP, reference_uptime_seconds DOUBLE"


def staged(spark, rows, anchors=()):
    out = staging.state_updates(raw(spark, rows), spark.createDataFrame(list(anchors), ANCHOR))
    return {r["uptime_seconds"]: r for r in out.collect()}


def test_a_state_holds_until_the_next_report_but_not_over_a_silence(spark):
    rows = staged(
        spark,
        [dict(uptime_seconds=50.0, ts=at(0), cmd="4840"), dict(uptime_seconds=95.0, ts=at(45)),
         dict(uptime_seconds=4000.0, ts=at(3950))],
    )
    assert {u: r["held_seconds"] for u, r in rows.items()} == {50.0: 45.0, 95.0: 600.0, 4000.0: 600.0}


def test_an_unsynced_clock_is_repaired_from_the_boots_anchor(spark):
    rows = staged(
        spark,
        [dict(uptime_seconds=10.5, ts=at(-1e7), ts_synced=False),
         dict(uptime_seconds=70.0, ts=at(0)),
         dict(uptime_seconds=80.0, ts=at(-1e7), ts_synced=None)],
        [("boot-a", at(0), 70.0)],
    )
    assert [when(rows[u]["updated_at"]) for u in (10.5, 70.0, 80.0)] == [-59.5, 0.0, 10.0]
    assert [rows[u]["timestamp_corrected"] for u in (10.5, 70.0, 80.0)] == [True, False, True]
    assert when(rows[10.5]["updated_at_raw"]) == -1e7


def test_a_boot_that_never_synced_keeps_its_time_and_its_key(spark):
    report = dict(uptime_seconds=10.0, ts=at(-1e7), ts_synced=False)
    alone = staged(spark, [report])[10.0]
    later = staged(spark, [report], [("boot-a", at(0), 70.0)])[10.0]
    assert when(alone["updated_at"]) == -1e7 and not alone["timestamp_corrected"]
    assert later["timestamp_corrected"]
    assert alone["state_update_key"] == later["state_update_key"]


def test_incomplete_reports_are_dropped_but_a_missing_battery_is_not(spark):
    rows = staged(
        spark,
        [dict(uptime_seconds=1.0, ts=at(1), payload=dict(brightness=None)),
         dict(uptime_seconds=2.0, ts=at(2), payload=None),
         dict(uptime_seconds=3.0, ts=None),
         dict(uptime_seconds=4.0, ts=at(4), payload=dict(battery_serial_number=None)),
         dict(uptime_seconds=5.0, ts=at(5), air=None)],
    )
    assert sorted(rows) == [4.0, 5.0]
    assert rows[5.0]["ambient_temperature_celsius"] is None


def test_the_same_copy_wins_whatever_order_copies_arrive_in(spark):
    copies = [
        dict(uptime_seconds=1.0, ts=at(0), air=air, payload=dict(state_of_charge_percent=soc))
        for air in (20.5, 19.25, None) for soc in (9, 80, 100)
    ]
    winners = set()
    for seed in range(4):
        random.Random(seed).shuffle(copies)
        kept = staged(spark, copies)[1.0]
        winners.add((kept["state_of_charge_percent"], kept["ambient_temperature_celsius"]))
    # The smallest JSON text: 100 sorts before 80 and 9, and null before an object.
    assert winners == {(100, None)}


def test_one_copy_can_be_ordered_by_columns(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z")], "k STRING, n INT, v STRING")
    assert sorted(map(tuple, one_copy(df, ["k"], ["n"]).collect()), key=str) == [("a", 1, "y"), ("b", None, "z")]


def test_disagreeing_copies_are_found_by_key(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("c", "x"), (None, "1"), (None, "2")],
        "k STRING, v STRING",
    )
    assert [r["k"] for r in copies_disagree(df, ["k"], F.col("v")).collect()] == ["b"]


@pytest.mark.parametrize("chunk", [1, 7, 10**6])
def test_holds_do_not_depend_on_where_a_boot_is_cut(spark, chunk):
    rng = random.Random(7)
    rows, want = [], {}
    for boot in ("a", "b"):
        times = sorted({round(rng.uniform(0, 9000), 1) for _ in range(60)} | {600.0, 1200.0, 1800.0})
        for here, there in zip(times, [*times[1:], None]):
            rows.append((boot, "A", here))
            want[boot, here] = 600.0 if there is None else min(600.0, there - here)
    df = spark.createDataFrame(rows, "boot_id STRING, address STRING, uptime_seconds DOUBLE")
    got = held_seconds(df, rows=chunk).collect()
    assert {(r["boot_id"], r["uptime_seconds"]): r["held_seconds"] for r in got} == want


def test_holds_of_long_links_cut_at_places_from_their_copies(spark):
    df = spark.range(6000).selectExpr("'a' as boot_id", "'A' as address", "id * 1.5D as uptime_seconds")
    got = held_seconds(df, rows=500, copies=df.unionByName(df.filter("uptime_seconds < 900")))
    assert got.groupBy("held_seconds").count().orderBy("held_seconds").collect() == [(1.5, 5999), (600.0, 1)]


def test_the_anchor_is_the_first_synced_record_of_either_stream(spark):
    cooler = raw(spark, [dict(uptime_seconds=30.0, ts=at(30)), dict(uptime_seconds=5.0, ts=at(-9), ts_synced=False)])
    events = frame(
        spark,
        schemas.RAW_EVENTS,
        [dict(boot_id="boot-a", uptime_seconds=20.0, ts=at(20), ts_synced=True),
         dict(boot_id="boot-b", uptime_seconds=1.0, ts=at(1), ts_synced=None)],
    )
    (row,) = staging.clock_reference(cooler, events).collect()
    assert (row["boot_id"], when(row["reference_ts"]), row["reference_uptime_seconds"]) == ("boot-a", 20.0, 20.0)


def test_handshakes_need_a_serial_and_a_time(spark):
    base = dict(kind="ble_negotiated", boot_id="boot-a", uptime_seconds=1.0, ts=at(1), ts_synced=True, serial="D1")
    events = frame(
        spark,
        schemas.RAW_EVENTS,
        [base, base, base | dict(serial=None, uptime_seconds=2.0), base | dict(ts=None, uptime_seconds=3.0),
         base | dict(kind="ble_connected", uptime_seconds=4.0)],
    )
    out = staging.negotiations(events, spark.createDataFrame([], ANCHOR)).collect()
    assert [r["uptime_seconds"] for r in out] == [1.0]
