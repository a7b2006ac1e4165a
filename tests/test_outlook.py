from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from coldmart.functions import group_start
from coldmart.operators import folding
from coldmart.plans import outlook, reading
from shapes import UTC, fact, slots, when

NOW = dt.datetime(2026, 6, 3, 12, 30, tzinfo=UTC)  # 21:30 in Japan
QUARTER = dt.timedelta(minutes=15)


def back(n: int) -> dt.datetime:
    return NOW.replace(minute=15) - n * QUARTER


def slope(spark, rows):
    found = folding.discharge_slope(slots(spark, rows)).collect()
    return found[0]["slope_percent_per_hour"] if found else None


def charge(start, first, last, **more):
    return dict(start=start, state_of_charge_start_percent=first, state_of_charge_end_percent=last, **more)


def test_the_slope_is_read_at_the_ends_of_what_was_on_battery(spark):
    # A slot falls one percent, half of each is recorded, and one more is lost in between.
    rows = [charge(back(3 - n), 99 - 2 * n, 98 - 2 * n, covered_seconds=450.0) for n in range(4)]
    assert slope(spark, rows) == pytest.approx(-7 / 0.5)
    partly = [charge(back(2), 64, 63), charge(back(1), 63, 62, covered_seconds=450.0)]
    assert slope(spark, partly) == pytest.approx(-2 / 0.375)


def test_charging_in_between_is_not_a_rise(spark):
    rows = [charge(back(4), 80, 78), charge(back(3), 80, 90, external_input_ratio=1.0), charge(back(2), 90, 88)]
    assert slope(spark, rows) == pytest.approx(-4 / 0.5)


def test_only_the_newest_slots_count_and_none_gives_no_slope(spark):
    rows = [charge(back(30 - n), 100 - n, 100 - n) for n in range(18)]
    rows += [charge(back(12 - n), 60 - n, 59 - n) for n in range(12)]
    assert slope(spark, rows) == pytest.approx(-12 / 3)
    assert slope(spark, [charge(back(1), 50, 50, external_input_ratio=0.5)]) is None


def expected(spark, soc, rate, **state):
    row = dict(serial_number="D1", t=0, state_of_charge_percent=soc, **state)
    latest = reading.latest_state(fact(spark, [row])).withColumn("updated_at", reading.instant(NOW))
    rates = spark.createDataFrame([("D1", rate)], "serial_number STRING, slope_percent_per_hour DOUBLE")
    target = outlook.next_morning_after(NOW)
    return outlook.empty_before(outlook.outlook(latest, rates, target), NOW).first()


def test_the_outlook_follows_the_slope_to_the_next_morning(spark):
    row = expected(spark, 62, -1.0)  # nine and a half hours to seven in the morning
    assert row["projected_percent"] == pytest.approx(52.5)
    assert (row["refused"], row["hours_remaining"], row["empty_before_morning"]) == (None, 62.0, False)
    row = expected(spark, 20, -10.0)
    assert (row["projected_percent"], row["hours_remaining"], row["empty_before_morning"]) == (0.0, 2.0, True)
    assert expected(spark, 95, 3.0)["projected_percent"] == 100.0
    assert expected(spark, 95, 3.0)["hours_remaining"] is None


def test_there_is_no_outlook_on_external_power_or_without_a_slope(spark):
    assert expected(spark, 62, -1.0, battery_state="charging")["refused"] == "plugged_in"
    row = expected(spark, 62, -1.0, external_input=True)
    assert (row["refused"], row["projected_percent"], row["hours_remaining"]) == ("plugged_in", None, None)
    assert expected(spark, 62, None)["refused"] == "no_slope"


def test_mornings_and_midnights_are_japanese():
    assert outlook.next_morning_after(dt.datetime(2026, 6, 3, 22, tzinfo=UTC)).astimezone(UTC) == dt.datetime(2026, 6, 4, 22, tzinfo=UTC)
    assert outlook.next_morning_after(dt.datetime(2026, 6, 3, 21, 59, tzinfo=UTC)).astimezone(UTC) == dt.datetime(2026, 6, 3, 22, tzinfo=UTC)
    assert outlook.jst_midnight_before(dt.datetime(2026, 6, 3, 15, tzinfo=UTC)).astimezone(UTC) == dt.datetime(2026, 6, 3, 15, tzinfo=UTC)
    start, end = outlook.week_window(NOW)
    assert [str(d) for d in outlook.days_between(start, end)] == [f"2026-05-{d}" for d in range(27, 32)] + ["2026-06-01", "2026-06-02"]


def test_folding_adds_weights_and_keeps_holes(spark):
    base = dt.datetime(2026, 6, 3, 4, 45, tzinfo=UTC)  # 13:45 in Japan
    rows = [
        charge(base, 80, 79, covered_seconds=300.0, discharged_watt_hours=2.0, ambient_temperature_celsius=10.0),
        charge(base + QUARTER, 70, 69, covered_seconds=0.0, update_count=0),
        charge(base + 2 * QUARTER, 78, 77, covered_seconds=600.0, ambient_temperature_celsius=40.0),
        charge(base + 3 * QUARTER, 77, 70, covered_seconds=300.0, ambient_temperature_celsius=10.0,
               external_input_ratio=None),
        dict(start=base + 6 * QUARTER, covered_seconds=0.0, state_of_charge_start_percent=None,
             state_of_charge_end_percent=None, discharged_watt_hours=None, external_input_ratio=None),
    ]
    out = {when(r["slot_started_at"]): r for r in folding.fold(slots(spark, rows), 4).collect()}
    hours = sorted(out)
    assert [(h / 3600) % 24 for h in hours] == [4.0, 5.0, 6.0]
    first, second, third = (out[h] for h in hours)
    assert (first["covered_seconds"], first["state_of_charge_delta_percent"]) == (300.0, -1)
    assert (second["state_of_charge_start_percent"], second["state_of_charge_end_percent"]) == (78, 70)
    assert second["ambient_temperature_celsius"] == pytest.approx(30.0)
    assert second["external_input_ratio"] == 0.0
    assert (third["covered_seconds"], third["discharged_watt_hours"]) == (0.0, 0.0)
    assert third["state_of_charge_start_percent"] is None and third["external_input_ratio"] is None


FACTORS = (1, 2, 4, 8, 12, 16, 24, 48, 96)


def test_groups_start_on_the_clock(spark):
    t = dt.datetime(2026, 6, 3, 14, 50)  # 23:50 in Japan
    df = spark.createDataFrame([(t,)], "t TIMESTAMP")
    starts = df.select(*[group_start(F.col("t"), f).alias(str(f)) for f in FACTORS]).first()
    local = [(starts[str(f)] + dt.timedelta(hours=9)).strftime("%d %H:%M") for f in FACTORS]
    assert local == ["03 23:45", "03 23:30", "03 23:00", "03 22:00", "03 21:00", "03 20:00", "03 18:00", "03 12:00", "03 00:00"]


@pytest.mark.parametrize("factor", [1, 4, 20])
def test_every_stretch_is_resampled_at_the_stated_grain(spark, factor):
    lengths = (1, 19, 20, 21, 160, 192)
    rows = [
        charge(back(200 - n), 50, 50, serial_number=f"D{length}")
        for length in lengths for n in range(length)
    ]
    out = folding.resample(slots(spark, rows), factor).groupBy("serial_number").count().collect()
    points = {int(r["serial_number"][1:]): r["count"] for r in out}
    assert sorted(points) == sorted(lengths)
    # A day of 96 slots may begin a group anew.
    assert all(-(-n // factor) <= points[n] <= n // factor + 4 for n in lengths)


def test_the_latest_stretch_stops_at_the_last_hole(spark):
    rows = [charge(back(4), 50, 50), dict(start=back(3), covered_seconds=0.0), charge(back(2), 50, 50), charge(back(1), 50, 50)]
    stretch = folding.latest_stretch(slots(spark, rows))
    assert stretch.count() == 2
    share = outlook.plugged_share(stretch).first()
    assert share["recorded_until"] - share["recorded_from"] == 2 * QUARTER


def week(spark, missing=()):
    _, end = outlook.week_window(NOW)
    start = end - dt.timedelta(days=7)
    rows = []
    for n in range(7 * 24):
        for q in range(4):
            begun = start + n * dt.timedelta(hours=1) + q * QUARTER
            empty = n in range(50, 55) or n // 24 in missing
            rows.append(
                dict(start=begun.astimezone(UTC), covered_seconds=0.0, external_input_ratio=None,
                     state_of_charge_start_percent=None, state_of_charge_end_percent=None,
                     discharged_watt_hours=None, charged_watt_hours=None)
                if empty else
                charge(begun.astimezone(UTC), 60, 55, discharged_watt_hours=5.0,
                       charged_watt_hours=15.0 if n % 24 == 8 else 0.0,
                       external_input_ratio=1.0 if n % 24 == 8 else 0.0)
            )
    return outlook.week_hours(slots(spark, rows), NOW)


def test_the_week_adds_up(spark):
    row = outlook.weekly_totals(week(spark)).first()
    assert row["external_input_hours"] == pytest.approx(7.0)
    assert row["average_charge_watts"] == pytest.approx(60.0)
    assert (row["charged_watt_hours"], row["discharged_watt_hours"]) == (420.0, 20.0 * (168 - 5))
    assert row["balancing_hours"] == pytest.approx((3260 - 420) / 60)
    assert row["gap_hours"] == 5


def test_a_day_without_data_is_named_and_stays_in_the_days(spark):
    hours = week(spark, missing=(3,))
    days = outlook.days_between(*outlook.week_window(NOW))
    devices = spark.createDataFrame([("D1",), ("silent",)], "serial_number STRING")
    missing = {(r["serial_number"], r["day"]) for r in outlook.missing_days(hours, devices, days).collect()}
    assert missing == {("D1", days[3])} | {("silent", d) for d in days}
    per_day = {r["day"]: r for r in outlook.daily_energy(hours, devices, days).filter("serial_number = 'D1'").collect()}
    assert len(per_day) == 7
    assert (per_day[days[0]]["lowest_percent"], per_day[days[0]]["highest_percent"]) == (55, 60)
    assert (per_day[days[3]]["discharged_watt_hours"], per_day[days[3]]["lowest_percent"]) == (0.0, None)


def test_today_is_compared_with_yesterday_if_there_was_one(spark):
    def compared(*energies):
        rows = [
            dict(t=0, serial_number="D1", discharge_watts=w, held_seconds=3600.0) | dict(t=seconds)
            for seconds, w in energies
        ]
        base = dt.datetime(2026, 5, 12, tzinfo=UTC)
        return outlook.energy_vs_previous(fact(spark, rows), base).first()["against_yesterday"]

    day = 86400
    assert compared((day + 60, 50)) == "nothing_to_compare"
    assert compared((60, 50), (day + 60, 50)) == "about_the_same"
    assert compared((60, 50), (day + 60, 52)) == "more"
    assert compared((60, 50), (day + 60, 40)) == "less"


def test_only_complete_series_stay(spark):
    rows = [(s, c, v) for s in "ab" for c, v in ((1, 1.0), (2, None if s == "b" else 2.0))] + [("c", 1, 1.0)]
    points = spark.createDataFrame(rows, "s STRING, c INT, v DOUBLE")
    assert {r["s"] for r in folding.complete_series(points, "s", "c", "v").collect()} == {"a"}


def test_ranges_close_where_they_say(spark):
    df = fact(spark, [dict(t=n) for n in (0, 10, 20)])
    from shapes import DAY0, at

    for closed, want in (("(]", [10, 20]), ("[)", [0, 10]), ("[]", [0, 10, 20])):
        kept = df.filter(reading.in_window("updated_at", DAY0, at(20), closed, partition=None))
        assert sorted(when(r["updated_at"]) for r in kept.collect()) == want


def test_a_range_read_prunes_partitions(spark, tmp_path):
    df = slots(spark, [charge(back(n), 50, 50) for n in range(200)])
    df.write.partitionBy("partition_date").parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    plan = reading.snapshots(table, NOW - dt.timedelta(hours=3), NOW)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(partition_date" in plan
    assert reading.snapshots(table, NOW - dt.timedelta(hours=3), NOW).count() == 12


def test_latest_state_is_per_device_and_point_in_time(spark):
    df = fact(spark, [dict(t=5, state_of_charge_percent=1), dict(t=9, state_of_charge_percent=2),
                      dict(t=7, serial_number="D2", state_of_charge_percent=3)])
    from shapes import at

    got = {r["serial_number"]: r["state_of_charge_percent"] for r in reading.latest_state(df).collect()}
    assert got == {"D1": 2, "D2": 3}
    past = reading.latest_state(df, at(7))
    assert {r["serial_number"]: r["state_of_charge_percent"] for r in past.collect()} == {"D1": 1, "D2": 3}


def test_triggers_average_only_known_durations(spark):
    rows = [("D1", "rise", 600.0), ("D1", "rise", None), ("D1", "start_up", None)]
    out = outlook.trigger_stats(spark.createDataFrame(rows, "serial_number STRING, trigger STRING, duration_seconds DOUBLE"))
    assert {(r["trigger"], r["episodes"], r["mean_duration_seconds"]) for r in out.collect()} == {
        ("rise", 2, 600.0), ("start_up", 1, None)}
