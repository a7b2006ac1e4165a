from __future__ import annotations

import random

import pytest

from coldmart.operators.episodes import pulldown_episodes
from coldmart.operators.slots import slot_snapshot
from shapes import DAY0, at, fact, when


def snapshot(spark, rows):
    out = slot_snapshot(fact(spark, rows)).collect()
    return {when(r["slot_started_at"]): r for r in out}


def test_slots_are_dense_and_intervals_are_cut_at_their_borders(spark):
    got = snapshot(
        spark,
        [dict(t=100, held_seconds=600.0, discharge_watts=36, state_of_charge_percent=90),
         dict(t=700, held_seconds=600.0, discharge_watts=72, state_of_charge_percent=88,
              ambient_temperature_celsius=None),
         dict(t=2800, held_seconds=300.0, state_of_charge_percent=80)],
    )
    assert sorted(got) == [0, 900, 1800, 2700]
    first, second, hole, last = (got[s] for s in (0, 900, 1800, 2700))
    assert (first["covered_seconds"], first["update_count"]) == (800.0, 2)
    assert first["discharged_watt_hours"] == pytest.approx(36 * 600 / 3600 + 72 * 200 / 3600)
    assert first["ambient_temperature_celsius"] == 21.0
    assert (first["state_of_charge_start_percent"], first["state_of_charge_end_percent"]) == (90, 88)
    assert first["state_of_charge_delta_percent"] == -2
    assert (second["covered_seconds"], second["update_count"]) == (400.0, 1)
    assert second["ambient_temperature_celsius"] is None
    assert (hole["covered_seconds"], hole["update_count"], hole["cooler_key"]) == (0.0, 0, None)
    assert hole["discharged_watt_hours"] is None
    assert last["covered_seconds"] == 300.0
    # Midnight UTC is nine in the morning in Japan.
    assert (first["slot_key"], first["date_key"], first["hour_of_day"], second["minute_of_hour"]) == (
        "202605100900", 20260510, 9, 15)


def test_full_is_not_charging(spark):
    got = snapshot(
        spark,
        [dict(t=0, held_seconds=300.0, battery_state="charging", external_input=True, charge_watts=30),
         dict(t=300, held_seconds=600.0, battery_state="full", external_input=True)],
    )
    assert got[0]["charging_ratio"] == pytest.approx(1 / 3) and got[0]["external_input_ratio"] == 1.0


def test_an_interval_that_stops_on_a_border_does_not_reach_over_it(spark):
    assert sorted(snapshot(spark, [dict(t=300, held_seconds=600.0)])) == [0]
    # Nothing at all, exactly on a border: alive then, but nothing recorded.
    (row,) = snapshot(spark, [dict(t=900, held_seconds=0.0)]).values()
    assert (row["covered_seconds"], row["update_count"], row["state_of_charge_start_percent"]) == (0.0, 0, None)
    (row,) = snapshot(spark, [dict(t=910, held_seconds=0.0)]).values()
    assert (row["covered_seconds"], row["update_count"], row["state_of_charge_start_percent"]) == (0.0, 1, 70)
    assert row["discharged_watt_hours"] == 0.0 and row["setpoint_celsius"] is None


def test_devices_do_not_share_slots(spark):
    out = slot_snapshot(
        fact(spark, [dict(t=0, serial_number="D1"), dict(t=4000, serial_number="D1"), dict(t=100, serial_number="D2")])
    ).collect()
    assert sorted((r["serial_number"], when(r["slot_started_at"])) for r in out) == [
        ("D1", 0), ("D1", 900), ("D1", 1800), ("D1", 2700), ("D1", 3600), ("D2", 0)]


def episodes(spark, rows, **options):
    out = pulldown_episodes(fact(spark, rows), **options).collect()
    return sorted(out, key=lambda r: (r["serial_number"], r["started_at"], r["pulldown_key"]))


def temperatures(*values, setpoint=-18, step=300, **more):
    return [dict(t=n * step, interior_temperature_celsius=v, setpoint_celsius=setpoint, **more) for n, v in enumerate(values)]


def test_an_episode_runs_from_a_warm_start_to_the_setpoint(spark):
    rows = temperatures(20, 2, -17, -18, discharge_watts=12)
    rows[2]["state_of_charge_percent"] = 66
    (e,) = episodes(spark, rows)
    assert (e["pulldown_key"], e["trigger"], e["outcome"], e["update_count"]) == ("k0000", "start_up", "reached", 3)
    assert (when(e["reached_at"]), when(e["ended_at"])) == (600, 600)
    assert (e["duration_seconds"], e["covered_seconds"], e["state_of_charge_delta_percent"]) == (600.0, 600.0, -4)
    assert e["discharged_watt_hours"] == pytest.approx(2.0)


def test_lowering_the_setpoint_is_its_own_trigger(spark):
    rows = temperatures(3, 3, -17)
    rows[0]["setpoint_celsius"] = 4
    (e,) = episodes(spark, rows)
    assert (e["trigger"], when(e["started_at"]), e["update_count"]) == ("setpoint_change", 300, 2)


def test_taking_the_battery_out_interrupts(spark):
    rows = temperatures(-18, -9, -11)
    rows[2] |= dict(battery_state="absent", state_of_charge_percent=0)
    (e,) = episodes(spark, rows)
    assert (e["trigger"], e["outcome"], e["reached_at"], e["duration_seconds"]) == ("rise", "interrupted", None, None)
    assert (when(e["ended_at"]), e["elapsed_seconds"], e["update_count"]) == (600, 300.0, 2)


def test_a_wobble_does_not_cut_an_episode_and_a_second_rise_is_its_own(spark):
    (e,) = episodes(spark, temperatures(12, 4, 7, 1, setpoint=0))
    assert (e["update_count"], e["duration_seconds"], e["covered_seconds"]) == (4, 900.0, 900.0)
    first, second = episodes(spark, temperatures(12, 1, 9, 0, setpoint=0))
    assert (first["trigger"], second["trigger"], second["update_count"]) == ("start_up", "rise", 2)


def test_the_last_report_of_a_device_leaves_its_episode_open_unless_absent(spark):
    (e,) = episodes(spark, temperatures(12, 9, setpoint=0))
    assert (e["outcome"], e["ended_at"], e["covered_seconds"], e["update_count"]) == (None, None, 600.0, 2)
    (e,) = episodes(spark, [*temperatures(12, 9, setpoint=0), dict(t=5000, interior_temperature_celsius=0, setpoint_celsius=0)])
    assert (e["outcome"], when(e["ended_at"]), e["covered_seconds"]) == ("interrupted", 300, 300.0)


def by_hand(rows: list[dict]) -> list[tuple]:
    """The episode rules applied report by report."""
    out = []
    for device in sorted({r["serial_number"] for r in rows}):
        mine = sorted((r for r in rows if r["serial_number"] == device), key=lambda r: (r["t"], r["key"]))
        current = None
        for n, r in enumerate(mine):
            before, after = (mine[n - 1] if n else None), (mine[n + 1] if n + 1 < len(mine) else None)
            above = r["interior_temperature_celsius"] >= r["setpoint_celsius"] + 5
            fresh = (
                before is None
                or before["boot_id"] != r["boot_id"]
                or before["battery_state"] == "absent"
                or r["t"] - before["t"] >= 900
            )
            was = before is not None and before["interior_temperature_celsius"] >= before["setpoint_celsius"] + 5
            reached = r["interior_temperature_celsius"] <= r["setpoint_celsius"] + 1
            ends = (
                reached
                or r["battery_state"] == "absent"
                or (after is not None and (after["boot_id"] != r["boot_id"] or after["t"] - r["t"] >= 900))
            )
            if current is None and above and (fresh or not was):
                trigger = "start_up" if fresh else "setpoint_change" if before["setpoint_celsius"] > r["setpoint_celsius"] else "rise"
                current = [device, r["key"], trigger, 0, 0.0]
            if current is not None:
                current[3] += 1
                if not ends:
                    current[4] += r["held_seconds"]
                else:
                    out.append((*current, "reached" if reached else "interrupted", r["t"]))
                    current = None
        if current is not None:
            out.append((*current, None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_episodes_match_the_rules_applied_by_hand_at_any_chunk_length(spark, seed):
    rng, rows = random.Random(seed), []
    for device, count in (("hot", 400), ("D2", 40), ("D3", 1)):
        t, boot = 0, 0
        for n in range(count):
            t += rng.choice([60, 300, 300, 600, 899, 900, 2000] if rng.random() < 0.4 else [120, 300])
            boot += rng.random() < 0.03
            rows.append(
                dict(serial_number=device, t=t, boot_id=f"{device}-{boot}", held_seconds=float(rng.choice([60, 120, 300])),
                     key=f"{device}-{n:04d}", state_update_key=f"{device}-{n:04d}",
                     setpoint_celsius=rng.choice([0, 0, 0, -10]), interior_temperature_celsius=rng.randint(-9, 14),
                     battery_state=rng.choice(["discharging"] * 30 + ["absent"]))
            )
    want = by_hand(rows)
    assert len(want) > 50
    df = fact(spark, [{k: v for k, v in r.items() if k != "key"} for r in rows]).cache()
    for chunk in (5, 64, 10**7):
        got = pulldown_episodes(df, rows=chunk).collect()
        found = [
            (r["serial_number"], r["pulldown_key"], r["trigger"], r["update_count"], round(r["covered_seconds"], 6),
             r["outcome"], None if r["ended_at"] is None else int(when(r["ended_at"])))
            for r in got
        ]
        assert sorted(found, key=str) == want
    df.unpersist()


def test_days_are_japanese(spark):
    # 16:00 UTC is one in the morning of the next day in Japan.
    (e,) = episodes(spark, [dict(t=16 * 3600, interior_temperature_celsius=9, setpoint_celsius=0)])
    assert (e["date_key"], str(e["partition_date"])) == (20260511, "2026-05-11")
    assert at(0) == DAY0
