from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from coldmart import schemas
from coldmart.plans import quality
from coldmart.plans.reading import instant
from shapes import DAY0, at, fact, frame, raw, slots

NOW = at(10 * 3600)
LANDED, JUST_LANDED = at(3600), at(9 * 3600)


def unreflected(spark, rows, reflected):
    """rows: (uptime, landed, complete)."""
    table = raw(
        spark,
        [dict(uptime_seconds=float(u), ts=at(u), payload={} if ok else None) for u, _, ok in rows],
    )
    landed = spark.createDataFrame([(float(u), t) for u, t, _ in rows], "uptime_seconds DOUBLE, _ingested_at TIMESTAMP")
    table = table.join(landed, "uptime_seconds").select(*table.columns, "_ingested_at")
    df = fact(spark, [dict(t=u, uptime_seconds=float(u)) for u in reflected] or [dict(t=0, uptime_seconds=-1.0)])
    due = instant(NOW - dt.timedelta(hours=2))
    return quality.unreflected(table, df, due).count()


@pytest.mark.parametrize(
    "rows, reflected, missing",
    [
        ([(1, LANDED, True), (2, LANDED, True)], [1, 2], 0),
        ([(1, LANDED, True), (2, LANDED, True)], [], 2),
        ([(1, LANDED, True), (2, LANDED, True)], [1], 1),
        ([(1, LANDED, True), (1, at(7200), True)], [1], 0),
        ([(1, JUST_LANDED, True)], [], 0),
        ([(1, LANDED, False)], [], 0),
    ],
)
def test_every_report_kept_and_due_is_in_the_fact(spark, rows, reflected, missing):
    assert unreflected(spark, rows, reflected) == missing


def counts(spark, tables):
    return {(r["table"], r["rule"]): r["violations"] for r in quality.violations(tables, NOW).collect()}


def test_broken_rows_are_counted_by_the_rule_they_break(spark):
    good = dict(t=100, uptime_seconds=1.0, held_seconds=600.0, date_key=20260510)
    bad = dict(good, uptime_seconds=2.0, t=200, state_of_charge_percent=101, setpoint_celsius=-41,
               external_input=True, date_key=20260511, held_seconds=500.0)
    name = "fact_cooler_state_update"
    got = counts(spark, {
        name: fact(spark, [good, bad, dict(good, t=300)]), "raw_cooler": raw(spark, []),
        "dim_cooler": spark.createDataFrame([(5, "D1", DAY0, None, True)],
            "cooler_key BIGINT, serial_number STRING, valid_from TIMESTAMP, valid_to TIMESTAMP, is_current BOOLEAN"),
        "dim_battery": spark.createDataFrame([(6,)], "battery_key BIGINT"),
        "dim_date": spark.createDataFrame([(20260510,)], "date_key BIGINT"),
    })
    assert got[name, "identity_unique"] == 1
    assert got[name, "state_of_charge_in_range"] == 1
    assert got[name, "temperatures_in_range"] == 1
    assert got[name, "external_input_matches_watts"] == 1
    assert got[name, "date_key_matches_updated_at"] == 1
    assert got[name, "keys_resolve"] == 1
    # 600, 600 and 500 claimed; 0 (its copy comes at once), 1 and 600 to be expected.
    assert got[name, "held_seconds_is_the_gap_to_the_next_update"] == 3


def test_snapshot_and_episode_rules(spark):
    snap, pull = "fact_cooler_snapshot", "fact_cooler_pulldown"
    start = DAY0
    rows = [
        dict(start=start, slot_key="a"), dict(start=start + dt.timedelta(minutes=45), slot_key="b", covered_seconds=901.0),
        dict(start=start + dt.timedelta(minutes=60), slot_key="b", external_input_ratio=1.5, discharged_watt_hours=26.0,
             state_of_charge_delta_percent=9),
    ]
    episodes = frame(spark, schemas.PULLDOWN, [
        dict(pulldown_key="x", started_at=at(10), reached_at=at(5), ended_at=at(20), outcome="reached"),
        dict(pulldown_key="x", started_at=at(10), outcome="interrupted", duration_seconds=90000.0),
    ])
    got = counts(spark, {snap: slots(spark, rows), pull: episodes, "fact_cooler_state_update": fact(spark, [dict(t=0)]),
                         "raw_cooler": raw(spark, []), "dim_cooler": frame(spark, schemas.COOLER, []),
                         "dim_battery": frame(spark, schemas.BATTERY, []), "dim_date": frame(spark, schemas.CALENDAR, [])})
    assert got[snap, "one_row_per_slot"] == 1 and got[snap, "slots_are_dense"] == 2
    assert got[snap, "covered_seconds_in_range"] == 1 and got[snap, "ratios_in_range"] == 1
    assert got[snap, "delta_is_end_minus_start"] == 1 and got[snap, "energy_plausible"] == 1
    assert got[snap, "energy_matches_state_updates"] == 1
    assert got[pull, "one_row_per_episode"] == 1 and got[pull, "milestones_ordered"] == 1
    assert got[pull, "outcome_and_end_agree"] == 1 and got[pull, "duration_plausible"] == 1


def test_raw_rules(spark):
    df = raw(
        spark,
        [dict(uptime_seconds=1.0, ts=at(1), frames=["00", "11"]), dict(uptime_seconds=1.0, ts=at(1), frames=["00"]),
         dict(uptime_seconds=2.0, ts=at(1), frames=[], plain=None, air=90.0)],
    )
    events = frame(spark, schemas.RAW_EVENTS, [
        dict(boot_id="b", uptime_seconds=1.0, kind="k", ts=at(1)), dict(boot_id="b", uptime_seconds=1.0, kind="k", ts=at(2)),
        dict(boot_id="b", uptime_seconds=1.0, kind="other", ts=at(3))])
    got = counts(spark, {"raw_cooler": df, "raw_events": events})
    assert got["raw_cooler", "repeated_messages_agree"] == 1
    assert got["raw_cooler", "frames_present"] == 1
    assert got["raw_cooler", "payload_only_with_plain"] == 1
    assert got["raw_cooler", "temperatures_in_range"] == 1
    assert got["raw_events", "repeated_events_agree"] == 1


@pytest.mark.parametrize("chunk", [3, 10**6])
def test_overlapping_pairs_are_counted_without_pairing(spark, chunk):
    rng = random.Random(5)
    rows = []
    for key in ("hot", "few"):
        for _ in range(60 if key == "hot" else 5):
            a = rng.randint(0, 400)
            b = rng.choice([a, a + rng.randint(0, 60), None if rng.random() < 0.2 else a + 5])
            rows.append((key, a, b))
    end = 10**12
    want = sum(
        a[0] == b[0] and a[1] < (end if b[2] is None else b[2]) and b[1] < (end if a[2] is None else a[2])
        for i, a in enumerate(rows) for b in rows[i + 1 :]
    )
    df = spark.createDataFrame(
        [(k, at(a), None if b is None else at(b)) for k, a, b in rows],
        "serial_number STRING, valid_from TIMESTAMP, valid_to TIMESTAMP",
    )
    assert quality.overlapping_versions(df, rows=chunk).first()[0] == want > 0


def test_a_rule_that_crashes_is_a_finding(spark):
    results = quality.evaluate(spark, {"raw_cooler": raw(spark, [])}, NOW, "collection")
    by_rule = {r["rule"]: r for r in results.collect()}
    assert by_rule["frames_present"]["violations"] == 0
    assert "KeyError" in by_rule["repeated_events_agree"]["error"]
    (row,) = quality.report(results, narrowed=True).collect()
    assert not row["passed"] and row["failed_checks"] == ["raw_events.repeated_events_agree"]
    clean = quality.report(results.filter("error is null"), narrowed=True).first()
    assert clean["passed"] and not clean["all_clear"]


def test_a_sound_run_is_one_job_and_a_rule_that_breaks_in_it_is_found(spark, monkeypatch):
    tables = {"raw_cooler": raw(spark, [dict(uptime_seconds=1.0, frames=[])]), "raw_events": frame(spark, schemas.RAW_EVENTS, [])}
    kind = type(tables["raw_cooler"])
    collected, collect = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: collected.append(1) or collect(df))
    rules = quality.evaluate(spark, tables, NOW, "collection")
    assert len(collected) == 1
    monkeypatch.undo()
    rows = {r["rule"]: (r["violations"], r["error"]) for r in rules.collect()}
    assert rows["frames_present"] == (1, None) and rows["repeated_events_agree"] == (0, None)
    # One column of the table cannot be computed: the rules that need it break, the others count.
    broken = F.when(F.col("uptime_seconds") > 0, F.raise_error(F.lit("torn page")).cast("string")).otherwise(F.col("plain"))
    tables["raw_cooler"] = tables["raw_cooler"].withColumn("plain", broken)
    found = {r["rule"]: r for r in quality.evaluate(spark, tables, NOW, "collection").collect()}
    assert list(found) == list(rows)
    assert found["frames_present"]["violations"] == 1 and found["repeated_events_agree"]["violations"] == 0
    assert "torn page" in found["payload_only_with_plain"]["error"]
    assert found["payload_only_with_plain"]["violations"] is None


def test_declared_columns_are_checked(spark):
    df = fact(spark, [dict(t=1, battery_state="melted"), dict(t=2, state_update_key="k0000", cooler_key=None)])
    df = df.withColumn("uptime_seconds", F.col("uptime_seconds").cast("string"))
    found = {(r["check"], r["column"]): r["violations"] for r in
             quality.schema_violations(df, quality.DECLARED["fact_cooler_state_update"]).collect()}
    assert found["type", "uptime_seconds"] == 1 and found["type", "boot_id"] == 0
    assert found["accepted", "battery_state"] == 1
    assert found["required", "cooler_key"] == 1
    assert found["unique", "state_update_key"] == 1


def test_freshness_warns_after_a_day_and_fails_after_a_week(spark):
    df = fact(spark, [dict(t=0)])
    day = 86400
    status = [quality.freshness(df, "updated_at", at(s)).first()["status"] for s in (day, day + 1, 7 * day, 7 * day + 1)]
    assert status == ["ok", "warn", "warn", "error"]
    assert quality.freshness(df.limit(0), "updated_at", NOW).first()["status"] == "error"
