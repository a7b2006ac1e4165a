from __future__ import annotations

import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldmart import schemas
from coldmart.plans import build
from coldmart.sources import chunks, gateway, marts, signals
from shapes import PAYLOAD, at, fact, frame, raw, when

LINE = {"ts": "2026-05-10T00:00:01.250000Z", "uptime_seconds": 7.5, "boot_id": "b", "type": "event", "kind": "k"}


def chunk(root, stream, day, lines):
    folder = root / "v1" / stream / f"dt={day}"
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / "000000000000.jsonl.gz", "wt") as file:
        file.write("\n".join(lines) + "\n")


def test_chunks_are_read_with_the_declared_schema(spark, tmp_path):
    lines = [json.dumps(LINE | {"unknown": [1]}), json.dumps({k: v for k, v in LINE.items() if k != "kind"})]
    chunk(tmp_path, "events", "2026-05-10", lines)
    chunk(tmp_path, "events", "2026-05-11", [json.dumps(LINE)])
    df = chunks.read_raw(spark, str(tmp_path), "events")
    assert df.columns == [*schemas.RAW_EVENTS.fieldNames(), "dt"]
    assert df.filter("dt = '2026-05-10'").count() == 2
    rows = df.filter("dt = '2026-05-10'").orderBy("kind").collect()
    assert [r["kind"] for r in rows] == [None, "k"]
    assert when(rows[1]["ts"]) == 1.25 and rows[1]["firmware"] is None


@pytest.mark.parametrize(
    "line, reason",
    [
        ('{"n": 1}', None), ('  {"n": 2}\r', None), ('{"n": "text"}', None), ("{}", None),
        ("", "empty"), (" \t", "empty"), ("\x00\x00", "nul"), ('{"n": 1', "torn"), ('{"n": 1} x', "torn"),
        ('{"n": 1}}', "torn"), ('{"n": 1},{"n": 2}', "torn"), ('{"n": 1},"m":2', "torn"), ("nonsense", "torn"),
        ("[1, 2]", "not_an_object"), ("17", "not_an_object"), ('"text"', "not_an_object"), ("null", "not_an_object"),
    ],
)
def test_only_lines_of_one_object_are_records(spark, line, reason):
    text = spark.createDataFrame([(line,)], "value STRING")
    good, rejected = chunks.parse_lines(text, T.StructType([T.StructField("n", T.LongType())]))
    assert good.count() == (reason is None)
    assert [r["reason"] for r in rejected.collect()] == ([reason] if reason else [])


def test_raw_tables_are_appended_and_reset(spark, tmp_path):
    path = str(tmp_path / "raw_cooler")
    chunks.reset_raw(spark, path, "raw_cooler")
    assert chunks.read_table(spark, path, "raw_cooler").count() == 0
    df = raw(spark, [dict(uptime_seconds=float(n), ts=at(n)) for n in range(5)])
    chunks.append_raw(df, path, F.lit(at(0)))
    chunks.append_raw(df, path, F.lit(at(86400)))
    table = chunks.read_table(spark, path, "raw_cooler")
    assert table.count() == 10
    assert sorted(str(r[0]) for r in table.select("_ingest_date").distinct().collect()) == ["2026-05-10", "2026-05-11"]
    chunks.reset_raw(spark, path, "raw_cooler")
    assert chunks.read_table(spark, path, "raw_cooler").count() == 0


def test_records_are_routed_by_type_and_day_and_read_back(spark, tmp_path):
    both = raw(spark, [dict(uptime_seconds=1.0, ts=at(1), air=None), dict(uptime_seconds=2.0, ts=at(90000))]).unionByName(
        frame(spark, schemas.RAW_EVENTS, [dict(type="event", kind="k", boot_id="b", uptime_seconds=1.5, ts=at(2.25))]),
        allowMissingColumns=True,
    ).unionByName(frame(spark, schemas.RAW_EVENTS, [dict(type="ambient", ts=at(3))]), allowMissingColumns=True)
    left = chunks.route_records(both, str(tmp_path))
    assert [r["type"] for r in left.collect()] == ["ambient"]
    cooler = chunks.read_raw(spark, str(tmp_path), "cooler").orderBy("ts").collect()
    assert [str(r["dt"]) for r in cooler] == ["2026-05-10", "2026-05-11"]
    assert cooler[1]["payload"].asDict() == PAYLOAD and cooler[0]["environment"] is None
    (event,) = chunks.read_raw(spark, str(tmp_path), "events").collect()
    assert when(event["ts"]) == 2.25
    (file,) = (tmp_path / "v1" / "events" / "dt=2026-05-10").glob("*.gz")
    assert "null" not in gzip.decompress(file.read_bytes()).decode()


def test_marts_are_replaced_behind_a_pointer(spark, tmp_path):
    root, name = str(tmp_path), "fact_cooler_state_update"
    assert marts.current_version(spark, root) is None
    marts.write_mart(fact(spark, [dict(t=0)]), root, name, "v1")
    with pytest.raises(FileNotFoundError):
        marts.read_mart(spark, root, name)
    marts.publish(spark, root, "v1")
    marts.write_mart(fact(spark, [dict(t=0), dict(t=90000)]), root, name, "v2")
    assert marts.read_mart(spark, root, name).count() == 1
    marts.publish(spark, root, "v2")
    table = marts.read_mart(spark, root, name)
    assert table.count() == 2 and table.columns == schemas.STATE_UPDATE.fieldNames()
    with pytest.raises(ValueError, match="undeclared"):
        marts.write_mart(fact(spark, [dict(t=0)]).withColumn("x", F.lit(1)), root, name, "v3")


def test_envelopes_become_records(spark):
    stamp = dict(boot_id="b", uptime_seconds=1.0, ts=at(1), ts_synced=True)
    message = dict(stamp, kind="message", model="everfrost", address="A", frames=["00"], payload=tuple(PAYLOAD.values()))
    bad = tuple((PAYLOAD | {"battery_state": "melted"}).values())
    schema = T.StructType([*schemas.RAW_COOLER.fields, *[f for f in schemas.RAW_EVENTS.fields if f.name not in schemas.RAW_COOLER.fieldNames()],
                           T.StructField("seq", T.LongType()), T.StructField("connection", T.LongType())])
    events = frame(spark, schema, [
        dict(message, seq=1), dict(message, seq=2, payload=bad), dict(message, seq=3, payload=None), dict(message, frames=None),
        dict(stamp, kind="dropped", seq=9, count=4), dict(stamp, kind="ble_connected", name="N"), dict(stamp, kind=None),
        dict(stamp, kind="ble_error", boot_id=None)])
    cooler, kept = gateway.records_from_events(events)
    assert cooler.columns == schemas.RAW_COOLER.fieldNames() and kept.columns == schemas.RAW_EVENTS.fieldNames()
    rows = cooler.collect()
    assert [r["payload"] is not None for r in rows] == [True, False, False] and all(r["frames"] == ["00"] for r in rows)
    assert {(r["kind"], r["count"], r["name"]) for r in kept.collect()} == {("gateway_dropped", 4, None), ("ble_connected", None, "N")}


BUILT = dict(event="semantic_updated", run_id="r", published_at="2026-05-10T00:00:00Z", rows_arrived=3, build_passed=True)
REPORT = dict(event="quality_report", run_id="r", published_at="2026-05-10T00:00:00Z", contract_id="c", passed=False, failed_checks=["a"])


def pushed(body, raw_data=None) -> str:
    data = raw_data if raw_data is not None else base64.b64encode(json.dumps(body).encode()).decode()
    return json.dumps({"message": {"data": data, "messageId": "1", "extra": 1}, "subscription": "s"})


@pytest.mark.parametrize(
    "value, where",
    [
        (pushed(BUILT), 0), (pushed(BUILT | {"extra": {"x": 1}}), 0), (pushed(REPORT), 1),
        (pushed(REPORT | {"passed": True, "failed_checks": []}), 1),
        (pushed({k: v for k, v in REPORT.items() if k != "contract_id"}), 2), (pushed(BUILT | {"event": "other"}), 2),
        (pushed([BUILT]), 2), (pushed("text"), 2), (pushed(BUILT | {"rows_arrived": "many"}), 2),
        (pushed(None, "not base64!"), 2), (pushed(None, base64.b64encode(b"{").decode()), 2), (pushed(None, ""), 2),
        ("{}", 2), ("nonsense", 2), (pushed(BUILT | {"published_at": "soon"}), 2),
    ],
)
def test_signals_are_told_apart(spark, value, where):
    parts = signals.decode_signals(spark.createDataFrame([(value,)], "value STRING"))
    assert [df.count() for df in parts] == [int(where == n) for n in range(3)]


def test_signals_are_emitted_and_failed_reports_surface_once(spark, tmp_path):
    path = str(tmp_path / "signals")
    signals.emit_build_signal(spark, path, "run-1", 12, at(0).replace(tzinfo=None))
    report = spark.createDataFrame(
        [("collection", ["x"], False), ("semantics", [], True)], "contract STRING, failed_checks ARRAY<STRING>, passed BOOLEAN"
    )
    for _ in range(2):  # at least once
        signals.emit_quality_report(report, path, "run-2", at(0).replace(tzinfo=None))
    table = spark.read.schema(schemas.SIGNAL).parquet(path)
    assert table.count() == 5
    (row,) = signals.failed_reports(table).collect()
    assert (row["run_id"], row["contract_id"], row["failed_checks"]) == ("run-2", "collection", ["x"])
    stream = signals.stream_failed_reports(spark.readStream.schema(schemas.SIGNAL).parquet(path))
    query = stream.writeStream.format("memory").queryName("failed").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("failed").count() == 1


def raw_fleet(spark, until=10**9):
    """Three devices over a few hours, two boots each; ``until`` cuts deliveries off."""
    cooler, events = [], []
    for d in range(3):
        for b in range(2):
            boot, start = f"D{d}-b{b}", b * 20000
            events.append(dict(type="event", kind="ble_negotiated", boot_id=boot, uptime_seconds=5.0, ts=at(start + 5),
                               ts_synced=True, serial=f"D{d}", address=f"A{d}", chip="c", firmware=f"{b}"))
            for n in range(40):
                t = start + 10 + n * 250
                cooler.append(dict(boot_id=boot, uptime_seconds=10.0 + n * 250, ts=at(t if n else t - 86400 * 9), ts_synced=n > 0,
                                   address=f"A{d}", payload=dict(serial_number=f"D{d}", battery_serial_number=f"P{d}",
                                   interior_temperature_celsius=-18 + (n * 7 + d) % 11)))
    return raw(spark, cooler[:until]), frame(spark, schemas.RAW_EVENTS, events)


SPAN = ("2026-01-01", "2026-12-31")


def rows_of(tables, name):
    return sorted(map(str, tables[name].collect()))


def test_a_rebuild_of_changed_devices_equals_a_full_one(spark, tmp_path):
    root = str(tmp_path)
    before, events = raw_fleet(spark, until=200)  # D2's second boot arrives late
    build.build_all(before, events, root, SPAN)
    complete, _ = raw_fleet(spark)
    partial = build.rebuild_devices(
        complete.filter("payload.serial_number = 'D2'"), events.filter("serial = 'D2'"),
        spark.createDataFrame([("D2",)], "serial_number STRING"), root, calendar_span=SPAN,
    )
    full = build.build_all(complete, events, str(tmp_path / "full"), SPAN)
    assert sorted(partial) == sorted(full)
    for name in full:
        assert rows_of(partial, name) == rows_of(full, name), name
    assert marts.read_mart(spark, root, "fact_cooler_state_update").count() == 240


def test_a_rebuild_asks_once_which_devices_changed(spark, tmp_path):
    cooler, events = raw_fleet(spark)
    build.build_all(cooler, events, str(tmp_path), SPAN)
    asked = spark.sparkContext.accumulator(0)

    def told(serial):
        asked.add(1)
        return serial

    changed = spark.createDataFrame([("D2",)], "serial_number STRING")
    changed = changed.select(F.udf(told, "string")("serial_number").alias("serial_number"))
    tables = build.rebuild_devices(cooler, events, changed, str(tmp_path), calendar_span=SPAN)
    assert tables["fact_cooler_state_update"].count() == 240
    assert asked.value == 1


def test_the_star_keeps_its_own_contract(spark, tmp_path):
    from coldmart.plans import quality

    cooler, events = raw_fleet(spark)
    tables = build.build_all(cooler, events, str(tmp_path), SPAN)
    found = quality.violations(dict(tables) | {"raw_cooler": cooler, "raw_events": events}, at(10**6)).collect()
    assert len(found) == 27 and {r["rule"]: r["violations"] for r in found if r["violations"]} == {}
    for name, table in tables.items():
        broken = quality.schema_violations(table, quality.DECLARED[name]).filter("violations > 0")
        assert broken.count() == 0, name


def test_two_deliveries_build_what_one_does(spark, tmp_path):
    cooler, events = raw_fleet(spark)
    whole = build.build_all(cooler, events, str(tmp_path / "a"), SPAN)
    # A chunk border must not end a state, and a re-sent half must change nothing.
    again = cooler.filter("uptime_seconds < 4000").unionByName(cooler.filter("uptime_seconds >= 3000"))
    halves = build.build_all(again, events, str(tmp_path / "b"), SPAN)
    for name in whole:
        assert rows_of(whole, name) == rows_of(halves, name), name


