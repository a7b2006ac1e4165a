from __future__ import annotations

import functools
import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldmart import schemas
from coldmart.sources import marts
from coldmart.streaming import arrivals, commands, gaps
from coldmart.streaming.throttle import NEVER, Outcomes, stream_throttle, throttle
from shapes import PAYLOAD, at, fact, when

NUMBERED = "session STRING, seq BIGINT, kind STRING, count BIGINT"


def streamed(spark, tmp_path, batches, schema, transform, name, mode="append"):
    """Run ``batches`` through a stream one file, and so one micro-batch, at a time."""
    folder = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"p={n}"))
    source = (
        spark.readStream.schema(spark.createDataFrame([], schema).schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(str(folder / "*"))
    )
    query = (
        transform(source).writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name).collect()


ROWS = [
    ("s", 1, "message", None), ("s", 5, "message", None), ("s", 6, "message", None),
    ("s", 40, "dropped", 34), ("s", 41, "message", None), ("t", 7, "message", None), ("t", 8, "message", None),
]
FOUND = {("s", "gateway_gap", 2, 5, None), ("s", "gateway_dropped", None, None, 34)}


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_jumps_in_the_numbering_are_rows_and_losses_are_not_jumps(spark, chunk):
    out = gaps.sequence_gaps(spark.createDataFrame(ROWS, NUMBERED), ["session"], chunk)
    assert set(map(tuple, out.collect())) == FOUND


TIMED = NUMBERED + ", ts TIMESTAMP"


def numbered(scope, *rows):
    return [(scope, seq, "message", None, at(t)) for seq, t in rows]


# Rows in the order of their arrival, and between which numbers the gaps are.
NUMBERINGS = {
    "in order": ([(1, 0), (2, 1), (5, 2), (6, 3)], {(3, 5)}),
    "out of order": ([(1, 0), (4, 3), (3, 2), (2, 1)], set()),
    "delivered twice": ([(1, 0), (2, 1), (2, 1), (3, 2)], set()),
    "in order by number, not by time": ([(3, 0), (2, 1), (1, 2), (4, 3)], set()),
}
LATE_NUMBERS = [[(1, 0), (3, 2)], [(4, 100)], [(5, 101)], [(6, 102)], [(2, 1)]]  # 2 comes too late
CLOCK = [[("clock", n, "message", None, at(9000 + 20 * n))] for n in range(2)]


def test_batch_and_stream_find_the_same_jumps(spark, tmp_path):
    rows = [r for case, (told, _) in NUMBERINGS.items() for r in numbered(case, *told)]
    whole = spark.createDataFrame(rows, TIMED).dropDuplicates()
    found = {(case, *gap) for case, (_, gaps_) in NUMBERINGS.items() for gap in gaps_}
    assert {(r["session"], r["expected"], r["received"]) for r in gaps.sequence_gaps(whole).collect()} == found
    out = streamed(
        spark, tmp_path, [rows[::2], rows[1::2], *CLOCK], TIMED,
        lambda df: gaps.stream_sequence_gaps(df, lateness="10 seconds"), "gaps_in_time",
    )
    assert {(r["session"], r["expected"], r["received"]) for r in out} == found


def test_a_number_that_comes_too_late_does_not_mend_its_gap(spark, tmp_path):
    batches = [numbered("s", *told) for told in LATE_NUMBERS]
    out = streamed(
        spark, tmp_path, [*batches, *CLOCK], TIMED,
        lambda df: gaps.stream_sequence_gaps(df, lateness="10 seconds"), "gaps_late",
    )
    in_time = spark.createDataFrame([r for b in batches[:-1] for r in b], TIMED)
    assert [(r["expected"], r["received"]) for r in gaps.sequence_gaps(in_time).collect()] == [(2, 3)]
    assert [(r["expected"], r["received"]) for r in out] == [(2, 3)]


def test_the_stream_reports_losses_and_forgets_a_numbering_not_heard_of(spark, tmp_path):
    rows = [(*r, at(n)) for n, r in enumerate(ROWS)]
    again = [("s", 90, "message", None, at(9000)), ("s", 92, "message", None, at(9001))]
    clock = [[("clock", n, "message", None, at(20000 + 20 * n))] for n in range(2)]
    out = streamed(
        spark, tmp_path, [rows[:1], rows[1:4], rows[4:], [("clock", 0, "message", None, at(8000))], [("clock", 1, "message", None, at(8020))], again, *clock],
        TIMED, lambda df: gaps.stream_sequence_gaps(df, lateness="10 seconds", idle=600), "gap_rows",
    )
    # From 42 to 90 is no gap: the numbering was forgotten in between.
    assert {tuple(None if v != v else v for v in r) for r in out} == FOUND | {("s", "gateway_gap", 91, 92, None)}


LINKED = "serial_number STRING, kind STRING, ts TIMESTAMP"
KINDS = {"up": "ble_connected", "down": "ble_disconnected", "m": "message", "x": "ble_negotiated"}


def linked(device, *marks):
    return [(device, KINDS[kind], at(t)) for kind, t in marks]


# What is said about a link, in the order of its arrival, and (connected, silent from).
LINKS = {
    "a message comes after 900 seconds": ([("up", 0), ("m", 100), ("m", 1000)], {(0, 100)}),
    "a message comes just in time": ([("up", 0), ("m", 100), ("m", 999.999999), ("down", 1500)], set()),
    "silent from the connection on": ([("up", 0), ("down", 900)], {(0, 0)}),
    "not connected": ([("m", 0), ("m", 5000), ("up", 9000), ("down", 9100)], set()),
    "other events are no sign of life": ([("up", 0), ("x", 800), ("x", 1600), ("m", 1700), ("down", 1800)], {(0, 0)}),
    "silence ends the session": ([("up", 0), ("m", 1000), ("m", 5000), ("down", 6000)], {(0, 0)}),
    "a new connection is a new session": ([("up", 0), ("up", 2000), ("m", 4000)], {(0, 0), (2000, 2000)}),
    "down and up in one instant": ([("up", 0), ("m", 500), ("up", 600), ("down", 600), ("m", 1400), ("down", 1500)], set()),
    "still silent": ([("up", 0), ("m", 50)], {(0, 50)}),
    "out of order": ([("m", 1200), ("up", 0), ("m", 1195), ("down", 1300)], {(0, 0)}),
}
LATE_LINK = [[("up", 0)], [("m", 890)], [("m", 2001)], [("m", 2002)], [("m", 2003)], [("m", 1700)]]  # 1700 comes too late
LINK_CLOCK = [[("clock", "message", at(20010 + 20 * n))] for n in range(2)]


def silent(rows):
    assert all(when(r["silent_at"]) == when(r["silent_from"]) + 900 for r in rows)
    return {(r["serial_number"], when(r["connected_at"]), when(r["silent_from"])) for r in rows}


def test_batch_and_stream_find_the_same_silent_links(spark, tmp_path):
    rows = [r for case, (told, _) in LINKS.items() for r in linked(case, *told)]
    found = {(case, *spell) for case, (_, spells) in LINKS.items() for spell in spells}
    for chunk in (1, 2, 10**6):
        out = gaps.silent_links(spark.createDataFrame(rows, LINKED), until=at(20000), rows=chunk)
        assert silent(out.collect()) == found
    out = streamed(
        spark, tmp_path, [rows[1::2] + rows[::2], *LINK_CLOCK], LINKED,
        lambda df: gaps.stream_silent_links(df, lateness="10 seconds"), "links_in_time",
    )
    assert silent(out) == found


def test_a_message_that_comes_too_late_does_not_end_a_silence(spark, tmp_path):
    batches = [linked("D", *told) for told in LATE_LINK]
    out = streamed(
        spark, tmp_path, [*batches, *LINK_CLOCK], LINKED,
        lambda df: gaps.stream_silent_links(df, lateness="10 seconds"), "links_late",
    )
    in_time = spark.createDataFrame([r for b in batches[:-1] for r in b], LINKED)
    assert silent(gaps.silent_links(in_time, until=at(20000)).collect()) == silent(out) == {("D", 0, 890)}


def test_links_without_events_or_instants_are_not_silent(spark):
    empty = spark.createDataFrame([], LINKED)
    assert gaps.silent_links(empty).count() == 0 and gaps.silent_links(empty, until=at(5)).count() == 0
    rows = [("D", KINDS["up"], None), (None, KINDS["up"], at(0)), (None, None, at(5)), (None, "message", at(1000))]
    out = gaps.silent_links(spark.createDataFrame(rows, LINKED)).collect()
    assert [(r["serial_number"], when(r["silent_from"])) for r in out] == [(None, 0)]


def test_silence_is_counted_from_a_quarter_of_an_hour(spark):
    times = [0, 300, 1199, 1200 + 899, 3000, 3000 + 86400 * 3]
    df = spark.createDataFrame([("D", at(t)) for t in times] + [("E", at(5))], "serial_number STRING, ts TIMESTAMP")
    for chunk in (1, 3, 10**6):
        out = gaps.silence_spells(df, rows=chunk).collect()
        spells = sorted((when(r["silent_from"]), when(r["resumed_at"]), r["silent_seconds"]) for r in out)
        assert spells == [(1199, 2099, 900.0), (2099, 3000, 901.0), (3000, 262200, 259200.0)]


def test_the_stream_closes_a_link_after_its_last_message(spark, tmp_path):
    schema = "serial_number STRING, ts TIMESTAMP"
    out = streamed(
        spark, tmp_path, [[("D", at(0)), ("D", at(600))], [("D", at(5000))], [("D", at(50000))], [("D", at(90000))]], schema,
        lambda df: gaps.stream_silence(df, lateness="0 seconds"), "silences",
    )
    assert {(when(r["silent_from"]), r["messages"]) for r in out} >= {(600, 2), (5000, 1)}


def greedy(times, interval):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= interval:
            kept.append(t)
    return kept


@pytest.mark.parametrize("rows, fan", [(12, 3), (60, 64), (10**6, 64)])
def test_throttling_is_greedy_whatever_the_chunks(spark, rows, fan):
    rng = random.Random(rows)
    times = {
        "hot": sorted({rng.randint(0, 3000) for _ in range(500)}),
        "calm": [10, 69, 70, 129, 130, 5000, 5059, 5060],
        "one": [77],
        None: [5, 70],
    }
    df = spark.createDataFrame([(k, at(t)) for k, ts in times.items() for t in ts], "k STRING, ts TIMESTAMP")
    out = throttle(df, ["k"], "ts", 60.0, rows, fan).collect()
    for key, ts in times.items():
        assert sorted(when(r["ts"]) for r in out if r["k"] == key) == greedy(ts, 60), key


def test_many_failures_of_one_instant_let_out_one(spark):
    df = spark.createDataFrame([("a", at(t), n) for t in (0, 60) for n in range(50)] + [("a", None, 7)], "k STRING, ts TIMESTAMP, n INT")
    for rows in (5, 10**6):
        out = throttle(df, ["k"], "ts", 60.0, rows).collect()
        assert sorted((when(r["ts"]), r["n"]) for r in out) == [(0, 0), (60, 0)]
    assert throttle(df.limit(0), ["k"], "ts").collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_functions_of_chunks_compose(seed):
    rng = np.random.default_rng(seed)
    times = np.unique(rng.integers(0, 400, 150))
    pause = int(rng.integers(1, 60))
    cuts = np.sort(rng.choice(np.arange(1, len(times)), 6, replace=False))
    parts = [Outcomes.of(part, pause) for part in np.split(times, cuts)]
    whole = Outcomes.of(times, pause)
    left = functools.reduce(lambda a, b: a.then(b, pause), parts)
    right = functools.reduce(lambda a, b: b.then(a, pause), parts[::-1])
    for kept in [NEVER, *range(int(times[0]) - 70, int(times[0]))]:
        want = np.int64(kept)
        for t in times:
            want = t if t - want >= pause else want
        for found in (whole, left, right):
            assert found.after(np.array([kept]), pause)[0] == want


def test_the_stream_throttles_across_batches(spark, tmp_path):
    schema = "k STRING, ts TIMESTAMP, n BIGINT"
    rows = [("a", at(t), t) for t in (0, 30, 59, 60, 100, 121, 200, 240, 260)]
    out = streamed(
        spark, tmp_path, [rows[:2], rows[2:5], rows[5:]], schema, lambda df: stream_throttle(df, "k", "ts", ["n"]), "kept"
    )
    assert sorted(r["n"] for r in out) == [0, 60, 121, 200, 260]


STEPS = "command_id STRING, kind STRING, ts TIMESTAMP, error STRING, setting STRING, value STRING, serial_number STRING"


def step(c, kind, t, error=None, value=None):
    return (c, f"command_{kind}", at(t), error, "setpoint_celsius" if value else None, value, "D1" if value else None)


COMMANDS = [
    step("ok", "requested", 0, value="5"), step("ok", "sent", 0.1), step("ok", "accepted", 0.2), step("ok", "applied", 2),
    step("no", "requested", 0, value="99"), step("no", "rejected", 0.1, "value_out_of_range"),
    step("lost", "requested", 0, value="4"), step("lost", "sent", 0.1), step("lost", "unconfirmed", 10.1, "no acknowledgement"),
    step("early", "requested", 0, value="3"), step("early", "sent", 0.1), step("early", "applied", 0.15), step("early", "accepted", 0.2),
    step("mute", "requested", 100, value="2"), step("mute", "sent", 100.1),
]


def test_the_steps_of_a_command_fold_into_its_outcome(spark):
    df = spark.createDataFrame(COMMANDS, STEPS)
    rows = {r["command_id"]: r for r in commands.command_outcomes(df).collect()}
    assert {c: r["outcome"] for c, r in rows.items()} == {
        "ok": "applied", "no": "rejected", "lost": "unconfirmed", "early": "pending", "mute": "pending"}
    assert rows["no"]["error"] == "value_out_of_range" and rows["ok"]["value"] == "5"
    late = {r["command_id"]: r["outcome"] for r in commands.command_outcomes(df, now=at(60)).collect()}
    assert late["early"] == "unconfirmed" and late["mute"] == "pending"
    assert {r["command_id"]: r["outcome"] for r in commands.command_outcomes(df, now=at(110.1)).collect()}["mute"] == "unconfirmed"


def test_the_stream_folds_commands_too(spark, tmp_path):
    rows = sorted(COMMANDS[:9], key=lambda r: r[2])
    batches = [rows[:4], rows[4:], [step("x", "requested", 9000, value="1")], [step("y", "requested", 19000, value="1")]]
    out = streamed(spark, tmp_path, batches, STEPS, lambda df: commands.stream_command_outcomes(df, lateness="0 seconds"), "outcomes")
    got = {r["command_id"]: r["outcome"] for r in out}
    assert (got["ok"], got["no"], got["lost"]) == ("applied", "rejected", "unconfirmed")


def test_a_command_is_verified_by_the_first_report_that_shows_it(spark):
    outcomes = commands.command_outcomes(spark.createDataFrame(COMMANDS, STEPS))
    reports = fact(spark, [dict(t=0, setpoint_celsius=5), dict(t=3, setpoint_celsius=5), dict(t=4, setpoint_celsius=5),
                           dict(t=10.2, setpoint_celsius=3), dict(t=5, setpoint_celsius=4)])
    rows = {r["command_id"]: r for r in commands.verify_applied(outcomes, reports).collect()}
    assert when(rows["ok"]["shown_at"]) == 3.0
    # Too late by a tenth; never acknowledged.
    assert [rows[c]["verified"] for c in ("ok", "early", "lost", "no")] == [True, False, False, False]


def test_every_setting_is_verified_as_its_own_type(spark):
    asked = [("a", "setpoint_celsius", "-5"), ("b", "brightness", "high"), ("c", "brightness", "5"), ("d", "unknown", "1"),
             ("e", "setpoint_celsius", "cold")]
    outcomes = spark.createDataFrame(
        [(c, "D1", s, v, at(0.1), at(0.2)) for c, s, v in asked],
        "command_id STRING, serial_number STRING, setting STRING, value STRING, sent_at TIMESTAMP, accepted_at TIMESTAMP",
    )
    reports = fact(spark, [dict(t=3, setpoint_celsius=-5), dict(t=4, brightness="high")])
    rows = {r["command_id"]: r["verified"] for r in commands.verify_applied(outcomes, reports).collect()}
    assert rows == {"a": True, "b": True, "c": False, "d": False, "e": False}


def test_link_sessions_end_with_the_next_disconnection(spark):
    marks = [("up", 0), ("down", 50), ("down", 60), ("up", 100), ("up", 200), ("down", 90000), ("up", 90001)]
    df = spark.createDataFrame([("D", at(t), f"ble_{k}") for k, t in marks] + [("D", at(150), "message")],
                               "serial_number STRING, ts TIMESTAMP, kind STRING")
    for chunk in (1, 2, 10**6):
        out = commands.link_sessions(df, up="ble_up", down="ble_down", rows=chunk).collect()
        spans = sorted((when(r["connected_at"]), when(r["disconnected_at"]), r["seconds"]) for r in out)
        assert spans == [(0, 50, 50.0), (100, None, None), (200, 90000, 89800.0), (90001, None, None)]
    events = df.withColumn("boot_id", F.lit("b")).withColumn("kind", F.regexp_replace("kind", "ble_up", "gateway_connected"))
    assert commands.gateway_sessions(events).count() == 4


def line(n, **more):
    payload = PAYLOAD | {"state_of_charge_percent": 90 - n}
    return json.dumps({"ts": at(n * 300).isoformat().replace("+00:00", "Z"), "uptime_seconds": 10.0 + n * 300, "boot_id": "b", "ts_synced": True,
                       "type": "cooler", "model": "everfrost", "address": "A", "frames": ["00"], "plain": "00", "payload": payload} | more)


def deliver(root, name, lines):
    folder = root / "v1" / "cooler" / "dt=2026-05-10"
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / f"{name}.jsonl.gz", "wt") as file:
        file.write("\n".join(lines) + "\n")


def test_arrivals_are_built_once_and_a_failed_build_is_repeated(spark, tmp_path):
    landing, star = tmp_path / "landing", str(tmp_path / "star")
    places = dict(landing=str(landing), raw=str(tmp_path / "raw"), marts=star, signals=str(tmp_path / "signals"),
                  checkpoint=str(tmp_path / "mark"), calendar_span=("2026-05-01", "2026-05-31"))
    deliver(landing, "000", [line(0), line(1), "", "torn {"])
    event = {k: v for k, v in json.loads(line(0)).items() if k in ("ts", "uptime_seconds", "boot_id", "ts_synced")}
    folder = landing / "v1" / "events" / "dt=2026-05-10"
    folder.mkdir(parents=True)
    (folder / "000.jsonl").write_text(json.dumps(event | dict(type="event", kind="upload_started")) + "\n")

    def failing(*_, **__):
        raise RuntimeError("the build fell over")

    with pytest.raises(Exception, match="fell over"):
        arrivals.run_due(spark, build=failing, **places)
    assert marts.current_version(spark, star) is None
    assert arrivals.run_due(spark, **places) == 1
    assert marts.read_mart(spark, star, "fact_cooler_state_update").count() == 2
    assert arrivals.run_due(spark, **places) == 0  # nothing arrived
    deliver(landing, "001", [line(1), line(2)])  # one of them again
    assert arrivals.run_due(spark, **places) == 1
    rows = marts.read_mart(spark, star, "fact_cooler_state_update").collect()
    assert sorted(r["state_of_charge_percent"] for r in rows) == [88, 89, 90]
    sent = spark.read.schema(schemas.SIGNAL).parquet(places["signals"]).orderBy("run_id").collect()
    assert [(r["rows_arrived"], r["build_passed"]) for r in sent] == [(3, True), (2, True)]
    refused = arrivals.rejected_lines(spark, places["raw"]).collect()
    assert {(r["table"], r["value"], r["reason"]) for r in refused} >= {("raw_cooler", "torn {", "torn"), ("raw_cooler", "", "empty")}


def test_a_raw_table_that_was_replaced_by_a_smaller_one_is_built_anew(spark, tmp_path):
    landing, raw = tmp_path / "landing", tmp_path / "raw"
    places = dict(landing=str(landing), raw=str(raw), marts=str(tmp_path / "star"), signals=str(tmp_path / "signals"),
                  checkpoint=str(tmp_path / "mark"))
    seen = []

    def build(cooler, events, root):
        seen.append((cooler.count(), events.count()))

    def rebuilt():
        return arrivals.run_due(spark, build=build, **places)

    (landing / "v1").mkdir(parents=True)
    assert rebuilt() == 0  # nothing ever landed
    deliver(landing, "000", [line(0), line(1), line(2)])
    deliver(landing, "001", [line(3)])
    assert (rebuilt(), seen) == (1, [(4, 0)])
    assert arrivals.due(spark, str(raw)) == ([("raw_cooler", 4, 0), ("raw_events", 0, 0)], 1)
    batch = next((raw / "raw_cooler").glob("_batch=*"))
    spark.read.parquet(str(batch)).limit(3).write.partitionBy("_ingest_date").parquet(str(tmp_path / "less"))
    spark.read.parquet(str(tmp_path / "less")).write.mode("overwrite").partitionBy("_ingest_date").parquet(str(batch))
    # All three are new, although the mark is above them; afterwards the mark stands at three.
    assert (rebuilt(), rebuilt(), seen[1:]) == (1, 0, [(3, 0)])
    deliver(landing, "002", [line(4)])
    assert (rebuilt(), seen[2:]) == (1, [(4, 0)])
    sent = spark.read.schema(schemas.SIGNAL).parquet(places["signals"]).orderBy("run_id").collect()
    assert [(r["run_id"], r["rows_arrived"]) for r in sent] == [("mark-0", 4), ("mark-1", 3), ("mark-2", 1)]
