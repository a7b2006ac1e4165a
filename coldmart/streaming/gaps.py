"""What a numbering says is missing, and how long a link was silent."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldmart.operators.ordered import CHUNK_ROWS, MICROS, last_known, neighbours
from coldmart.plans.reading import instant
from coldmart.streaming.in_order import Fold, folded_in_order

# The functions below run in tasks; sent by value they need no package installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sequence_gaps(
    events: DataFrame, scope: Sequence[str] = ("session",), rows: int = CHUNK_ROWS
) -> DataFrame:
    """Where numbers are missing, and where a reader says that it lost some.

    Numbers run within ``scope``. What a reader reports (``dropped``) is one row with its
    ``count``; the numbers before it are thereby explained and make no gap of their own.
    """
    previous = F.col("_previous")
    if "count" not in events.columns:
        events = events.withColumn("count", F.lit(None).cast("bigint"))
    dropped = F.col("kind") == "dropped"
    jump = ~dropped & previous.isNotNull() & (F.col("seq") != previous + 1)
    return (
        neighbours(
            events.select(*scope, "seq", "kind", "count").filter(F.col("seq").isNotNull()),
            list(scope),
            ["seq"],
            lag={"_previous": F.col("seq")},
            rows=rows,
        )
        .filter(dropped | jump)
        .select(
            *scope,
            F.when(dropped, "gateway_dropped").otherwise("gateway_gap").alias("kind"),
            F.when(~dropped, previous + 1).alias("expected"),
            F.when(~dropped, F.col("seq")).alias("received"),
            F.when(dropped, F.col("count")).alias("count"),
        )
    )


def _follow_numbers(idle: int) -> Fold:
    def fold(known, rows, clock):
        expected, last = known or (None, None)
        out = []
        for us, seq, kind, count in sorted(rows, key=lambda row: row[1]):
            if kind == "dropped":
                out.append(("gateway_dropped", None, None, count))
            elif expected is not None and seq > expected:
                out.append(("gateway_gap", expected, seq, None))
            expected = seq + 1 if expected is None else max(expected, seq + 1)
            last = us if last is None else max(last, us)
        if last is None or clock - last >= idle:
            return out, None, None
        return out, (expected, last), last + idle

    return fold


def stream_sequence_gaps(
    events: DataFrame,
    scope: str = "session",
    at: str = "ts",
    lateness: str = "1 minute",
    idle: int = 86_400,
) -> DataFrame:
    """The streaming form: per numbering the number expected next, and when it was last heard of.

    Numbers may come in any order within ``lateness``: they wait until the watermark has passed
    them. A number that comes later than its gap was reported leaves the expectation as it is. A
    numbering not heard of for ``idle`` seconds is forgotten; it would begin anew.
    """
    numbered = events.filter(F.col("seq").isNotNull())
    return folded_in_order(
        numbered, scope, at, lateness, "seq BIGINT, kind STRING, count BIGINT",
        _follow_numbers(idle * MICROS), "expected BIGINT, last BIGINT",
        "kind STRING, expected BIGINT, received BIGINT, count BIGINT",
    )


def silence_spells(
    messages: DataFrame,
    device: str = "serial_number",
    at: str = "ts",
    silence: int = 900,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Stretches of at least ``silence`` seconds without a message on a link."""
    gap = F.unix_micros("_next") - F.unix_micros(at)
    long = gap >= F.lit(silence * 1_000_000)
    return (
        neighbours(
            messages.select(device, at),
            [device],
            [at],
            lead={"_next": F.col(at)},
            rows=rows,
        )
        .filter(long)
        .select(
            device,
            F.col(at).alias("silent_from"),
            F.col("_next").alias("resumed_at"),
            (gap / F.lit(1e6)).alias("silent_seconds"),
        )
    )


def _link_marks(events: DataFrame, up: str, down: str) -> DataFrame:
    """Connections, disconnections and messages; of one instant they count in the order of ``_rank``."""
    rank = F.when(F.col("kind") == down, 0).when(F.col("kind") == up, 1).when(F.col("kind") == "message", 2)
    return events.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())


def silent_links(
    events: DataFrame,
    device: str = "serial_number",
    at: str = "ts",
    silence: int = 900,
    until: dt.datetime | None = None,
    up: str = "ble_connected",
    down: str = "ble_disconnected",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Links on which no message came for ``silence`` seconds while they were connected.

    A connection counts as a sign of life, other events do not, and a link that is down is not
    silent. Silence ends the session: what is said after it counts from the next connection on.
    Asked as of ``until``, a link still silent then is found too, and nothing later is looked at.
    Events without an instant take no part. One row a session at most.
    """
    marks = _link_marks(events, up, down).filter(F.col(at).isNotNull())
    end = F.col("_next")
    if until is not None:
        marks = marks.filter(F.col(at) <= instant(until))
        end = F.coalesce(end, instant(until))
    order = [at, "_rank"]
    ahead = neighbours(
        marks.select(device, at, "_rank"), [device], order, lead={"_next": F.col(at)}, rows=rows, keep_chunk=True
    )
    said = F.when(F.col("_rank") < 2, F.struct((F.col("_rank") == 1).alias("up"), F.col(at).alias("since")))
    silent_from = F.min(at)
    return (
        last_known(ahead, [device], order, "_link", said, rows)
        .filter(F.col("_link.up") & (F.unix_micros(end) - F.unix_micros(at) >= silence * MICROS))
        .groupBy(device, F.col("_link.since").alias("connected_at"))
        .agg(silent_from.alias("silent_from"))
        .withColumn("silent_at", F.timestamp_micros(F.unix_micros("silent_from") + silence * MICROS))
    )


def _follow_link(silence: int) -> Fold:
    def fold(known, rows, clock):
        since, last = known or (None, None)
        out = []
        for us, rank in [*rows, (clock, None)]:
            if since is not None and us - last >= silence:
                out.append((since, last))
                since = None
            if rank == 0:
                since = None
            elif rank == 1:
                since = last = us
            elif rank == 2 and since is not None:
                last = us
        return out, None if since is None else (since, last), None if since is None else last + silence

    return fold


def stream_silent_links(
    events: DataFrame,
    device: str = "serial_number",
    at: str = "ts",
    silence: int = 900,
    lateness: str = "1 minute",
    up: str = "ble_connected",
    down: str = "ble_disconnected",
) -> DataFrame:
    """Streaming form of ``silent_links``: found when the watermark is ``silence`` past the last message.

    A link that is down or was found silent has no state.
    """
    found = folded_in_order(
        _link_marks(events, up, down).withColumnRenamed("_rank", "rank"), device, at, lateness, "rank INT",
        _follow_link(silence * MICROS), "since BIGINT, last BIGINT", "since BIGINT, last BIGINT",
    )
    return found.select(
        device,
        F.timestamp_micros("since").alias("connected_at"),
        F.timestamp_micros("last").alias("silent_from"),
        F.timestamp_micros(F.col("last") + silence * MICROS).alias("silent_at"),
    )


def stream_silence(
    messages: DataFrame,
    device: str = "serial_number",
    at: str = "ts",
    silence: int = 900,
    lateness: str = "1 hour",
) -> DataFrame:
    """Streaming form: a session window closes ``silence`` seconds after its last message."""
    return (
        messages.withWatermark(at, lateness)
        .groupBy(device, F.session_window(at, f"{silence} seconds"))
        .agg(F.count(F.lit(1)).alias("messages"), F.max(at).alias("silent_from"))
        .select(device, "messages", "silent_from")
    )
