"""Commands and links: steps folded into one row each."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.operators.ordered import CHUNK_ROWS, MICROS, chunk_index, neighbours
from coldmart.plans.reading import instant

# The steps a command goes through, and how long it is waited for.
STEPS = ("requested", "rejected", "sent", "accepted", "applied", "unconfirmed")
TIMEOUT_SECONDS = 10

# What can be set, and as what its reports show it.
SETTINGS = {
    "setpoint_celsius": "bigint",
    "display_unit": "string",
    "protection_level": "string",
    "brightness": "string",
}


def command_outcomes(
    events: DataFrame, at: str = "ts", now: dt.datetime | None = None
) -> DataFrame:
    """One row per command: when each step happened and how it came out.

    ``applied`` counts only after the acknowledgement. A command sent and never heard of
    again is unconfirmed once its timeout has passed (``now``), pending before that.
    """
    steps = events.filter(F.col("command_id").isNotNull() & F.col("kind").startswith("command_"))
    kind = F.col("kind")
    asked = kind == "command_requested"
    extra = [c for c in ("serial_number", "setting", "value") if c in events.columns]
    folded = steps.groupBy("command_id").agg(
        *[F.min(F.when(kind == f"command_{s}", F.col(at))).alias(f"{s}_at") for s in STEPS],
        *[F.min(F.when(asked, F.col(c))).alias(c) for c in extra],
        F.min(F.when(F.col("error").isNotNull(), F.struct(at, "error")))["error"].alias("error"),
    )
    late = (
        F.lit(False)
        if now is None
        else F.col("sent_at").isNotNull()
        & (F.unix_micros("sent_at") + TIMEOUT_SECONDS * MICROS <= F.unix_micros(instant(now)))
    )
    return folded.withColumn("outcome", _outcome(late))


def _outcome(late: Column) -> Column:
    """How a command came out; ``late`` says that a sent one has been waited for long enough."""
    shown = F.col("accepted_at").isNotNull() & (F.col("applied_at") >= F.col("accepted_at"))
    return (
        F.when(F.col("rejected_at").isNotNull(), "rejected")
        .when(shown, "applied")
        .when(F.col("unconfirmed_at").isNotNull() | late, "unconfirmed")
        .otherwise("pending")
    )


def stream_command_outcomes(
    events: DataFrame, at: str = "ts", lateness: str = "1 minute", window: str = "1 minute"
) -> DataFrame:
    """Streaming form: a command's steps lie within its timeout, so they share a session.

    A session closes after the timeout, so a command that was sent by then is late; one that was
    only asked for is pending, as in the batch form.
    """
    kind = F.col("kind")
    steps = events.filter(F.col("command_id").isNotNull() & kind.startswith("command_"))
    folded = (
        steps.withWatermark(at, lateness)
        .groupBy("command_id", F.session_window(at, window))
        .agg(*[F.min(F.when(kind == f"command_{s}", F.col(at))).alias(f"{s}_at") for s in STEPS])
    )
    return folded.drop("session_window").withColumn("outcome", _outcome(F.col("sent_at").isNotNull()))


def verify_applied(
    commands: DataFrame,
    reports: DataFrame,
    device: str = "serial_number",
    at: str = "updated_at",
    settings: Mapping[str, str] = SETTINGS,
    timeout: int = TIMEOUT_SECONDS,
) -> DataFrame:
    """Re-derive from the reports whether an acknowledged command took effect.

    The first report after the acknowledgement and within the timeout of sending that shows
    the value asked for, read as the type of its own setting. Commands and reports meet per
    device and minute, not per device.
    """
    shown = [name for name in settings if name in reports.columns]
    minute = 60 * MICROS
    accepted = commands.filter(
        F.col("accepted_at").isNotNull() & F.col("setting").isin(shown)
    ).select(
        "command_id",
        device,
        F.col("setting").alias("_setting"),
        F.col("value").alias("_asked"),
        F.unix_micros("accepted_at").alias("_from"),
        (F.unix_micros("sent_at") + F.lit(timeout * MICROS)).alias("_until"),
    )
    filed = accepted.filter(F.col("_until") > F.col("_from")).withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                chunk_index(F.col("_from"), minute), chunk_index(F.col("_until"), minute)
            )
        ),
    )
    seen = reports.select(
        device, F.unix_micros(at).alias("_at"), *[F.col(name).alias(f"_has_{name}") for name in shown]
    ).withColumn("_bucket", chunk_index(F.col("_at"), minute))
    met = F.lit(False)
    for name in shown:
        asked = F.col("_asked").try_cast(settings[name])
        met = met | ((F.col("_setting") == name) & F.coalesce(F.col(f"_has_{name}") == asked, F.lit(False)))
    first = (
        filed.join(seen, [device, "_bucket"])
        .filter(
            (F.col("_at") > F.col("_from"))
            & (F.col("_at") <= F.col("_until"))
            & met
        )
        .groupBy("command_id")
        .agg(F.timestamp_micros(F.min("_at")).alias("shown_at"))
    )
    return commands.join(first, "command_id", "left").withColumn(
        "verified", F.col("shown_at").isNotNull()
    )


def link_sessions(
    events: DataFrame,
    keys: Sequence[str] = ("serial_number",),
    at: str = "ts",
    up: str = "ble_connected",
    down: str = "ble_disconnected",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Spans during which a link was up; one never seen to end has no end.

    A span opens on every ``up``. It ended if the next thing said about the link is
    ``down``; if that is another ``up``, its end went unrecorded.
    """
    marks = events.filter(F.col("kind").isin(up, down)).select(*keys, at, "kind")
    spans = neighbours(
        marks,
        list(keys),
        [at, "kind"],
        lead={"_next_kind": F.col("kind"), "_next_at": F.col(at)},
        rows=rows,
    ).filter(F.col("kind") == up)
    ended = F.when(F.col("_next_kind") == down, F.col("_next_at"))
    return spans.select(
        *keys,
        F.col(at).alias("connected_at"),
        ended.alias("disconnected_at"),
        ((F.unix_micros(ended) - F.unix_micros(at)) / F.lit(1e6)).alias("seconds"),
    )


def gateway_sessions(events: DataFrame, keys: Sequence[str] = ("boot_id",)) -> DataFrame:
    """Spans during which the collector had the gateway's stream."""
    return link_sessions(events, keys, up="gateway_connected", down="gateway_disconnected")
