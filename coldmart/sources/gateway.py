"""Gateway envelopes to collection records."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart import schemas
from coldmart.schemas import RAW_COOLER, RAW_EVENTS, REQUIRED_PAYLOAD

# What the envelope adds for its own numbering.
ENVELOPE = ("seq", "connection")
ENUMERATIONS = {
    "display_unit": schemas.DISPLAY_UNITS,
    "battery_state": schemas.BATTERY_STATES,
    "protection_level": schemas.PROTECTION_LEVELS,
    "brightness": schemas.BRIGHTNESS_LEVELS,
}


def describes_state(payload: str = "payload") -> Column:
    """The payload is one the raw contract describes: complete, and every code known."""
    complete = [F.col(f"{payload}.{name}").isNotNull() for name in REQUIRED_PAYLOAD]
    known = [F.col(f"{payload}.{n}").isin(*values) for n, values in ENUMERATIONS.items()]
    return reduce(and_, [*complete, *known])


def _shaped(df: DataFrame, schema, given: dict[str, Column]) -> DataFrame:
    return df.select(
        *[
            (
                given[f.name]
                if f.name in given
                else F.col(f.name)
                if f.name in df.columns
                else F.lit(None)
            )
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def records_from_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cooler records, event records) out of the events a gateway serves.

    Messages go to the first; where a payload has fields or values unknown to the schema, only
    its frames stay. Everything else goes to the second, and losses that the gateway reports are
    named ``gateway_dropped`` there. Numbers of envelopes are for ``streaming.gaps`` alone.
    """
    stampless = F.col("ts").isNull() | F.col("uptime_seconds").isNull() | F.col("boot_id").isNull()
    usable = events.filter(F.col("kind").isNotNull() & ~stampless)
    message = F.col("kind") == "message"
    shaped = F.col("model").isNotNull() & F.col("address").isNotNull() & F.col("frames").isNotNull()
    cooler = _shaped(
        usable.filter(message & shaped),
        RAW_COOLER,
        {
            "type": F.lit("cooler"),
            "payload": F.when(F.coalesce(describes_state(), F.lit(False)), F.col("payload")),
        },
    )
    kept = _shaped(
        usable.filter(~message),
        RAW_EVENTS,
        {
            "type": F.lit("event"),
            "kind": F.when(F.col("kind") == "dropped", "gateway_dropped").otherwise(F.col("kind")),
        },
    )
    return cooler, kept
