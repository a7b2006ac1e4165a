"""Cool-down episodes: an accumulating snapshot out of a per-device state machine.

An episode opens on a report ``rise`` degrees or more above its setpoint that the report
before it was not (or that has no usable report before it), unless one is open already. It
ends on the first report within ``reach`` of the setpoint, or where recording breaks off.

The state machine only needs, at any row, the last thing that happened before it: an
opening or an ending. So a device's history does not have to sit in one task:

1. Every report is told its neighbours, and long histories are cut into chunks by their
   number of rows (``ordered.neighbours``).
2. Within a chunk, rows between two endings form a block, and a block from its first
   opening on is a candidate episode. Blocks are reduced to one partial row each.
3. What a chunk cannot know is whether an episode was open when it began. Only its first
   block and an unfinished last block depend on that; those few partials per chunk meet in
   one window per device. Finished blocks in between are episodes already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldmart.functions import date_key, jst_date, whole_millis_between
from coldmart.operators.ordered import CHUNK_ROWS, MICROS, neighbours

_SUMS = ("held", "discharged", "charged", "ambient", "ambient_weight", "external")


def flag_reports(
    fact: DataFrame, device: str, rise: int, reach: int, silence: int, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Reports with ``_opens``, ``_ends`` and their chunk; the last one of a device may not end."""
    # What an episode is made of.
    columns = [
        device, "state_update_key", "cooler_key", "battery_key", "boot_id", "updated_at",
        "held_seconds", "setpoint_celsius", "interior_temperature_celsius",
        "state_of_charge_percent", "battery_state", "external_input",
        "discharged_watt_hours", "charged_watt_hours", "ambient_temperature_celsius",
    ]
    above = F.col("interior_temperature_celsius") >= F.col("setpoint_celsius") + F.lit(rise)
    at_setpoint = F.col("interior_temperature_celsius") <= F.col("setpoint_celsius") + F.lit(reach)
    quiet = F.lit(silence * MICROS)
    before = F.struct("boot_id", "_at", "battery_state", "setpoint_celsius", above.alias("above"))
    told = neighbours(
        fact.select(*columns, F.unix_micros("updated_at").alias("_at")),
        [device],
        ["updated_at", "state_update_key"],
        lag={"_before": before},
        lead={"_after": F.struct("boot_id", "_at")},
        rows=rows,
        keep_chunk=True,
    )
    discontinuous = (
        F.col("_before").isNull()
        | (F.col("_before.boot_id") != F.col("boot_id"))
        | (F.col("_before.battery_state") == "absent")
        | (F.col("_at") - F.col("_before._at") >= quiet)
    )
    breaks = (
        (F.col("battery_state") == "absent")
        | (F.col("_after.boot_id") != F.col("boot_id"))
        | (F.col("_after._at") - F.col("_at") >= quiet)
    )
    return (
        told.withColumn("_reached", F.coalesce(at_setpoint, F.lit(False)))
        .withColumn("_discontinuous", F.coalesce(discontinuous, F.lit(False)))
        .withColumn(
            "_opens",
            F.coalesce(
                above & (F.col("_discontinuous") | ~F.coalesce("_before.above", F.lit(False))),
                F.lit(False),
            ),
        )
        .withColumn("_ends", F.col("_reached") | F.coalesce(breaks, F.lit(False)))
        .withColumn("_previous_setpoint", F.col("_before.setpoint_celsius"))
    )


def _partials(flagged: DataFrame, device: str) -> DataFrame:
    """One row per (device, chunk, block, opened): everything an episode is made of."""
    series = Window.partitionBy(device, "_chunk").orderBy("updated_at", "state_update_key")
    over = F.col("_ends")
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    # Opened within its block: it opens, or the last thing before it in the chunk did.
    state = F.when(over, F.lit(False)).when(F.col("_opens"), F.lit(True))
    running = F.coalesce(F.last(state, ignorenulls=True).over(earlier), F.lit(False))
    order = F.struct("updated_at", "state_update_key")
    held = F.col("held_seconds")
    parts = {
        "held": held,
        "discharged": F.col("discharged_watt_hours"),
        "charged": F.col("charged_watt_hours"),
        "ambient": F.col("ambient_temperature_celsius") * held,
        "ambient_weight": F.when(F.col("ambient_temperature_celsius").isNotNull(), held),
        "external": F.when(F.col("external_input"), held).otherwise(F.lit(0.0)),
    }
    return (
        flagged.withColumn(
            "_block", F.coalesce(F.count_if(over).over(earlier), F.lit(0).cast("bigint"))
        )
        .withColumn("_opened", F.col("_opens") | running)
        # Before its first opening a later block belongs to nothing: an ending came before.
        .filter((F.col("_block") == 0) | F.col("_opened"))
        .groupBy(device, "_chunk", "_block", "_opened")
        .agg(
            F.count(F.lit(1)).alias("update_count"),
            F.min_by(
                F.struct(
                    "updated_at",
                    "state_update_key",
                    "cooler_key",
                    "battery_key",
                    "setpoint_celsius",
                    "_previous_setpoint",
                    "interior_temperature_celsius",
                    "state_of_charge_percent",
                    "_discontinuous",
                ),
                order,
            ).alias("opening"),
            F.max_by(
                F.struct(
                    "updated_at",
                    "state_update_key",
                    "state_of_charge_percent",
                    "_reached",
                    F.col("_ends").alias("ends"),
                ),
                order,
            ).alias("closing"),
            # The report that ends an episode holds for no time within it.
            *[F.sum(F.when(~over, e)).alias(f"sum_{n}") for n, e in parts.items()],
        )
    )


def _assemble(partials: DataFrame, device: str) -> DataFrame:
    """Join partials across chunk borders; adds the start of the episode each belongs to."""
    ends = F.col("closing.ends")
    edge = (F.col("_block") == 0) | ~ends
    series = Window.partitionBy(device, "_group").orderBy("_chunk", "_block", "_opened")
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.when(F.col("_over"), F.lit(False)).when(F.col("_opened"), F.lit(True))
    return (
        partials.withColumn("_group", F.when(~edge, F.col("_chunk")))
        .withColumn("_over", ends)
        .withColumn("_state", state)
        .withColumn(
            "_running", F.coalesce(F.last("_state", ignorenulls=True).over(earlier), F.lit(False))
        )
        .withColumn("_starts", F.col("_opened") & ~F.col("_running"))
        .filter(F.col("_running") | F.col("_opened"))
        .withColumn(
            "_start",
            F.last(
                F.when(
                    F.col("_starts"), F.struct("opening.updated_at", "opening.state_update_key")
                ),
                ignorenulls=True,
            ).over(upto),
        )
    )


def pulldown_episodes(
    fact: DataFrame,
    device: str = "serial_number",
    rise: int = 5,
    reach: int = 1,
    silence: int = 900,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    flagged = flag_reports(fact, device, rise, reach, silence, rows)
    members = _assemble(_partials(flagged, device), device)

    def total(name: str) -> Column:
        return F.sum(F.coalesce(F.col(f"sum_{name}"), F.lit(0.0))).alias(f"_{name}")

    closing = F.struct(
        "closing.updated_at",
        "closing.state_update_key",
        "closing.state_of_charge_percent",
        "closing._reached",
        F.col("_over").alias("over"),
    )
    episodes = members.groupBy(device, "_start").agg(
        F.sum("update_count").alias("update_count"),
        F.min_by("opening", F.struct("_chunk", "_block", "_opened")).alias("o"),
        F.max_by(closing, F.struct("_chunk", "_block", "_opened")).alias("c"),
        *[total(name) for name in _SUMS],
    )
    over, reached = F.col("c.over"), F.col("c.over") & F.col("c._reached")
    lasted = whole_millis_between(F.col("o.updated_at"), F.col("c.updated_at")) / F.lit(1000.0)
    started = F.col("o.updated_at")
    return episodes.select(
        device,
        F.col("o.state_update_key").alias("pulldown_key"),
        F.col("o.cooler_key").alias("cooler_key"),
        F.col("o.battery_key").alias("battery_key"),
        date_key(started).alias("date_key"),
        jst_date(started).alias("partition_date"),
        started.alias("started_at"),
        F.when(reached, F.col("c.updated_at")).alias("reached_at"),
        F.when(over, F.col("c.updated_at")).alias("ended_at"),
        F.when(F.col("o._discontinuous"), "start_up")
        .when(F.col("o._previous_setpoint") > F.col("o.setpoint_celsius"), "setpoint_change")
        .otherwise("rise")
        .alias("trigger"),
        F.when(reached, "reached").when(over, "interrupted").alias("outcome"),
        F.col("o.interior_temperature_celsius").alias("interior_temperature_start_celsius"),
        F.col("o.setpoint_celsius").alias("setpoint_celsius"),
        F.col("o.state_of_charge_percent").alias("state_of_charge_start_percent"),
        F.when(over, F.col("c.state_of_charge_percent") - F.col("o.state_of_charge_percent"))
        .alias("state_of_charge_delta_percent"),
        F.when(reached, lasted).alias("duration_seconds"),
        F.when(over, lasted).alias("elapsed_seconds"),
        F.col("_discharged").alias("discharged_watt_hours"),
        F.col("_charged").alias("charged_watt_hours"),
        F.try_divide(F.col("_ambient"), F.col("_ambient_weight")).alias(
            "ambient_temperature_celsius"
        ),
        F.try_divide(F.col("_external"), F.col("_held")).alias("external_input_ratio"),
        F.col("_held").alias("covered_seconds"),
        "update_count",
    )
