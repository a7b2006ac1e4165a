"""The full rebuild: raw records to a published star."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldmart.operators.episodes import pulldown_episodes
from coldmart.operators.slots import slot_snapshot
from coldmart.plans import dims, facts, staging
from coldmart.session import discard, staged, staged_so_far
from coldmart.sources import marts


def staged_reports(
    raw_cooler: DataFrame,
    raw_events: DataFrame,
    report_order: Sequence[Column | str] | None = None,
    handshake_order: Sequence[Column | str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Reports and handshakes, written once: the dimensions and the fact all read them.

    So are the clock anchors, a row per boot, which would cost another pass over raw each.
    """
    anchors = staged(staging.clock_reference(raw_cooler, raw_events), "anchors")
    updates = staged(staging.state_updates(raw_cooler, anchors, report_order), "updates")
    shaken = staged(staging.negotiations(raw_events, anchors, handshake_order), "handshakes")
    return updates, shaken


def build_all(
    raw_cooler: DataFrame,
    raw_events: DataFrame,
    root: str,
    calendar_span: tuple[str, str] = (dims.CALENDAR_START, dims.CALENDAR_END),
    report_order: Sequence[Column | str] | None = None,
    handshake_order: Sequence[Column | str] | None = None,
) -> dict[str, DataFrame]:
    """Every mart, rebuilt whole under a new version and published only when all stand.

    A failure half way leaves the published version untouched, and a retry starts another
    version: running it again is always safe.
    """
    spark = raw_cooler.sparkSession
    version, before = marts.new_version(), staged_so_far(spark)
    updates, shaken = staged_reports(raw_cooler, raw_events, report_order, handshake_order)
    tables = _written(
        spark,
        root,
        version,
        dim_date=lambda: dims.calendar(spark, *calendar_span),
        dim_battery=lambda: dims.battery_dim(updates),
        dim_cooler=lambda: dims.device_versions(shaken, updates),
    )
    fact = facts.state_update_fact(updates, tables["dim_cooler"], tables["dim_battery"])
    fact = marts.write_mart(fact, root, "fact_cooler_state_update", version)
    tables["fact_cooler_state_update"] = fact
    tables |= _written(
        spark,
        root,
        version,
        fact_cooler_snapshot=lambda: slot_snapshot(fact),
        fact_cooler_pulldown=lambda: pulldown_episodes(fact),
    )
    marts.publish(spark, root, version)
    discard(spark, before)  # the marts stand on their own files
    return tables


def _written(
    spark: SparkSession, root: str, version: str, **plans: Callable[[], DataFrame]
) -> dict[str, DataFrame]:
    """Marts that do not depend on each other, as Spark jobs submitted side by side."""

    def write(name: str) -> DataFrame:
        return marts.write_mart(plans[name](), root, name, version)

    with ThreadPoolExecutor(len(plans)) as pool:
        return dict(zip(plans, pool.map(inheritable_thread_target(spark)(write), plans)))


def rebuild_devices(
    raw_cooler: DataFrame,
    raw_events: DataFrame,
    changed: DataFrame,
    root: str,
    report_order: Sequence[Column | str] | None = None,
    handshake_order: Sequence[Column | str] | None = None,
    calendar_span: tuple[str, str] = (dims.CALENDAR_START, dims.CALENDAR_END),
) -> dict[str, DataFrame]:
    """A new version in which only ``changed`` devices (``serial_number``) are recomputed.

    A late record can move any report of its boot to another date, so a changed device is
    recomputed from its whole history; the rows of all others are carried over as they are.
    ``raw_cooler`` and ``raw_events`` may hold just the boots of the changed devices.
    """
    spark = raw_cooler.sparkSession
    version, before = marts.new_version(), marts.current_version(spark, root)
    earlier = staged_so_far(spark)
    # Written once, so that Spark knows how few they are and does not move a device's history for them.
    changed = staged(changed.select("serial_number").distinct(), "changed")
    updates, shaken = staged_reports(raw_cooler, raw_events, report_order, handshake_order)
    updates = updates.join(changed, "serial_number", "left_semi")
    shaken = shaken.join(changed, "serial_number", "left_semi")

    def merged(name: str, fresh: DataFrame) -> DataFrame:
        old = marts.read_mart(spark, root, name, before)
        kept = old.join(changed, "serial_number", "left_anti")
        return kept.unionByName(fresh.select(*old.columns))

    devices = staged(dims.device_versions(shaken, updates), "devices")
    # Batteries move between devices: the earliest sighting of either side stands.
    both = marts.read_mart(spark, root, "dim_battery", before).unionByName(dims.battery_dim(updates))
    packs = both.groupBy("battery_key", "serial_number", "is_absent").agg(
        F.min("first_seen_at").alias("first_seen_at")
    )
    tables = _written(
        spark,
        root,
        version,
        dim_date=lambda: dims.calendar(spark, *calendar_span),
        dim_cooler=lambda: merged("dim_cooler", devices),
        dim_battery=lambda: packs,
    )
    fresh = staged(facts.state_update_fact(updates, devices, tables["dim_battery"]), "fact")
    tables |= _written(
        spark,
        root,
        version,
        fact_cooler_state_update=lambda: merged("fact_cooler_state_update", fresh),
        fact_cooler_snapshot=lambda: merged("fact_cooler_snapshot", slot_snapshot(fresh)),
        fact_cooler_pulldown=lambda: merged("fact_cooler_pulldown", pulldown_episodes(fresh)),
    )
    marts.publish(spark, root, version)
    discard(spark, earlier)
    return tables
