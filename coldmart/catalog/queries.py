"""Registered queries: name -> (session, data folder) -> DataFrame.

Instants leave as microseconds since the epoch and dates as text, so that two engines can
be compared without agreeing on a timestamp type. Sums of doubles depend on the order of
their terms; they are rounded to seven decimals, results of whole-number sums are not.
(Watts times milliseconds over 3,600,000 never end in a 5 at the eighth decimal, but often
at the seventh: one decimal less would round ties, which the engines settle differently.)
"""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldmart.catalog import adapters as A
from coldmart.catalog.messages import messages
from coldmart.catalog.star import CALENDAR_SPAN, star
from coldmart.functions import iso_week_key
from coldmart.operators import folding
from coldmart.operators.asof import asof_version
from coldmart.operators.bands import band, with_band
from coldmart.operators.dedup import copies_disagree, one_copy
from coldmart.operators.episodes import pulldown_episodes
from coldmart.operators.slots import allocate, observed_span, slot_snapshot
from coldmart.operators.wire import audit_frames, backfill_payload, explode_tlv
from coldmart.plans import dims, facts, outlook, quality, reading, staging
from coldmart.plans.build import build_all, rebuild_devices, staged_reports
from coldmart.schemas import SIGNAL
from coldmart.session import shared_folder, tune
from coldmart.sources import chunks, gateway, signals
from coldmart.sources.seeds import UNITS, read_seed
from coldmart.streaming import arrivals, commands, gaps
from coldmart.streaming.throttle import throttle

Query = Callable[[SparkSession, str], DataFrame]

# The moments the point-in-time queries are asked for.
NOW = dt.datetime(2024, 1, 20, 12, 3, tzinfo=dt.timezone.utc)
START = dt.datetime(2024, 1, 8, 3, 30, tzinfo=dt.timezone.utc)
END = dt.datetime(2024, 1, 22, 18, 0, tzinfo=dt.timezone.utc)

_registered: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    _registered[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_registered)


def plain(df: DataFrame, rounded: Iterable[str] = ()) -> DataFrame:
    """Instants to microseconds, dates to text, ints to BIGINT, named doubles rounded."""
    rounded, out = set(rounded), []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.unix_micros(column.cast("timestamp"))
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            column = column.cast("bigint")
        elif field.name in rounded:
            column = F.round(column, 7) + F.lit(0.0)
        out.append(column.alias(field.name))
    return df.select(*out)


def _raw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return A.raw_cooler(spark, sf), A.raw_events(spark, sf)


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    cooler, events = _raw(spark, sf)
    return staging.state_updates(cooler, staging.clock_reference(cooler, events), A.REPORT_ORDER)


def _fact(spark: SparkSession, sf: str) -> DataFrame:
    return star(spark, sf)["fact_cooler_state_update"]


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return star(spark, sf)["fact_cooler_snapshot"]


def _pulldowns(spark: SparkSession, sf: str) -> DataFrame:
    return star(spark, sf)["fact_cooler_pulldown"]


# ------------------------------------------------------------------- staging


@query
def one_copy_by_row_text(spark, sf):
    """One order of each customer and priority: the smallest by the default order, a row's own text."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    told = orders.select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")
    return plain(one_copy(told, ["o_custkey", "o_orderpriority"]))


@query
def one_copy_reports(spark, sf):
    kept = one_copy(
        staging.complete_reports(A.raw_cooler(spark, sf)), staging.REPORT_KEYS, A.REPORT_ORDER
    )
    return plain(
        kept.select(
            "boot_id", "uptime_seconds", "ts", "payload.state_of_charge_percent",
            "payload.battery_state",
            F.col("environment.temperature_celsius").alias("ambient_temperature_celsius"),
        ),
        ["ambient_temperature_celsius"],
    )


@query
def clock_reference(spark, sf):
    return plain(staging.clock_reference(*_raw(spark, sf)))


@query
def state_updates(spark, sf):
    return plain(_updates(spark, sf).drop("model", "address"), ["ambient_temperature_celsius"])


@query
def negotiations(spark, sf):
    cooler, events = _raw(spark, sf)
    anchors = staging.clock_reference(cooler, events)
    return plain(staging.negotiations(events, anchors, A.HANDSHAKE_ORDER))


# ---------------------------------------------------------------- dimensions


@query
def device_versions(spark, sf):
    updates, shaken = staged_reports(*_raw(spark, sf), A.REPORT_ORDER, A.HANDSHAKE_ORDER)
    return plain(dims.device_versions(shaken, updates))


@query
def battery_dim(spark, sf):
    return plain(dims.battery_dim(_updates(spark, sf)))


@query
def calendar_order_days(spark, sf):
    """The calendar over the span of ``orders``, one row per day."""
    ends = spark.read.parquet(f"{sf}/orders.parquet").agg(
        F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")
    )
    days = ends.select(F.explode(F.sequence("a", "b")).alias("date"))
    return plain(dims.calendar_of(days, read_seed(spark, "japanese_holidays")))


@query
def calendar_thirty_years_on(spark, sf):
    """The span of ``orders`` thirty years later, which has the years whose holidays are known."""
    moved = F.add_months(F.col("o_orderdate").cast("date"), 360)
    ends = spark.read.parquet(f"{sf}/orders.parquet").agg(F.min(moved).alias("a"), F.max(moved).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("date"))
    return plain(dims.calendar_of(days, read_seed(spark, "japanese_holidays")))


# --------------------------------------------------------------------- facts


@query
def state_update_fact(spark, sf):
    updates, shaken = staged_reports(*_raw(spark, sf), A.REPORT_ORDER, A.HANDSHAKE_ORDER)
    devices, batteries = dims.device_versions(shaken, updates), dims.battery_dim(updates)
    return _fact_rows(facts.state_update_fact(updates, devices, batteries))


def _fact_rows(fact: DataFrame) -> DataFrame:
    return plain(
        fact.drop("display_unit", "protection_level", "brightness", "ambient_humidity_percent"),
        ["ambient_temperature_celsius"],
    )


@query
def rebuilt_devices(spark, sf):
    """The fact after half of one device's records came late and that device alone was rebuilt."""
    cooler, events = _raw(spark, sf)
    mine, late = F.col("boot_id").startswith("COOLER-1/"), F.col("ts") >= F.lit(START)
    root = f"{shared_folder(spark)}/coldmart/rebuilt-{uuid.uuid4().hex}"
    options = (A.REPORT_ORDER, A.HANDSHAKE_ORDER)
    build_all(cooler.filter(~(mine & late)), events.filter(~(mine & late)), root, CALENDAR_SPAN, *options)
    changed = spark.createDataFrame([("COOLER-1",)], "serial_number STRING")
    tables = rebuild_devices(cooler.filter(mine), events.filter(mine), changed, root, *options, CALENDAR_SPAN)
    return _fact_rows(tables["fact_cooler_state_update"])


@query
def star_enrichment(spark, sf):
    """Energy by firmware, battery presence and kind of day, over the whole star."""
    t = star(spark, sf)
    wide = facts.star(
        t["fact_cooler_state_update"], t["dim_cooler"], t["dim_battery"], t["dim_date"]
    )
    out = wide.groupBy("serial_number", "firmware_version", "is_absent", "is_weekend").agg(
        F.count(F.lit(1)).alias("reports"),
        F.sum("discharged_watt_hours").alias("discharged_watt_hours"),
        F.sum("held_seconds").alias("held_seconds"),
    )
    return plain(out, ["discharged_watt_hours", "held_seconds"])


@query
def slot_snapshot_rows(spark, sf):
    return plain(slot_snapshot(_fact(spark, sf)), ["ambient_temperature_celsius"])


@query
def slot_allocation(spark, sf):
    pieces = allocate(_fact(spark, sf)).filter("_counts")
    return plain(
        pieces.select(
            "state_update_key",
            F.col("_slot").alias("slot_us"),
            F.col("_overlap").alias("overlap_ms"),
        )
    )


@query
def observed_spans(spark, sf):
    return plain(observed_span(_fact(spark, sf)))


EPISODE_SUMS = [
    "discharged_watt_hours", "charged_watt_hours", "ambient_temperature_celsius",
    "external_input_ratio", "covered_seconds",
]


@query
def pulldown_rows(spark, sf):
    return plain(pulldown_episodes(_fact(spark, sf)), EPISODE_SUMS)


@query
def trigger_stats(spark, sf):
    return plain(outlook.trigger_stats(_pulldowns(spark, sf)), ["mean_duration_seconds"])


# --------------------------------------------------------------------- folds

FOLDED = [
    "covered_seconds", "discharged_watt_hours", "charged_watt_hours", "input_watt_hours",
    "usb_a_output_watt_hours", "usb_c_output_watt_hours", "ambient_temperature_celsius",
    "ambient_humidity_percent", "interior_temperature_celsius", "setpoint_celsius",
    "external_input_ratio", "charging_ratio",
]


@query
def slot_fold_hour(spark, sf):
    return plain(folding.fold(_snapshot(spark, sf), 4), FOLDED)


@query
def slot_fold_day(spark, sf):
    return plain(folding.fold(_snapshot(spark, sf), 96), FOLDED)


@query
def latest_stretch(spark, sf):
    """Each device's last recording without a hole, over its whole history."""
    stretch = folding.latest_stretch(_snapshot(spark, sf))
    return plain(stretch.select("serial_number", "slot_started_at", "covered_seconds"))


@query
def resample_20(spark, sf):
    """The latest recording of each device, five hours (20 slots) to a point."""
    return plain(folding.resample(_snapshot(spark, sf), 20), FOLDED)


@query
def resample_longest(spark, sf):
    """As ``resample_20``, of each device's longest recording without a hole."""
    series = Window.partitionBy("serial_number").orderBy("slot_started_at")
    stretches = _snapshot(spark, sf).withColumn(
        "_stretch", F.count_if(F.col("covered_seconds") <= 0).over(series)
    )
    heard = stretches.filter("covered_seconds > 0")
    longest = (
        heard.groupBy("serial_number", "_stretch")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("serial_number")
        .agg(F.max_by("_stretch", F.struct("n", "_stretch")).alias("_stretch"))
    )
    chosen = heard.join(longest, ["serial_number", "_stretch"]).drop("_stretch")
    return plain(folding.resample(chosen, 20), FOLDED)


@query
def complete_daily_series(spark, sf):
    """Which daily measures have a value on every day of every device's calendar."""
    days = folding.fold(_snapshot(spark, sf), 96)
    long = days.unpivot(
        ["serial_number", "slot_started_at"],
        ["ambient_temperature_celsius", "interior_temperature_celsius", "external_input_ratio"],
        "measure",
        "value",
    ).withColumn("series", F.concat_ws("/", "serial_number", "measure"))
    out = folding.complete_series(long, "series", "slot_started_at", "value")
    return plain(out.select("series", "slot_started_at", "value"), ["value"])


# --------------------------------------------------------------------- bands


def _band_totals(df: DataFrame, value: str, name: str, spark: SparkSession) -> DataFrame:
    banded = with_band(df, F.col(value), band(spark, name), "band")
    return banded.groupBy(
        F.lit(name).alias("band"), "band_key", "band_label", "band_order"
    ).agg(F.count(F.lit(1)).alias("reports"), F.sum("held_seconds").alias("held_seconds"))


BAND_VALUES = {
    "setpoint": "setpoint_celsius",
    "ambient_temperature": "ambient_temperature_celsius",
    "interior_temperature": "interior_temperature_celsius",
    "interior_delta": "interior_delta_celsius",
    "humidity": "ambient_humidity_percent",
    "state_of_charge": "state_of_charge_percent",
    "input_power": "input_watts",
    "charge_power": "charge_watts",
    "discharge_power": "discharge_watts",
}


def _band_query(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        fact = _fact(spark, sf).withColumn(
            "interior_delta_celsius",
            F.col("interior_temperature_celsius") - F.col("setpoint_celsius"),
        )
        return plain(_band_totals(fact, BAND_VALUES[name], name, spark), ["held_seconds"])

    run.__name__ = f"band_{name}"
    query(run)


for _name in UNITS:
    _band_query(_name)


@query
def band_lineitem_quantity(spark, sf):
    """``lineitem`` by the band its quantity falls in (the input power cuts)."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_linenumber")
    banded = with_band(items, F.col("l_quantity"), band(spark, "input_power"), "band")
    return plain(
        banded.groupBy("band_key", "band_label").agg(
            F.count(F.lit(1)).alias("items"), F.sum("l_linenumber").cast("bigint").alias("lines")
        )
    )


# --------------------------------------------------------------------- reads


@query
def latest_state(spark, sf):
    return plain(reading.latest_state(_fact(spark, sf)), ["ambient_temperature_celsius"])


@query
def latest_state_at(spark, sf):
    return plain(reading.latest_state(_fact(spark, sf), NOW), ["ambient_temperature_celsius"])


@query
def energy_between(spark, sf):
    out = reading.energy_between(_fact(spark, sf), START, END)
    return plain(out, ["discharged_watt_hours", "charged_watt_hours"])


@query
def weeks_with_updates(spark, sf):
    return reading.weeks_with_updates(_fact(spark, sf), START, END)


@query
def state_updates_between(spark, sf):
    return plain(
        reading.state_updates_between(_fact(spark, sf), START, END), ["ambient_temperature_celsius"]
    )


@query
def snapshots_between(spark, sf):
    return plain(
        reading.snapshots(_snapshot(spark, sf), START, END), ["ambient_temperature_celsius"]
    )


@query
def finished_pulldowns(spark, sf):
    out = reading.finished_pulldowns_between(_pulldowns(spark, sf), START, END)
    return plain(out, EPISODE_SUMS)


# ------------------------------------------------------------------- outlook


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    two_days = NOW - dt.timedelta(days=2)
    return _snapshot(spark, sf).filter(reading.in_window("slot_started_at", two_days, NOW, "[)"))


@query
def discharge_slope(spark, sf):
    return plain(folding.discharge_slope(_recent(spark, sf)), ["slope_percent_per_hour"])


@query
def discharge_slope_history(spark, sf):
    """The slope over each device's whole history instead of its last hours."""
    out = folding.discharge_slope(_snapshot(spark, sf), hours=None)
    return plain(out, ["slope_percent_per_hour"])


@query
def battery_outlook(spark, sf):
    slope = folding.discharge_slope(_recent(spark, sf))
    latest = reading.latest_state(_fact(spark, sf), NOW)
    expected = outlook.outlook(latest, slope, outlook.next_morning_after(NOW))
    out = outlook.empty_before(expected, NOW).select(
        "serial_number", "slope_percent_per_hour", "projected_percent", "refused",
        "hours_remaining", "empty_before_morning",
    )
    return plain(out, ["slope_percent_per_hour", "projected_percent", "hours_remaining"])


@query
def energy_vs_previous(spark, sf):
    out = outlook.energy_vs_previous(_fact(spark, sf), NOW)
    return plain(out, [c for c in out.columns if c.endswith("watt_hours")])


@query
def plugged_share(spark, sf):
    """External power within each device's last recording before now."""
    return plain(
        outlook.plugged_share(folding.latest_stretch(_recent(spark, sf))), ["plugged_share"]
    )


@query
def daily_summary(spark, sf):
    t = star(spark, sf)
    out = outlook.daily_summary(
        t["fact_cooler_state_update"], t["fact_cooler_snapshot"], t["fact_cooler_pulldown"], NOW
    ).select(
        "serial_number", "updated_at", "state_of_charge_percent", "battery_state",
        "today_discharged_watt_hours", "yesterday_discharged_watt_hours", "against_yesterday",
        "refused", "projected_percent", "reached_count", "last_duration_seconds",
    )
    return plain(
        out,
        ["today_discharged_watt_hours", "yesterday_discharged_watt_hours", "projected_percent"],
    )


@query
def weekly_totals(spark, sf):
    out = outlook.weekly_totals(outlook.week_hours(_snapshot(spark, sf), NOW))
    return plain(
        out,
        ["discharged_watt_hours", "charged_watt_hours", "external_input_hours", "net_watt_hours",
         "average_charge_watts", "balancing_hours"],
    )


@query
def weekly_summary(spark, sf):
    t = star(spark, sf)
    out = outlook.weekly_summary(
        t["fact_cooler_snapshot"], t["fact_cooler_pulldown"], t["dim_cooler"], NOW
    )
    shown = F.transform(
        "triggers", lambda s: F.concat_ws(":", s["trigger"], s["episodes"].cast("string"))
    )
    return plain(
        out.select(
            "serial_number", "discharged_watt_hours", "charged_watt_hours", "gap_hours",
            F.coalesce(F.size("missing_days"), F.lit(0)).cast("bigint").alias("missing_day_count"),
            F.array_join(shown, ",").alias("triggers"),
        ),
        ["discharged_watt_hours", "charged_watt_hours"],
    )


def _week(spark: SparkSession, sf: str):
    days = outlook.days_between(*outlook.week_window(NOW))
    return outlook.week_hours(_snapshot(spark, sf), NOW), star(spark, sf)["dim_cooler"], days


@query
def daily_energy(spark, sf):
    out = outlook.daily_energy(*_week(spark, sf))
    return plain(out, ["discharged_watt_hours", "charged_watt_hours"])


@query
def missing_days(spark, sf):
    """Days of the year without a covered hour, per device."""
    first, last = dt.date(2024, 1, 1), dt.date(2024, 12, 31)
    days = [first + dt.timedelta(days=n) for n in range((last - first).days + 1)]
    hours = folding.fold(_snapshot(spark, sf), 4)
    return plain(outlook.missing_days(hours, star(spark, sf)["dim_cooler"], days))


# ------------------------------------------------------------------- quality


@query
def quality_report(spark, sf):
    """Every contract rule over raw and star, with its count of violations."""
    cooler, events = _raw(spark, sf)
    tables = dict(star(spark, sf)) | {"raw_cooler": cooler, "raw_events": events}
    return quality.violations(tables, NOW)


def _damaged(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Raw and star with faults of every kind put in, by charge or number of reports of a row."""
    cooler, events = _raw(spark, sf)
    out = dict(star(spark, sf))
    soc, col = F.col("payload.state_of_charge_percent"), F.col

    def set_when(df: DataFrame, condition, name: str, value) -> DataFrame:
        return df.withColumn(name, F.when(condition, value).otherwise(col(name)))

    payload = (
        col("payload")
        .withField("state_of_charge_percent", F.when(soc == 2, 107).otherwise(soc).cast("bigint"))
        .withField(
            "setpoint_celsius",
            F.when(soc == 3, 99).otherwise(col("payload.setpoint_celsius")).cast("bigint"),
        )
    )
    again = cooler.filter(soc == 5).withColumn("frames", F.array(F.lit("FF")))
    raw = set_when(cooler.unionByName(again), soc == 1, "frames", F.array().cast("array<string>"))
    raw = set_when(raw, soc == 4, "plain", F.lit(None).cast("string"))
    out["raw_cooler"] = raw.withColumn("payload", payload)
    later = events.filter("kind = 'ble_negotiated'").withColumn("ts", col("ts") + F.expr("interval 1 second"))
    out["raw_events"] = events.unionByName(later)

    fact = out["fact_cooler_state_update"]
    charge = col("state_of_charge_percent")
    fact = fact.filter(charge != 9).unionByName(fact.filter(charge == 8))
    fact = set_when(fact, charge == 3, "interior_temperature_celsius", F.lit(99).cast("bigint"))
    fact = set_when(fact, charge == 4, "external_input", ~col("external_input"))
    fact = set_when(fact, charge == 5, "date_key", col("date_key") + 10_000)
    fact = set_when(fact, charge == 6, "held_seconds", col("held_seconds") + 1)
    fact = set_when(fact, charge == 7, "battery_key", F.lit(-5).cast("bigint"))
    fact = set_when(fact, charge == 10, "battery_state", F.lit("melted"))
    fact = set_when(fact, charge == 11, "updated_at", F.lit(None).cast("timestamp"))
    out["fact_cooler_state_update"] = set_when(fact, charge == 2, "state_of_charge_percent", F.lit(107).cast("bigint"))

    snap, first = out["fact_cooler_snapshot"], col("update_count")
    snap = snap.filter(first != 7).unionByName(snap.filter(first == 6))
    snap = set_when(snap, first == 2, "covered_seconds", F.lit(901.0))
    snap = set_when(snap, first == 3, "external_input_ratio", F.lit(1.5))
    snap = set_when(snap, first == 4, "state_of_charge_delta_percent", col("state_of_charge_delta_percent") + 1)
    out["fact_cooler_snapshot"] = set_when(snap, first == 5, "discharged_watt_hours", F.lit(26.0))

    pull, kind = out["fact_cooler_pulldown"], col("update_count") % 5
    pull = pull.unionByName(pull.filter(kind == 4))
    pull = set_when(pull, kind == 1, "ended_at", col("started_at") - F.expr("interval 1 hour"))
    pull = set_when(pull, kind == 2, "outcome", F.lit(None).cast("string"))
    pull = set_when(pull, kind == 0, "trigger", F.lit("other"))
    out["fact_cooler_pulldown"] = set_when(pull, kind == 3, "duration_seconds", F.lit(90_000.0))

    devices = out["dim_cooler"]
    twins = devices.filter("is_current").withColumn("cooler_key", col("cooler_key") + 1)
    out["dim_cooler"] = devices.unionByName(twins)
    return out


@query
def quality_report_broken(spark, sf):
    """The rules over a star with faults put in, so that each of them has something to find."""
    return quality.violations(_damaged(spark, sf), NOW)


@query
def rule_results(spark, sf):
    """A run of the rules over the damaged star without its batteries: counts, and the rule that crashed."""
    tables = _damaged(spark, sf)
    del tables["dim_battery"]
    return quality.evaluate(spark, tables, NOW)


@query
def column_rules_broken(spark, sf):
    """Required, unique and enumerated columns of the damaged marts; types are left to tests."""
    tables, parts = _damaged(spark, sf), None
    for name in ("fact_cooler_state_update", "fact_cooler_pulldown", "dim_cooler", "dim_battery"):
        found = quality.schema_violations(tables[name], quality.DECLARED[name]).filter("check <> 'type'")
        found = found.select(F.lit(name).alias("table"), "check", "column", "violations")
        parts = found if parts is None else parts.unionByName(found)
    return plain(parts)


@query
def schema_report(spark, sf):
    """Declared types, required, unique and enumerated columns of every mart."""
    parts = None
    for name, table in star(spark, sf).items():
        found = quality.schema_violations(table, quality.DECLARED[name]).select(
            F.lit(name).alias("table"), "check", "column", "violations"
        )
        parts = found if parts is None else parts.unionByName(found)
    return plain(parts.groupBy("table", "check").agg(
        F.count(F.lit(1)).alias("checks"), F.sum("violations").alias("violations")))


@query
def freshness(spark, sf):
    return plain(quality.freshness(_fact(spark, sf), "updated_at", NOW + dt.timedelta(days=14)))


@query
def copies_that_disagree(spark, sf):
    """Natural keys whose copies carry different bytes."""
    return plain(
        copies_disagree(
            A.raw_cooler(spark, sf), list(staging.REPORT_KEYS), F.array_join("frames", ",")
        )
    )


@query
def reports_not_reflected(spark, sf):
    """Reports that a fact as it stood at ``END`` does not hold: the rule, given something to find."""
    fact = _fact(spark, sf).filter(reading.in_window("updated_at", None, END, "[)"))
    return plain(quality.unreflected(A.raw_cooler(spark, sf), fact, reading.instant(NOW)))


@query
def overlapping_versions(spark, sf):
    """Pairs of orders of one customer whose sixty days overlap, counted without pairing."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    spans = orders.select(
        F.col("o_custkey").alias("serial_number"),
        F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        F.date_add(F.col("o_orderdate").cast("date"), 60).cast("timestamp").alias("valid_to"),
    )
    return quality.overlapping_versions(spans)


# ------------------------------------------------------------------- streams


@query
def silence_spells(spark, sf):
    links = A.link_events(A.events(spark, sf)).withColumn("ts", F.timestamp_micros("ts_us"))
    return plain(gaps.silence_spells(links))


@query
def silent_links(spark, sf):
    """Connected links without a message for a quarter of an hour, as of the end of January."""
    base = A.events(spark, sf)
    said = A.link_events(base).select("serial_number", F.timestamp_micros("ts_us").alias("ts"), "kind")
    marks = said.unionByName(A.link_states(base))
    return plain(gaps.silent_links(marks, until=dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)))


@query
def sequence_gaps(spark, sf):
    return plain(gaps.sequence_gaps(A.numbered_events(A.events(spark, sf))))


@query
def throttled_failures(spark, sf):
    failures = (
        A.link_events(A.events(spark, sf))
        .filter("kind = 'environment_read_failed'")
        .select("serial_number", F.timestamp_micros("ts_us").alias("ts"))
    )
    return plain(throttle(failures, ["serial_number"], "ts", 7200.0))


@query
def command_outcomes(spark, sf):
    return plain(commands.command_outcomes(A.command_steps(A.events(spark, sf))))


@query
def verified_commands(spark, sf):
    """Which acknowledged commands a state report confirms within ten minutes."""
    asked = commands.command_outcomes(A.command_steps(A.events(spark, sf)))
    out = commands.verify_applied(asked, _fact(spark, sf), timeout=600)
    return plain(out.select("command_id", "serial_number", "outcome", "shown_at", "verified"))


@query
def arrivals_due(spark, sf):
    """Rows not yet built: one kind half built, one rebuilt smaller than its mark, others never."""
    counts = A.events(spark, sf).groupBy(F.col("event_type").alias("table")).agg(F.count(F.lit(1)).alias("rows"))
    built = F.when(F.col("table") == "error", F.col("rows") * 2).otherwise(F.floor(F.col("rows") / 2))
    marks = counts.filter("table in ('click', 'error')").select("table", built.cast("bigint").alias("built_through"))
    return plain(arrivals.arrived_since(counts, marks))


@query
def gateway_sessions(spark, sf):
    """Spans of the gateway's stream: up on a signup, down on an error, per boot."""
    marks = A.events(spark, sf).filter("event_type in ('signup', 'error')").selectExpr(
        f"concat('COOLER-', user_id % 3, '/b', us div {A.BOOT_MICROS}) as boot_id",
        "timestamp_micros(us) as ts",
        "case when event_type = 'signup' then 'gateway_connected' else 'gateway_disconnected' end as kind",
    )
    return plain(commands.gateway_sessions(marks))


@query
def link_sessions(spark, sf):
    return plain(commands.link_sessions(A.link_states(A.events(spark, sf))))


# ------------------------------------------------------------ sources, signals


@query
def gateway_records(spark, sf):
    """Records made from gateway envelopes, by kind and whether a payload survived."""
    cooler, events = gateway.records_from_events(A.envelopes(A.events(spark, sf)))
    both = cooler.select(
        "type", F.lit(None).cast("string").alias("kind"), F.col("payload").isNotNull().alias("decoded"),
        F.size("frames").cast("bigint").alias("amount"),
    ).unionByName(
        events.select("type", "kind", F.lit(False).alias("decoded"), F.col("count").alias("amount"))
    )
    return plain(
        both.groupBy("type", "kind", "decoded").agg(
            F.count(F.lit(1)).alias("records"), F.sum("amount").alias("amount")
        )
    )


@query
def decoded_signals(spark, sf):
    built, reported, dead = signals.decode_signals(A.pushed_signals(A.events(spark, sf)))
    return plain(
        built.select(F.lit("semantic_updated").alias("kind"), F.col("rows_arrived").alias("n"))
        .unionByName(
            reported.select(
                F.lit("quality_report").alias("kind"),
                F.size("failed_checks").cast("bigint").alias("n"),
            )
        )
        .unionByName(
            dead.select(F.lit("dead").alias("kind"), F.lit(None).cast("bigint").alias("n"))
        )
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("messages"), F.sum("n").alias("n"))
    )


@query
def failed_quality_reports(spark, sf):
    _, reported, _ = signals.decode_signals(A.pushed_signals(A.events(spark, sf)))
    failed = signals.failed_reports(reported)
    return plain(
        failed.select("run_id", "contract_id", F.array_join("failed_checks", ",").alias("failed"))
    )


@query
def raw_round_trip(spark, sf):
    """Records routed to chunks by type and day, read back, appended to an emptied raw table in two parts.

    Sensor failures are of a type that is not shipped; they come back from the router.
    """
    cooler, events = _raw(spark, sf)
    unshipped = F.col("kind") == "environment_read_failed"

    def told():
        yield from ("boot_id", "uptime_seconds", "ts", "ts_synced", "kind")
        for name in ("state_of_charge_percent", "battery_state", "battery_serial_number"):
            yield F.col(f"payload.{name}").alias(name)
        yield F.col("environment.temperature_celsius").alias("ambient_temperature_celsius")

    typed = events.withColumn("type", F.when(unshipped, "ambient").otherwise("event"))
    root = f"{shared_folder(spark)}/coldmart/trip-{uuid.uuid4().hex}"
    left = chunks.route_records(cooler.unionByName(typed, allowMissingColumns=True), root)
    parts = [left.select(F.lit("left").alias("place"), *told(), F.lit(None).cast("date").alias("landed"))]
    first, second = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc), dt.datetime(2024, 3, 2, tzinfo=dt.timezone.utc)
    shape = left.select("kind", "payload", "environment").limit(0)  # columns that one of the tables lacks
    for stream, table in arrivals.TABLE_OF_STREAM.items():
        path = f"{root}/{table}"
        chunks.reset_raw(spark, path, table)
        read = chunks.read_raw(spark, root, stream)
        early = F.col("dt") < F.lit(START).cast("date")
        chunks.append_raw(read.filter(early).drop("dt"), path, F.lit(first))
        chunks.append_raw(read.filter(~early).drop("dt"), path, F.lit(second))
        landed = chunks.read_table(spark, path, table)
        landed = landed.unionByName(shape, allowMissingColumns=True)
        parts.append(landed.select(F.lit(table).alias("place"), *told(), F.col("_ingest_date").alias("landed")))
    return plain(functools.reduce(DataFrame.unionByName, parts))


@query
def signals_emitted(spark, sf):
    """A build's signal and, of each day as its own contract, a report on its events; as they were written."""
    base = A.events(spark, sf)
    path = f"{shared_folder(spark)}/coldmart/signals-{uuid.uuid4().hex}"
    day = F.to_date(F.timestamp_micros("us")).cast("string")
    results = base.groupBy(day.alias("contract"), F.col("event_type").alias("rule")).agg(
        F.count_if(F.col("k") < 2).alias("violations")
    )
    results = results.withColumn("table", F.lit("events")).withColumn("error", F.lit(None).cast("string"))
    signals.emit_build_signal(spark, path, "run-1", base.count(), NOW)
    signals.emit_quality_report(quality.report(results), path, "run-1", NOW)
    sent = spark.read.schema(SIGNAL).parquet(path)
    return plain(sent.withColumn("failed_checks", F.array_join("failed_checks", ",")))


@query
def readable_lines(spark, sf):
    """Chunk lines that are one JSON object each, and why the others are not."""
    schema = T.StructType.fromDDL("uptime_seconds BIGINT, boot_id STRING, kind STRING")
    good, rejected = chunks.parse_lines(A.chunk_lines(A.events(spark, sf)), schema)
    kept = good.groupBy(F.lit("kept").alias("fate"), F.col("boot_id").alias("detail")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("uptime_seconds").alias("uptime")
    )
    lost = rejected.groupBy(F.lit("rejected").alias("fate"), F.col("reason").alias("detail")).agg(
        F.count(F.lit(1)).alias("lines"), F.lit(None).cast("bigint").alias("uptime")
    )
    return plain(kept.unionByName(lost))


# ---------------------------------------------------------------------- bytes


@query
def payload_backfill(spark, sf):
    raw = messages(spark, sf).select(
        "event_id", "cmd", "plain", F.lit(None).cast("struct<x:int>").alias("payload")
    )
    out = backfill_payload(raw.drop("payload").withColumn("payload", _no_payload()))
    return plain(out.select("event_id", "payload.*", "payload_error"))


def _no_payload():
    from coldmart.schemas import PAYLOAD

    return F.lit(None).cast(PAYLOAD)


@query
def tlv_explode(spark, sf):
    raw = messages(spark, sf).select("event_id", "plain", "frames")
    return plain(explode_tlv(raw, carry=["event_id"]))


@query
def frame_audit(spark, sf):
    return plain(audit_frames(messages(spark, sf).select("frames")))


# ------------------------------------------------- the same operators elsewhere


@query
def scd2_customer_priority(spark, sf):
    """History of each customer's order priority: a version per change."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_custkey",
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.concat_ws("|", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("ordered"),
        "o_orderpriority",
    )
    per_day = orders.groupBy("o_custkey", "at").agg(
        F.max_by("o_orderpriority", "ordered").alias("priority")
    )
    out = dims.version_changes(per_day, "o_custkey", "at", "priority")
    return plain(
        out.select(
            "o_custkey", "priority", F.col("at").alias("valid_from"),
            F.col("closed_at").alias("valid_to"), "version_episode",
        )
    )


@query
def asof_lineitem_priority(spark, sf):
    """The priority a customer had when a line of any of their orders shipped."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    per_day = orders.groupBy("o_custkey", F.col("o_orderdate").cast("timestamp").alias("at")).agg(
        F.max_by(
            "o_orderpriority",
            F.concat_ws("|", "o_orderpriority", F.col("o_orderkey").cast("string")),
        ).alias("priority")
    )
    versions = dims.version_changes(per_day, "o_custkey", "at", "priority").select(
        "o_custkey", "priority", F.col("at").alias("valid_from"), F.col("closed_at").alias("valid_to")
    )
    lines = (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .select("l_orderkey", "l_linenumber", "l_shipdate")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("at", F.col("l_shipdate").cast("timestamp"))
    )
    out = asof_version(lines, versions, "o_custkey", F.col("at"), ["priority"])
    return plain(
        out.groupBy("o_custkey", "priority").agg(
            F.count(F.lit(1)).alias("lines"), F.sum("l_linenumber").cast("bigint").alias("numbers")
        )
    )


@query
def dense_order_days(spark, sf):
    """Orders per day of the whole span, days without one included."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderdate").cast("date").alias("day"), "o_orderkey"
    )
    counts = orders.groupBy("day").agg(F.count(F.lit(1)).alias("orders"))
    ends = counts.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    out = days.join(counts, "day", "left").withColumn(
        "orders", F.coalesce("orders", F.lit(0).cast("bigint"))
    )
    return plain(out.withColumn("week_key", iso_week_key(F.col("day").cast("timestamp"))))
