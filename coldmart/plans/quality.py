"""Contract rules: each is a count of violations that must be zero.

Rules about single rows of one table are fused into one aggregate over one scan. Rules that
need more than a row (uniqueness, neighbours, other tables) are queries of their own.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldmart import schemas
from coldmart.functions import date_key
from coldmart.functions.time import SLOT_SECONDS
from coldmart.operators.dedup import copies_disagree
from coldmart.operators.holds import held_seconds
from coldmart.operators.ordered import CHUNK_ROWS, DAY, running_count
from coldmart.plans.reading import instant
from coldmart.plans.staging import REPORT_KEYS, complete_reports

Tables = Mapping[str, DataFrame]

COLLECTION, SEMANTICS = "collection", "semantics"


@dataclass(frozen=True)
class RowRule:
    """A row of ``table`` violates the rule when ``broken`` is true (NULL is fine)."""

    contract: str
    table: str
    name: str
    dimension: str
    broken: Callable[[], Column]


@dataclass(frozen=True)
class QueryRule:
    """A rule whose ``count`` gives one row with the column ``violations``."""

    contract: str
    table: str
    name: str
    dimension: str
    count: Callable[[Tables], DataFrame]


def _outside(name: str, low: float, high: float) -> Column:
    return ~F.col(name).between(low, high)


def _any(*conditions: Column) -> Column:
    out = F.coalesce(conditions[0], F.lit(False))
    for condition in conditions[1:]:
        out = out | F.coalesce(condition, F.lit(False))
    return out


def row_rules() -> list[RowRule]:
    # Names, limits and dimensions of the contract's rules.
    fact, snap, pull = "fact_cooler_state_update", "fact_cooler_snapshot", "fact_cooler_pulldown"
    col = F.col
    return [
        RowRule(COLLECTION, "raw_cooler", "frames_present", "completeness",
                lambda: col("frames").isNull() | (F.size("frames") == 0)),
        RowRule(COLLECTION, "raw_cooler", "state_of_charge_in_range", "conformity",
                lambda: _outside("payload.state_of_charge_percent", 0, 100)),
        RowRule(COLLECTION, "raw_cooler", "temperatures_in_range", "conformity",
                lambda: _any(_outside("payload.interior_temperature_celsius", -40, 85),
                             _outside("payload.setpoint_celsius", -40, 85),
                             _outside("environment.temperature_celsius", -40, 85))),
        RowRule(COLLECTION, "raw_cooler", "payload_only_with_plain", "consistency",
                lambda: col("payload").isNotNull() & col("plain").isNull()),
        RowRule(SEMANTICS, fact, "state_of_charge_in_range", "conformity",
                lambda: _outside("state_of_charge_percent", 0, 100)),
        RowRule(SEMANTICS, fact, "temperatures_in_range", "conformity",
                lambda: _any(_outside("setpoint_celsius", -40, 85),
                             _outside("interior_temperature_celsius", -40, 85),
                             _outside("ambient_temperature_celsius", -40, 85))),
        RowRule(SEMANTICS, fact, "external_input_matches_watts", "consistency",
                lambda: col("external_input") != (col("input_watts") > 0)),
        RowRule(SEMANTICS, fact, "date_key_matches_updated_at", "consistency",
                lambda: col("date_key") != date_key(col("updated_at"))),
        RowRule(SEMANTICS, snap, "covered_seconds_in_range", "conformity",
                lambda: _outside("covered_seconds", 0, SLOT_SECONDS)),
        RowRule(SEMANTICS, snap, "ratios_in_range", "conformity",
                lambda: _any(_outside("external_input_ratio", 0, 1),
                             _outside("charging_ratio", 0, 1))),
        RowRule(SEMANTICS, snap, "delta_is_end_minus_start", "consistency",
                lambda: col("state_of_charge_delta_percent")
                != col("state_of_charge_end_percent") - col("state_of_charge_start_percent")),
        RowRule(SEMANTICS, snap, "energy_plausible", "accuracy",
                lambda: _any(col("discharged_watt_hours") > 25, col("charged_watt_hours") > 38)),
        RowRule(SEMANTICS, pull, "milestones_ordered", "consistency",
                lambda: _any(col("reached_at") < col("started_at"),
                             col("ended_at") < col("started_at"))),
        RowRule(SEMANTICS, pull, "outcome_and_end_agree", "consistency",
                lambda: (col("outcome").isNull() != col("ended_at").isNull())
                | (F.coalesce(col("outcome") == "reached", F.lit(False))
                   != col("reached_at").isNotNull())),
        RowRule(SEMANTICS, pull, "duration_plausible", "accuracy",
                lambda: col("duration_seconds") > 86400),
    ]


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key: COUNT(*) - COUNT(DISTINCT key), NULLs uncounted."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    named = F.lit(True)
    for key in keys:
        named = named & F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum(F.col("n")) - F.count_if(named), F.lit(0)).alias("violations")
    )


def holds_disagree(fact: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Reports whose hold is not the gap to the next report of the same link.

    Recomputed per (boot, device), the partition the fact itself was built with.
    """
    again = held_seconds(
        fact.select("boot_id", "serial_number", "uptime_seconds", "held_seconds"),
        keys=("boot_id", "serial_number"),
        name="_expected",
    )
    return again.agg(
        F.count_if(F.abs(F.col("held_seconds") - F.col("_expected")) > tolerance).alias(
            "violations"
        )
    )


def keys_unresolved(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Fact rows any of whose foreign keys has no row in its dimension."""
    joined, missing = fact.select(*dims), F.lit(False)
    for key, dim in dims.items():
        known = dim.select(key).distinct().withColumn(f"_has_{key}", F.lit(True))
        joined = joined.join(known, key, "left")
        missing = missing | F.col(f"_has_{key}").isNull()
    return joined.agg(F.count_if(missing).alias("violations"))


def unreflected(
    raw_cooler: DataFrame, fact: DataFrame, due_before: Column, landed: str = "_ingested_at"
) -> DataFrame:
    """Reports the staging keeps that landed before ``due_before`` and are not in the fact."""
    if landed in raw_cooler.columns:
        raw_cooler = raw_cooler.filter(F.col(landed) < due_before)
    due = complete_reports(raw_cooler).select(*REPORT_KEYS).distinct()
    return due.join(fact.select(*REPORT_KEYS), list(REPORT_KEYS), "left_anti")


def holes(snapshot: DataFrame, device: str = "serial_number") -> DataFrame:
    """Quarter hours missing between a device's first and last slot."""
    seconds = F.unix_seconds(F.max("slot_started_at")) - F.unix_seconds(F.min("slot_started_at"))
    missing = F.call_function("div", seconds, F.lit(SLOT_SECONDS)) + 1 - F.count(F.lit(1))
    return (
        snapshot.groupBy(device)
        .agg(missing.alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("violations"))
    )


def reconcile(
    left: DataFrame, right: DataFrame, measures: Iterable[str], tolerance: float
) -> DataFrame:
    """1 if the totals of any measure differ by more than ``tolerance``, else 0."""
    names = list(measures)
    both = left.select(*names, F.lit(1.0).alias("_side")).unionByName(
        right.select(*names, F.lit(-1.0).alias("_side"))
    )
    # A side without a single value has no total, and nothing to disagree about.
    off = [
        F.abs(
            F.sum(F.when(F.col("_side") > 0, F.col(n)))
            - F.sum(F.when(F.col("_side") < 0, F.col(n)))
        )
        > tolerance
        for n in names
    ]
    return both.agg(F.when(_any(*off), 1).otherwise(0).cast("bigint").alias("violations"))


def not_one_current(devices: DataFrame, device: str = "serial_number") -> DataFrame:
    return (
        devices.filter("is_current")
        .groupBy(device)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") != 1).alias("violations"))
    )


def overlapping_versions(
    devices: DataFrame, device: str = "serial_number", rows: int = CHUNK_ROWS
) -> DataFrame:
    """How many pairs of validity windows of one device overlap, without forming a pair.

    Two windows do not overlap when one has closed by the time the other opens. So per
    window it is enough to count the closings up to its opening, a running count over the
    openings and closings of a device in time order; the rest of n·(n-1)/2 pairs overlap.
    """
    start = F.unix_micros("valid_from")
    end = F.coalesce(F.unix_micros("valid_to"), F.lit(253402300799999999))
    spans = devices.select(
        device, start.alias("s"), end.alias("e"), F.col("valid_to").isNotNull().alias("closes")
    )
    # Closings sort before openings of the same instant: [a, b) and [b, c) do not overlap. An open
    # window never closes, so no closing of it has to be counted.
    closing = F.when(F.col("closes"), F.struct(F.col("e").alias("at"), F.lit(0).alias("opens")))
    opening = F.struct(F.col("s").alias("at"), F.lit(1).alias("opens"))
    marks = spans.select(
        device, "s", "e", F.explode(F.array_compact(F.array(closing, opening))).alias("m")
    ).select(device, "s", "e", F.col("m.at").alias("at"), F.col("m.opens").alias("opens"))
    order = ["at", "opens", "s", "e"]
    counted = running_count(marks, [device], order, "closed", F.col("opens") == 0, rows)
    empty = (F.col("s") == F.col("e")).cast("bigint")
    apart = (
        counted.filter(F.col("opens") == 1)
        .groupBy(device)
        .agg(
            F.count(F.lit(1)).alias("n"),
            # An empty window has closed before itself; it is no pair with itself.
            F.sum(F.col("closed") - empty).alias("apart"),
        )
    )
    # Two empty windows at one instant are each apart from the other: counted twice.
    twins = (
        spans.filter(F.col("s") == F.col("e"))
        .groupBy(device, "s")
        .agg(F.count(F.lit(1)).alias("k"))
        .groupBy(device)
        .agg(F.sum(F.expr("k * (k - 1) div 2")).alias("twice"))
    )
    pairs = F.expr("n * (n - 1) div 2") - F.col("apart") + F.coalesce("twice", F.lit(0))
    return apart.join(twins, device, "left").agg(
        F.coalesce(F.sum(pairs), F.lit(0)).cast("bigint").alias("violations")
    )


def query_rules(now: dt.datetime | None = None) -> list[QueryRule]:
    """Rules beyond single rows; ``now`` (default: the clock) dates the arrival grace."""
    fact, snap, pull = "fact_cooler_state_update", "fact_cooler_snapshot", "fact_cooler_pulldown"
    moment = F.current_timestamp() if now is None else instant(now)
    due = moment - F.expr("interval 2 hours")
    energies = ("discharged_watt_hours", "charged_watt_hours", "input_watt_hours")

    def counted(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations"))

    return [
        QueryRule(COLLECTION, "raw_cooler", "repeated_messages_agree", "consistency",
                  lambda t: counted(copies_disagree(
                      t["raw_cooler"], REPORT_KEYS, F.array_join("frames", ",")))),
        QueryRule(COLLECTION, "raw_events", "repeated_events_agree", "consistency",
                  lambda t: counted(copies_disagree(
                      t["raw_events"], [*REPORT_KEYS, "kind"], F.col("ts")))),
        QueryRule(SEMANTICS, fact, "identity_unique", "uniqueness",
                  lambda t: duplicates(t[fact], *REPORT_KEYS)),
        QueryRule(SEMANTICS, fact, "held_seconds_is_the_gap_to_the_next_update", "consistency",
                  lambda t: holds_disagree(t[fact])),
        QueryRule(SEMANTICS, fact, "keys_resolve", "consistency",
                  lambda t: keys_unresolved(t[fact], {
                      "cooler_key": t["dim_cooler"], "battery_key": t["dim_battery"],
                      "date_key": t["dim_date"]})),
        QueryRule(SEMANTICS, fact, "every_report_is_reflected", "completeness",
                  lambda t: counted(unreflected(t["raw_cooler"], t[fact], due))),
        QueryRule(SEMANTICS, snap, "one_row_per_slot", "uniqueness",
                  lambda t: duplicates(t[snap], "serial_number", "slot_key")),
        QueryRule(SEMANTICS, snap, "slots_are_dense", "completeness", lambda t: holes(t[snap])),
        QueryRule(SEMANTICS, snap, "energy_matches_state_updates", "consistency",
                  lambda t: reconcile(t[snap], t[fact], energies, 1.0)),
        QueryRule(SEMANTICS, pull, "one_row_per_episode", "uniqueness",
                  lambda t: duplicates(t[pull], "pulldown_key")),
        QueryRule(SEMANTICS, "dim_cooler", "one_current_row_per_cooler", "uniqueness",
                  lambda t: not_one_current(t["dim_cooler"])),
        QueryRule(SEMANTICS, "dim_cooler", "validity_does_not_overlap", "consistency",
                  lambda t: overlapping_versions(t["dim_cooler"])),
    ]


def _row_counts(rules: list[RowRule], table: DataFrame) -> DataFrame:
    counts = table.agg(*[F.count_if(r.broken()).alias(f"r{i}") for i, r in enumerate(rules)])
    entries = F.array(
        *[
            F.struct(
                F.lit(r.contract).alias("contract"),
                F.lit(r.table).alias("table"),
                F.lit(r.name).alias("rule"),
                F.lit(r.dimension).alias("dimension"),
                F.col(f"r{i}").alias("violations"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return counts.select(F.inline(entries))


def violations(tables: Tables, now: dt.datetime | None = None) -> DataFrame:
    """One row per rule that can be asked of ``tables``, lazily."""
    parts = []
    for table in dict.fromkeys(r.table for r in row_rules()):
        rules = [r for r in row_rules() if r.table == table]
        if table in tables:
            parts.append(_row_counts(rules, tables[table]))
    for rule in query_rules(now):
        if rule.table in tables:
            parts.append(
                rule.count(tables).select(
                    F.lit(rule.contract).alias("contract"),
                    F.lit(rule.table).alias("table"),
                    F.lit(rule.name).alias("rule"),
                    F.lit(rule.dimension).alias("dimension"),
                    F.col("violations").cast("bigint").alias("violations"),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------ declared schemas


@dataclass(frozen=True)
class Declared:
    """What a contract says about one table's columns."""

    schema: T.StructType
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    accepted: Mapping[str, tuple[str, ...]] | None = None


def schema_violations(df: DataFrame, declared: Declared) -> DataFrame:
    """Type mismatches, NULLs, duplicates and unknown values of declared columns."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        ("type", f.name, int(types.get(f.name) != f.dataType)) for f in declared.schema.fields
    ]
    checks = {
        ("required", name): F.count_if(F.col(name).isNull()) for name in declared.required
    } | {
        ("accepted", name): F.count_if(~F.col(name).isin(*values))
        for name, values in (declared.accepted or {}).items()
    }
    out = spark.createDataFrame(wrong, "check STRING, column STRING, violations BIGINT")
    if checks:
        counts = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(checks.values())])
        entries = [
            F.struct(
                F.lit(check).alias("check"),
                F.lit(column).alias("column"),
                F.col(f"c{i}").alias("violations"),
            )
            for i, (check, column) in enumerate(checks)
        ]
        out = out.unionByName(counts.select(F.inline(F.array(*entries))))
    for name in declared.unique:
        out = out.unionByName(
            duplicates(df, name).select(
                F.lit("unique").alias("check"),
                F.lit(name).alias("column"),
                F.col("violations").cast("bigint").alias("violations"),
            )
        )
    return out


DECLARED = {
    "raw_cooler": Declared(
        schemas.RAW_COOLER,
        ("ts", "uptime_seconds", "boot_id", "type", "model", "address"),
        accepted={"type": ("cooler",)},
    ),
    "raw_events": Declared(
        schemas.RAW_EVENTS,
        ("ts", "uptime_seconds", "boot_id", "type", "kind"),
        accepted={"type": ("event",)},
    ),
    "fact_cooler_state_update": Declared(
        schemas.STATE_UPDATE,
        ("state_update_key", "cooler_key", "battery_key", "date_key", "updated_at", "held_seconds"),
        ("state_update_key",),
        {
            "battery_state": schemas.BATTERY_STATES,
            "display_unit": schemas.DISPLAY_UNITS,
            "protection_level": schemas.PROTECTION_LEVELS,
            "brightness": schemas.BRIGHTNESS_LEVELS,
        },
    ),
    "fact_cooler_snapshot": Declared(
        schemas.SNAPSHOT, ("slot_key", "date_key", "slot_started_at", "covered_seconds")
    ),
    "fact_cooler_pulldown": Declared(
        schemas.PULLDOWN,
        ("pulldown_key", "cooler_key", "battery_key", "date_key", "started_at", "trigger"),
        ("pulldown_key",),
        {"trigger": schemas.TRIGGERS, "outcome": schemas.OUTCOMES},
    ),
    "dim_cooler": Declared(
        schemas.COOLER, ("cooler_key", "serial_number", "valid_from", "is_current"), ("cooler_key",)
    ),
    "dim_battery": Declared(schemas.BATTERY, ("battery_key", "is_absent"), ("battery_key",)),
    "dim_date": Declared(schemas.CALENDAR, ("date_key", "date"), ("date_key",)),
}


def freshness(df: DataFrame, at: str, now: dt.datetime) -> DataFrame:
    """``ok``, ``warn`` after a day without a record, ``error`` after a week (or none ever)."""
    age = F.unix_seconds(instant(now)) - F.unix_seconds(F.max(at))
    return df.agg(F.max(at).alias("last_at"), age.alias("age_seconds")).withColumn(
        "status",
        F.when(F.col("age_seconds").isNull() | (F.col("age_seconds") > 7 * DAY), "error")
        .when(F.col("age_seconds") > DAY, "warn")
        .otherwise("ok"),
    )


# ------------------------------------------------------------ running the rules


RESULT = "contract STRING, table STRING, rule STRING, violations BIGINT, error STRING"


@dataclass(frozen=True)
class _Asked:
    """One plan and the names of the rules whose counts are its rows."""

    names: tuple[tuple[str, str, str], ...]
    plan: Callable[[], DataFrame]


def _asked(tables: Tables, now: dt.datetime | None, contract: str | None) -> list[_Asked]:
    """A plan per table for the rules about its rows, and one per rule beyond rows."""
    rows = [r for r in row_rules() if contract is None or r.contract == contract]
    out = []
    for table in dict.fromkeys(r.table for r in rows):
        mine = [r for r in rows if r.table == table]
        out.append(
            _Asked(
                tuple((r.contract, r.table, r.name) for r in mine),
                lambda mine=mine, table=table: _row_counts(mine, tables[table]).drop("dimension"),
            )
        )
    for rule in query_rules(now):
        if contract is None or rule.contract == contract:
            name = (rule.contract, rule.table, rule.name)
            out.append(_Asked((name,), lambda rule=rule, name=name: _named(rule.count(tables), name)))
    return out


def _named(counted: DataFrame, name: tuple[str, str, str]) -> DataFrame:
    return counted.select(
        *[F.lit(v).alias(c) for c, v in zip(("contract", "table", "rule"), name)],
        F.col("violations").cast("bigint").alias("violations"),
    )


def _alone(asked: _Asked, tables: Tables) -> list[_Asked]:
    """The rules of a plan that broke, each with a plan of its own."""
    by_name = {(r.contract, r.table, r.name): r for r in row_rules()}
    return [
        _Asked((name,), lambda name=name: _row_counts([by_name[name]], tables[name[1]]).drop("dimension"))
        for name in asked.names
    ]


def evaluate(
    spark: SparkSession,
    tables: Tables,
    now: dt.datetime | None = None,
    contract: str | None = None,
) -> DataFrame:
    """All rules in one job; one that crashes is a finding, not the end of the run.

    A rule that cannot even be planned costs no job. A job that breaks is halved until the plans
    that broke it stand alone. Rows in the order of the rules.
    """
    asked = _asked(tables, now, contract)
    order = [name for a in asked for name in a.names]
    results: dict[tuple, tuple] = {}

    def failed(one: _Asked, exc: Exception) -> None:
        if len(one.names) > 1:
            run(planned(_alone(one, tables)))
        else:
            results[one.names[0]] = (None, f"{type(exc).__name__}: {exc}")

    def planned(part: list[_Asked]) -> list[tuple[_Asked, DataFrame]]:
        sound = []
        for one in part:
            try:
                sound.append((one, one.plan()))
            except Exception as exc:  # noqa: BLE001 - whatever broke it, it is the rule's result
                failed(one, exc)
        return sound

    def run(part: list[tuple[_Asked, DataFrame]]) -> None:
        if not part:
            return
        try:
            union = functools.reduce(DataFrame.unionByName, [plan for _, plan in part])
            results.update({tuple(r)[:3]: (r["violations"], None) for r in union.collect()})  # a row a rule
        except Exception as exc:  # noqa: BLE001 - the halves tell which rule it was
            if len(part) > 1:
                run(part[: len(part) // 2])
                run(part[len(part) // 2 :])
            else:
                failed(part[0][0], exc)

    run(planned(asked))
    return spark.createDataFrame([(*name, *results[name]) for name in order], RESULT)


def report(results: DataFrame, narrowed: bool = False) -> DataFrame:
    """Per contract: whether it passed, what failed, and whether that says "all clear".

    A run narrowed to one contract can pass, but has not looked at the others.
    """
    failed = F.col("error").isNotNull() | (F.col("violations") != 0)
    name = F.concat_ws(".", "table", "rule")
    return (
        results.groupBy("contract")
        .agg(F.sort_array(F.collect_list(F.when(failed, name))).alias("failed_checks"))
        .withColumn("passed", F.size("failed_checks") == 0)
        .withColumn("all_clear", F.col("passed") & F.lit(not narrowed))
    )


__all__ = [
    "DECLARED",
    "Declared",
    "QueryRule",
    "RowRule",
    "evaluate",
    "freshness",
    "report",
    "schema_violations",
    "violations",
]
