"""Signals between builds and their consumers: an append-only table of messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldmart.functions.rows import computed
from coldmart.schemas import SIGNAL

BUILT, REPORTED = "semantic_updated", "quality_report"
_BODY = (
    "event STRING, run_id STRING, published_at STRING, rows_arrived STRING, build_passed STRING, "
    "contract_id STRING, passed STRING, failed_checks STRING"
)


def _strict(name: str, pattern: str, cast: str) -> Column:
    """A field read as text and converted only when it is spelled as its type."""
    return F.when(F.col(f"_b.{name}").rlike(pattern), F.col(f"_b.{name}").try_cast(cast))


def decode_signals(pushed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(semantic_updated, quality_report, dead letters) of pushed envelopes.

    ``pushed`` has a ``value`` column with the envelope's JSON: base64 data holding a JSON
    object that names its event. Unknown fields are ignored; whatever cannot be read, or
    lacks a field its event requires, is a dead letter and never retried.
    """
    data = F.get_json_object("value", "$.message.data")
    # A strict alphabet: an envelope with anything else in it is not base64.
    base64 = F.when(
        data.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(data) % 4 == 0), F.unbase64(data)
    )
    text = computed(pushed, _text=F.trim(F.try_validate_utf8(base64.cast("string"))))
    whole = F.json_object_keys(F.concat(F.lit('{"body":'), F.col("_text"), F.lit(',"end":1}')))
    opened = computed(
        text,
        _b=F.when(
            F.col("_text").startswith("{") & (whole == F.array(F.lit("body"), F.lit("end"))),
            F.from_json("_text", _BODY),
        ),
    )
    checks = F.from_json("_b.failed_checks", "ARRAY<STRING>")
    read = computed(
        opened,
        event=F.col("_b.event"),
        run_id=F.col("_b.run_id"),
        published_at=F.col("_b.published_at").try_cast("timestamp"),
        rows_arrived=_strict("rows_arrived", "^-?[0-9]+$", "bigint"),
        build_passed=_strict("build_passed", "^(true|false)$", "boolean"),
        contract_id=F.col("_b.contract_id"),
        passed=_strict("passed", "^(true|false)$", "boolean"),
        failed_checks=F.when(F.col("_b.failed_checks").startswith("["), checks),
    )
    common = F.col("run_id").isNotNull() & F.col("published_at").isNotNull()
    built = (
        common
        & (F.col("event") == BUILT)
        & F.col("rows_arrived").isNotNull()
        & F.col("build_passed").isNotNull()
    )
    reported = (
        common
        & (F.col("event") == REPORTED)
        & F.col("contract_id").isNotNull()
        & F.col("passed").isNotNull()
        & F.col("failed_checks").isNotNull()
    )
    which = computed(
        read,
        _which=F.when(F.coalesce(built, F.lit(False)), BUILT).when(
            F.coalesce(reported, F.lit(False)), REPORTED
        ),
    )
    return (
        which.filter(F.col("_which") == BUILT).select(
            "event", "run_id", "published_at", "rows_arrived", "build_passed"
        ),
        which.filter(F.col("_which") == REPORTED).select(
            "event", "run_id", "published_at", "contract_id", "passed", "failed_checks"
        ),
        which.filter(F.col("_which").isNull()).select("value"),
    )


def _append(rows: DataFrame, path: str) -> None:
    columns = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SIGNAL.fields
    ]
    rows.select(*columns).write.mode("append").parquet(path)


def emit_build_signal(
    spark: SparkSession, path: str, run_id: str, rows_arrived: int, at: dt.datetime | None = None
) -> None:
    """Say that a build passed. Sent again after a retry, it carries the same ``run_id``."""
    moment = F.current_timestamp() if at is None else F.lit(at)
    _append(
        spark.range(1).select(
            F.lit(BUILT).alias("event"),
            F.lit(run_id).alias("run_id"),
            moment.alias("published_at"),
            F.lit(rows_arrived).alias("rows_arrived"),
            F.lit(True).alias("build_passed"),
        ),
        path,
    )


def emit_quality_report(
    report: DataFrame, path: str, run_id: str, at: dt.datetime | None = None
) -> None:
    """One message per contract out of ``quality.report``."""
    moment = F.current_timestamp() if at is None else F.lit(at)
    _append(
        report.select(
            F.lit(REPORTED).alias("event"),
            F.lit(run_id).alias("run_id"),
            moment.alias("published_at"),
            F.col("contract").alias("contract_id"),
            "passed",
            "failed_checks",
        ),
        path,
    )


def failed_reports(signals: DataFrame) -> DataFrame:
    """Failed contract runs, each once however often it was delivered."""
    return (
        signals.filter((F.col("event") == REPORTED) & ~F.col("passed"))
        .groupBy("event", "run_id", "contract_id")
        .agg(F.min(F.struct("published_at", "failed_checks")).alias("r"))
        .select("event", "run_id", "contract_id", "r.published_at", "r.failed_checks")
    )


def stream_failed_reports(signals: DataFrame, lateness: str = "1 day") -> DataFrame:
    return (
        signals.filter((F.col("event") == REPORTED) & ~F.col("passed"))
        .withWatermark("published_at", lateness)
        .dropDuplicatesWithinWatermark(["event", "run_id", "contract_id"])
    )


__all__ = [
    "decode_signals",
    "emit_build_signal",
    "emit_quality_report",
    "failed_reports",
    "stream_failed_reports",
]
