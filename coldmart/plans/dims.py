"""Dimensions: device versions, batteries, the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldmart.functions import integer_key
from coldmart.operators.ordered import CHUNK_ROWS, chunked, neighbours, running_count
from coldmart.schemas import BATTERY, CALENDAR, COOLER, conform
from coldmart.session import staged
from coldmart.sources.seeds import read_seed

# The decoder's name when no report named one, the version text of the
# member that stands for "firmware unknown", and the span of the calendar.
DEFAULT_MODEL = "everfrost"
UNKNOWN_VERSION = "unnegotiated"
CALENDAR_START, CALENDAR_END = "2026-01-01", "2027-12-31"


def version_changes(
    observed: DataFrame, key: str, at: str, version: str, rows: int = CHUNK_ROWS
) -> DataFrame:
    """The rows of ``observed`` that open a version: unlike the one before it in time.

    Adds ``version_episode`` (the how-manieth visit to this version) and ``closed_at`` (when
    the next version opened, NULL while current).
    """
    previous = F.col("_previous")
    order = [at, version]
    cut = chunked(observed, [key], order, rows)
    observed, rows = (observed, None) if cut is None else (cut, rows)
    keep = cut is not None
    opened = neighbours(
        observed, [key], order, lag={"_previous": F.col(version)}, rows=rows, keep_chunk=keep
    ).filter(previous.isNull() | (previous != F.col(version)))
    closed = neighbours(
        opened.drop("_previous"), [key], order, lead={"closed_at": F.col(at)}, rows=rows, keep_chunk=keep
    )
    return running_count(closed, [key, version], [at], "version_episode", rows=rows)


def device_versions(handshakes: DataFrame, updates: DataFrame) -> DataFrame:
    """Firmware history per device (SCD2), each with a lasting "unknown" first member."""
    described = updates.groupBy("serial_number").agg(
        F.max_by(
            F.struct(F.col("address").alias("v")), F.struct("updated_at", "address")
        )["v"].alias("last_address"),
        F.min("model").alias("model"),
        F.min("updated_at").alias("reported_at"),
    )
    first_shaken = handshakes.groupBy("serial_number").agg(
        F.min("negotiated_at").alias("shaken_at")
    )
    devices = described.join(first_shaken, "serial_number", "full").select(
        "serial_number",
        "last_address",
        F.coalesce("model", F.lit(DEFAULT_MODEL)).alias("model"),
        # least() skips NULLs: whichever stream spoke first, or the only one that did.
        F.least("reported_at", "shaken_at").alias("first_seen_at"),
        "shaken_at",
    )
    # One row per device, used twice; without the cut the reports would be read twice.
    devices = staged(devices, "devices")
    observed = (
        handshakes.join(devices.select("serial_number", "last_address", "model"), "serial_number")
        .withColumn("bluetooth_address", F.coalesce("bluetooth_address", "last_address"))
        .withColumn(
            "version",
            F.concat(
                F.coalesce("bluetooth_address", F.lit("")),
                F.lit("|"),
                F.coalesce("chip", F.lit("")),
                F.lit("|"),
                F.coalesce("firmware_version", F.lit("")),
            ),
        )
        .select(
            "serial_number", "model", "bluetooth_address", "chip", "firmware_version",
            "version", F.col("negotiated_at").alias("observed_at"),
        )
    )
    known = version_changes(observed, "serial_number", "observed_at", "version")
    # From the first sign to the first handshake; empty if that was the first sign.
    unknown = devices.select(
        "serial_number",
        "model",
        F.col("last_address").alias("bluetooth_address"),
        F.lit(None).cast("string").alias("chip"),
        F.lit(None).cast("string").alias("firmware_version"),
        F.lit(UNKNOWN_VERSION).alias("version"),
        F.col("first_seen_at").alias("observed_at"),
        F.col("shaken_at").alias("closed_at"),
        F.lit(1).cast("bigint").alias("version_episode"),
    )
    name = F.concat_ws(
        "|", "serial_number", "version", F.col("version_episode").cast("string")
    )
    return conform(
        known.unionByName(unknown).select(
            integer_key(name).alias("cooler_key"),
            "serial_number",
            "model",
            "bluetooth_address",
            "chip",
            "firmware_version",
            F.col("observed_at").alias("valid_from"),
            F.col("closed_at").alias("valid_to"),
            F.col("closed_at").isNull().alias("is_current"),
        ),
        COOLER,
    )


def battery_dim(updates: DataFrame) -> DataFrame:
    """Batteries seen so far, plus member 0 for "no battery installed"."""
    seen = (
        updates.filter(F.col("battery_serial_number").isNotNull())
        .groupBy(F.col("battery_serial_number").alias("serial_number"))
        .agg(F.min("updated_at").alias("first_seen_at"))
        .select(
            integer_key(F.col("serial_number")).alias("battery_key"),
            "serial_number",
            F.lit(False).alias("is_absent"),
            "first_seen_at",
        )
    )
    absent = updates.sparkSession.createDataFrame([(0, None, True, None)], BATTERY)
    return conform(seen.unionByName(absent), BATTERY)


def calendar(
    spark: SparkSession,
    start: str = CALENDAR_START,
    end: str = CALENDAR_END,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """One row per day with its ISO week, weekend and public-holiday flags."""
    if holidays is None:
        holidays = read_seed(spark, "japanese_holidays")
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    return calendar_of(days, holidays)


def calendar_of(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Calendar attributes for a column of distinct days named ``date``."""
    free = holidays.select(F.col("holiday_date").alias("date")).distinct()
    weekday = F.extract(F.lit("DAYOFWEEK_ISO"), F.col("date"))
    return conform(
        days.join(free.withColumn("_free", F.lit(True)), "date", "left").select(
            F.date_format("date", "yyyyMMdd").cast("bigint").alias("date_key"),
            "date",
            weekday.alias("day_of_week"),
            F.extract(F.lit("WEEK"), F.col("date")).alias("iso_week"),
            F.extract(F.lit("YEAROFWEEK"), F.col("date")).alias("iso_year"),
            F.month("date").alias("month"),
            (weekday >= 6).alias("is_weekend"),
            F.col("_free").isNotNull().alias("is_japanese_holiday"),
        ),
        CALENDAR,
    )
