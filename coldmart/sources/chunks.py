"""The raw streams: chunked JSON lines in, partitioned Parquet out.

Chunks lie at ``v1/{stream}/dt=YYYY-MM-DD/*.jsonl.gz``. A gzip file cannot be split, but a
chunk is a few megabytes at most, so files are the unit of parallelism already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldmart.functions.rows import computed
from coldmart.schemas import RAW_COOLER, RAW_EVENTS, STREAMS

# The record types that are shipped, and the folder each goes to.
STREAM_OF_TYPE = {"cooler": "cooler", "event": "events"}
TABLES = {"raw_cooler": RAW_COOLER, "raw_events": RAW_EVENTS}


def read_raw(spark: SparkSession, root: str, stream: str) -> DataFrame:
    """All chunks of a stream with the declared schema plus ``dt`` from the folder names.

    Fields the schema does not name are ignored, missing ones are NULL. ``dt`` prunes
    folders before a file is listed twice or opened once.
    """
    schema = STREAMS[stream]
    return (
        spark.read.schema(T.StructType([*schema.fields, T.StructField("dt", T.DateType())]))
        .option("basePath", f"{root}/v1/{stream}")
        .json(f"{root}/v1/{stream}")
    )


def parse_lines(text: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of a ``value`` column holding one line each.

    A line counts if it is one JSON object. Empty, NUL-filled and torn lines, scalars and
    arrays are rejected, with the reason; other columns of ``text`` ride along.
    """
    rest = [c for c in text.columns if c != "value"]
    line = F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", "")
    # Asked without the schema: a readable object with a field of the wrong type is still a
    # record, with that field NULL. As one member among two, a line that is more or less
    # than one JSON value either does not parse or changes the members.
    members = F.json_object_keys(F.concat(F.lit('{"line":'), F.col("_line"), F.lit(',"end":1}')))
    whole = F.coalesce(members == F.array(F.lit("line"), F.lit("end")), F.lit(False))
    reason = (
        F.when(F.length("_line") == 0, "empty")
        .when(F.col("value").contains("\x00"), "nul")
        .when(~whole, "torn")
        .when(~F.col("_line").startswith("{"), "not_an_object")
    )
    marked = computed(computed(text, _line=line), reason=reason)
    good = marked.filter(F.col("reason").isNull()).select(
        *rest, F.from_json("_line", schema, {"mode": "PERMISSIVE"}).alias("_r")
    )
    rejected = marked.filter(F.col("reason").isNotNull()).select(*rest, "value", "reason")
    return good.select(*rest, "_r.*"), rejected


def read_lines(spark: SparkSession, root: str, stream: str) -> DataFrame:
    """The lines of a stream's chunks as text, for ``parse_lines``."""
    return spark.read.text(f"{root}/v1/{stream}")


def stamped(df: DataFrame, at: Column | None = None) -> DataFrame:
    """When the rows landed, which is not when the device spoke."""
    at = F.current_timestamp() if at is None else at
    return df.withColumn("_ingested_at", at).withColumn("_ingest_date", F.to_date("_ingested_at"))


def append_raw(df: DataFrame, path: str, at: Column | None = None) -> None:
    """Append to a raw table: partitioned by landing date, clustered by boot.

    ``rebalance`` groups a boot's rows but splits a boot that would outgrow one file.
    """
    (
        stamped(df, at)
        .hint("rebalance", "boot_id")
        .sortWithinPartitions("boot_id", "uptime_seconds")
        .write.mode("append")
        .partitionBy("_ingest_date")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    schema = T.StructType(
        [
            *TABLES[name].fields,
            T.StructField("_ingested_at", T.TimestampType()),
            T.StructField("_ingest_date", T.DateType()),
        ]
    )
    return spark.read.schema(schema).parquet(path)


def reset_raw(spark: SparkSession, path: str, name: str) -> None:
    """The raw table, empty again."""
    empty = spark.createDataFrame([], TABLES[name])
    stamped(empty).write.mode("overwrite").partitionBy("_ingest_date").parquet(path)


def route_records(records: DataFrame, root: str) -> DataFrame:
    """Write records to their streams, by type and UTC day; returns what was not shipped.

    ``records`` is a wide row with a ``type``. NULL fields are left out of the JSON, and
    types without a stream of their own stay behind.
    """
    stream = F.create_map(*[F.lit(x) for pair in STREAM_OF_TYPE.items() for x in pair])[
        F.col("type")
    ]
    routed = records.withColumn("stream", stream)
    for name, schema in STREAMS.items():
        columns = [c for c in schema.fieldNames() if c in records.columns]
        (
            routed.filter(F.col("stream") == name)
            .select(*columns, F.to_date("ts").alias("dt"))
            .hint("rebalance", "dt")
            .write.mode("append")
            .partitionBy("dt")
            .option("compression", "gzip")
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
            .json(f"{root}/v1/{name}")
        )
    return routed.filter(F.col("stream").isNull()).drop("stream")


__all__ = [
    "append_raw",
    "parse_lines",
    "read_lines",
    "read_raw",
    "read_table",
    "reset_raw",
    "route_records",
    "stamped",
]
