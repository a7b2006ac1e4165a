"""The star on disk: whole-table replacement through versioned folders and one pointer."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldmart.schemas import MARTS, conform

PARTITIONED = ("fact_cooler_state_update", "fact_cooler_snapshot", "fact_cooler_pulldown")
POINTER = "version STRING, published_at TIMESTAMP"


def write_mart(df: DataFrame, root: str, name: str, version: str) -> DataFrame:
    """Write one mart in its declared schema under ``version`` and read it back.

    Facts are clustered by their date before the write, so a task writes few partitions;
    AQE splits a date that outgrows one task (``REBALANCE``, not a fixed ``repartition``).
    """
    df = conform(df, MARTS[name])
    path = f"{root}/{version}/{name}"
    if name in PARTITIONED:
        order = [c for c in ("boot_id", "serial_number") if c in df.columns]
        df = df.hint("rebalance", "partition_date").sortWithinPartitions("partition_date", *order)
        df.write.mode("overwrite").partitionBy("partition_date").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return _read(df.sparkSession, path, name)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    schema = MARTS[name]
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def new_version() -> str:
    return uuid.uuid4().hex


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make ``version`` the one readers see. Readers of the old one keep their files."""
    spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at")
    ).write.mode("append").parquet(f"{root}/_pointer")


def current_version(spark: SparkSession, root: str) -> str | None:
    try:
        pointers = spark.read.schema(POINTER).parquet(f"{root}/_pointer")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing was published yet
    row = pointers.agg(F.max_by("version", F.struct("published_at", "version")).alias("v")).first()
    return row["v"]


def read_mart(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"{root}: nothing was published here")
    return _read(spark, f"{root}/{version}/{name}", name)
