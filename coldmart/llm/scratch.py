"""Tables an operator writes once and reads several times, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from coldmart.session import shared_folder

_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/coldmart-llm"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under a name of its own and read back.

    It outlives lost executors, cuts the lineage, and later readers see the same rows.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that ``table`` wrote in this session, once no result depends on it."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A plain file in the shared folder, whatever store that is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for at in range(0, len(data), 1 << 22):
        out.write(bytearray(data[at : at + (1 << 22)]))
    out.close()
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
