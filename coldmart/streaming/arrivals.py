"""Rebuild the star when something arrived, and only then.

A run has two steps. First one ``availableNow`` stream lands new lines in the raw tables; its
checkpoint is the mark of how far was read, and a repeated batch overwrites its own folder. Then the
raw tables' row counts are compared with the counts of the last build. Where they say that something
is new, the star is built, announced, and only then the counts are written down. So a failed build
or announcement is repeated by the next run even if nothing more landed, and a raw table that was
replaced by a smaller one is built anew. Repeating is safe: a build publishes a fresh version, and an
announcement repeats its ``run_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldmart.plans.build import build_all
from coldmart.schemas import STREAMS
from coldmart.sources.chunks import parse_lines, stamped
from coldmart.sources.signals import emit_build_signal

TABLE_OF_STREAM = {"cooler": "raw_cooler", "events": "raw_events"}


def _landing(spark: SparkSession, root: str) -> DataFrame:
    """New lines of every stream, as text with the stream they belong to."""
    return (
        spark.readStream.format("text")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json*")
        .load(f"{root}/v1")
        .select("value", F.col("_metadata.file_path").alias("file"))
    )


def read_landed(spark: SparkSession, raw: str, stream: str) -> DataFrame:
    """Every batch of a raw table so far."""
    schema = T.StructType(
        [
            *STREAMS[stream].fields,
            T.StructField("_ingested_at", T.TimestampType()),
            T.StructField("_ingest_date", T.DateType()),
            T.StructField("_batch", T.LongType()),
        ]
    )
    return spark.read.schema(schema).parquet(f"{raw}/{TABLE_OF_STREAM[stream]}")


def land(spark: SparkSession, landing: str, raw: str, checkpoint: str) -> None:
    """Append what is new to the raw tables; lines that are no record go to ``_rejected`` with a reason."""

    def take(batch: DataFrame, number: int) -> None:
        for stream, table in TABLE_OF_STREAM.items():
            mine = batch.filter(F.col("file").contains(f"/v1/{stream}/"))
            good, rejected = parse_lines(mine.select("value", "file"), STREAMS[stream])
            # The batch number is a partition of its own, so a retry replaces its own rows.
            stamped(good.drop("file")).write.mode("overwrite").partitionBy("_ingest_date").parquet(
                f"{raw}/{table}/_batch={number}"
            )
            unread = rejected.select("file", "value", "reason")
            unread.write.mode("overwrite").parquet(f"{raw}/_rejected/table={table}/_batch={number}")

    query = (
        _landing(spark, landing)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def rejected_lines(spark: SparkSession, raw: str) -> DataFrame:
    """Lines that were landed but are no record: ``table, file, value, reason``."""
    schema = "file STRING, value STRING, reason STRING, table STRING, _batch BIGINT"
    return spark.read.schema(schema).parquet(f"{raw}/_rejected").drop("_batch")


MARKS = "run BIGINT, table STRING, built_through BIGINT"


def _marks(spark: SparkSession, raw: str) -> DataFrame:
    """The raw tables' counts at the last build that was announced."""
    try:
        runs = spark.read.schema(MARKS).parquet(f"{raw}/_marks")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARKS)  # nothing was built yet
    last = runs.agg(F.max("run").alias("last"))
    return runs.join(last, runs["run"] == last["last"]).drop("last")


def due(spark: SparkSession, raw: str) -> tuple[list[tuple[str, int, int]], int]:
    """(table, its rows, how many of them no build has seen) for each raw table; number of the next run."""
    counts = [(table, _rows_in(spark, f"{raw}/{table}")) for table in TABLE_OF_STREAM.values()]
    marks = _marks(spark, raw)
    fresh = arrived_since(spark.createDataFrame(counts, "table STRING, rows BIGINT"), marks.drop("run"))
    found = [tuple(r) for r in fresh.select("table", "rows", "fresh").collect()]  # a row a table
    last = marks.agg(F.max("run")).first()[0]
    return found, 0 if last is None else last + 1


def run_due(
    spark: SparkSession,
    landing: str,
    raw: str,
    marts: str,
    signals: str,
    checkpoint: str,
    build: Callable[..., dict[str, DataFrame]] = build_all,
    **build_options,
) -> int:
    """One scheduled run; returns how many builds (0 or 1) it made."""
    land(spark, landing, raw, checkpoint)
    found, run = due(spark, raw)
    rows = sum(fresh for _, _, fresh in found)
    if rows == 0:
        return 0
    build(
        read_landed(spark, raw, "cooler"), read_landed(spark, raw, "events"), marts,
        **build_options,
    )
    emit_build_signal(spark, signals, f"{checkpoint.rstrip('/').split('/')[-1]}-{run}", rows)
    seen = [(run, table, count) for table, count, _ in found]
    spark.createDataFrame(seen, MARKS).coalesce(1).write.mode("append").parquet(f"{raw}/_marks")
    return 1


def _rows_in(spark: SparkSession, path: str) -> int:
    """Rows of a partitioned table; from the files' footers alone."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as exc:
        if exc.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        return 0  # nothing was written, so there is no file to ask


def arrived_since(counts: DataFrame, marks: DataFrame) -> DataFrame:
    """``table, rows, fresh`` out of ``counts(table, rows)`` and ``marks(table, built_through)``.

    Raw tables only grow, so what is above the mark is new. One that holds less than its mark was
    replaced since; then all of it is new. A table without a mark has never been built.
    """
    mark = F.coalesce("built_through", F.lit(0).cast("bigint"))
    fresh = F.when(F.col("rows") < mark, F.col("rows")).otherwise(F.col("rows") - mark)
    return counts.join(marks, "table", "left").select("table", "rows", fresh.alias("fresh"))
