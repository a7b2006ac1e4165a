"""Band dimensions: half-open ranges decided when the question is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldmart.sources.seeds import UNITS, read_seed

# A double's size is a power of two up to about 1,024; a band without a bound reaches there.
FARTHEST = 1100


def band(spark: SparkSession, name: str) -> DataFrame:
    unit = UNITS[name]
    return (
        read_seed(spark, f"band_{unit}")
        .filter(F.col("band") == name)
        .select(
            "band_key",
            "label",
            F.col(f"lower_{unit}").alias("lower"),
            F.col(f"upper_{unit}").alias("upper"),
            "sort_order",
        )
    )


def size_bucket(value: Column) -> Column:
    """The sign and power of two of a number: a bucket that grows with it, one of a few thousand."""
    power = F.floor(F.log2(F.abs(value) + 1)).cast("int")
    bucket = F.when(value < 0, -power - 1).otherwise(power)
    far = F.when(value < 0, -FARTHEST).otherwise(FARTHEST)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), far).otherwise(bucket)


def with_band(df: DataFrame, value: Column, bands: DataFrame, prefix: str) -> DataFrame:
    """Add ``{prefix}_key/_label/_order`` of the band holding ``value``; NULL has no band.

    A range join by an equal key: each band is listed under every bucket it touches, and a row
    meets the bands of its own bucket. Spark sends a small band table to all tasks by itself and
    shuffles a large one, so any number of bands will do.
    """
    number = value.cast("double")
    low = F.when(F.col("lower").isNull(), -FARTHEST).otherwise(size_bucket(F.col("lower").cast("double")))
    high = F.when(F.col("upper").isNull(), FARTHEST).otherwise(size_bucket(F.col("upper").cast("double")))
    listed = bands.select(
        F.explode(F.sequence(low, high)).alias("_bucket"),
        F.col("lower").alias("_lower"),
        F.col("upper").alias("_upper"),
        F.col("band_key").cast("bigint").alias(f"{prefix}_key"),
        F.col("label").alias(f"{prefix}_label"),
        F.col("sort_order").cast("bigint").alias(f"{prefix}_order"),
    )
    inside = (F.col("_lower").isNull() | (F.col("_number") >= F.col("_lower"))) & (
        F.col("_upper").isNull() | (F.col("_number") < F.col("_upper"))
    )
    placed = df.withColumn("_number", number).withColumn("_of", size_bucket(F.col("_number")))
    return placed.join(listed, (F.col("_of") == F.col("_bucket")) & inside, "left").drop(
        "_number", "_of", "_bucket", "_lower", "_upper"
    )
