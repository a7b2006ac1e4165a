"""Joins against validity windows and lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.operators.ordered import CHUNK_ROWS, last_known


def asof_version(
    facts: DataFrame,
    versions: DataFrame,
    key: str,
    at: Column,
    values: Sequence[str],
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Left join on ``valid_from <= at < valid_to`` (a NULL end is open) within ``key``.

    A merge: facts and versions of a key stand in one order, a version before the facts of its
    instant, and each fact is told the last version before it. The versions of a key must not
    overlap; those that end where they begin hold for no instant. A key with a third of all
    facts, or ten thousand versions in a second, is cut into chunks of about ``rows`` rows like
    any long series, and the last version is carried across their ends. A fact without a key or
    an instant, or outside every version, gets NULLs.
    """
    start, end = F.unix_micros(valid_from), F.unix_micros(valid_to)
    # Said of the value and not by a filter, whose constraints Spark would copy with each alias.
    lasting = F.col(key).isNotNull() & (end.isNull() | (end > start))
    told = versions.select(
        F.col(key).alias("_key"),
        start.alias("_at"),
        F.lit(0).alias("_fact"),
        F.lit(0).cast("bigint").alias("_apart"),
        F.when(lasting, F.struct(*values, end.alias("_until"))).alias("_version"),
    )
    # Facts of one instant are told apart by a hash, so that they too can be cut.
    asking = (
        facts.withColumn("_key", F.col(key))
        .withColumn("_at", F.unix_micros(at))
        .withColumn("_fact", F.lit(1))
        .withColumn("_apart", F.xxhash64(*facts.columns))
    )
    merged = asking.unionByName(told, allowMissingColumns=True)
    order = ["_at", "_fact", "_apart"]
    found = last_known(merged, ["_key"], order, "_found", F.col("_version"), rows).filter("_fact = 1")
    until = F.col("_found._until")
    holds = until.isNull() | (F.col("_at") < until)
    return found.select(
        *facts.columns, *[F.when(holds, F.col(f"_found.{v}")).alias(v) for v in values]
    )


def lookup_or_absent(
    facts: DataFrame, dim: DataFrame, on: Column, value: str, absent: int = 0
) -> DataFrame:
    """Left join one surrogate key, with ``absent`` standing in for no match.

    No broadcast hint: the dimension grows with the fleet, so Spark decides from its
    measured size, and an oversized partition of the fact side is split by AQE.
    """
    return facts.join(dim, on, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(absent).cast("bigint"))
    )


def clock_anchor_join(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Left join of the one anchor per boot (W-2) onto its records."""
    return df.join(anchors, "boot_id", "left")
