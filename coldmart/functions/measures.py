"""Aggregate expressions over held intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def watt_hours(watts: Column, seconds: Column) -> Column:
    return watts * seconds / F.lit(3600)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Σ value·weight / Σ weight over the rows that have a value; no weight gives NULL."""
    return F.try_divide(
        F.sum(value * weight).cast("double"),
        F.sum(F.when(value.isNotNull(), weight)).cast("double"),
    )


def share_of_time(condition: Column, weight: Column) -> Column:
    """The share of the weight during which ``condition`` held."""
    zero = F.lit(0).cast("bigint")
    return F.try_divide(
        F.sum(F.when(condition, weight).otherwise(zero)).cast("double"),
        F.sum(weight).cast("double"),
    )
