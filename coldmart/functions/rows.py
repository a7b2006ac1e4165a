"""Helpers on whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns``, each evaluated once per row however often it is used afterwards.

    A filter on a derived column is pushed below the projection that derives it by copying
    the expression, and copies of copies multiply. An ``explode`` of a one-element array
    gives the same rows and is where that stops.
    """
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(packed)).alias("_once")).select(*kept, "_once.*")
