"""One row per natural key out of an at-least-once stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.functions.keys import row_json


def one_copy(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None
) -> DataFrame:
    """The smallest copy of every key: by its own JSON text, or by ``order`` if given.

    An aggregate rather than a ``row_number`` window: every map task reduces its copies to
    one before the shuffle, so a record delivered any number of times costs one row.
    """
    rank = row_json(*df.columns) if order is None else F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), rank).alias("_kept"))
        .select(*[F.col(c) if c in keys else F.col(f"_kept.{c}") for c in df.columns])
    )


def copies_disagree(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """The keys whose copies carry more than one distinct (non-null) ``value``.

    min <> max says the same as COUNT(DISTINCT) > 1 and combines on the map side.
    """
    present = [F.col(k).isNotNull() for k in keys]
    condition = present[0]
    for other in present[1:]:
        condition = condition & other
    return (
        df.filter(condition)
        .groupBy(*keys)
        .agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        .filter(F.col("_low") != F.col("_high"))
        .select(*keys)
    )
