"""The star the registered reads are asked of, built once per session and scale."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from coldmart.catalog import adapters
from coldmart.plans.build import build_all
from coldmart.session import shared_folder, tune

# Fixed values of the adapter: the calendar has to reach over the year of the events.
CALENDAR_SPAN = ("2024-01-01", "2024-12-31")

_built: dict[tuple[str, str], dict[str, DataFrame]] = {}


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All marts over the whole ``events`` table, as published tables.

    The first caller pays for the build; later ones read its Parquet, as consumers of the
    published star do.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        tune(spark)
        _built[key] = build_all(
            adapters.raw_cooler(spark, sf_dir),
            adapters.raw_events(spark, sf_dir),
            f"{shared_folder(spark)}/coldmart/star-{uuid.uuid4().hex}",
            CALENDAR_SPAN,
            adapters.REPORT_ORDER,
            adapters.HANDSHAKE_ORDER,
        )
    return _built[key]
