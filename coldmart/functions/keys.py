"""Surrogate keys: hashes of natural keys, so a rebuild never renumbers anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_key(text: Column) -> Column:
    return F.sha2(text, 256)


def integer_key(text: Column) -> Column:
    """A positive BIGINT out of the first 60 bits of SHA-256; 0 stays free for "absent"."""
    return F.greatest(
        F.lit(1).cast("bigint"),
        F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint"),
    )


def row_json(*columns: str) -> Column:
    """The row as JSON text, nulls spelled out and instants to the microsecond."""
    return F.to_json(
        F.struct(*columns),
        {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"},
    )
