"""How long each report is taken to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldmart.operators.ordered import CHUNK_ROWS, neighbours


def held_seconds(
    df: DataFrame,
    keys: Sequence[str] = ("boot_id", "address"),
    uptime: str = "uptime_seconds",
    cap: float = 600.0,
    name: str = "held_seconds",
    rows: int = CHUNK_ROWS,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Seconds until the next report of the same link, at most ``cap``; ``cap`` for the last one.

    ``copies``: the reports before one copy of each was chosen, see ``ordered.chunked``.
    """
    limit = F.lit(float(cap))
    gap = F.col("_next_uptime") - F.col(uptime)
    ahead = {"_next_uptime": F.col(uptime)}
    followed = neighbours(df, keys, [uptime], lead=ahead, rows=rows, copies=copies)
    held = F.greatest(F.lit(0.0), F.least(limit, F.coalesce(gap, limit)))
    return followed.withColumn(name, held).drop("_next_uptime")
