"""Ordered computations over series one task could not hold.

A plain ``Window.partitionBy(device).orderBy(t)`` puts a device's whole history into one
task, and one device may own a third of all rows; a span of time is no bound either, as all
its reports may lie within an hour. Everything here cuts a series by its number of rows:

* ``chunked``        numbers the chunks of long series. A sample of the rows, chosen by a hash,
                     gives boundaries of about equal distance in the whole order, so reports of
                     one instant are cut apart by the columns behind the instant. Only rows that
                     are equal in all of ``order`` stay together.
* ``neighbours``     exact lag and lead at any distance.
* ``running_sum``    sums (``running_count``: counts) from the start of the series.
* ``last_known``     the last value that was not NULL.

The last three are scans in two levels: a window within each chunk, for which every row is
shuffled once, and a window over one row a chunk (of long series only) that is joined back. A
chunk holds about ``CHUNK_ROWS`` rows, so that second window sees a 262,144th of a series.

Boundaries and what chunks tell each other are broadcast: there is at most one of them to
``CHUNK_ROWS`` rows. Joined by a shuffle they would bring a series into one task after all.

Whether any series is long is asked of the sample when a scan is set up, one pass over keys and
order whose boundaries are written once. Where none is, as with most fleets, the plan is the
plain window and no more.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from coldmart.session import staged

HOUR = 3600
DAY = 86400
MICROS = 1_000_000

CHUNK_ROWS = 1 << 18
SAMPLES = 32  # rows sampled for each chunk; their number varies by about a sixth


def chunk_index(at: Column, length: int) -> Column:
    """The stretch a whole-number position falls in, floored for negatives too."""
    return F.call_function("div", at - F.pmod(at, F.lit(length)), F.lit(length)).cast("bigint")


def _matched(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys``, NULL equal to NULL; only the other columns of the small ``other`` are added."""
    renamed = F.broadcast(other.withColumnsRenamed({k: f"_of_{k}" for k in keys}))
    on = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(renamed, on, how).drop(*[f"_of_{k}" for k in keys])


def _sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """``SAMPLES`` rows of every ``rows``; of rows equal in keys and order all or none."""
    chosen = F.pmod(F.xxhash64(*keys, *order), F.lit(rows // min(SAMPLES, rows))) == 0
    return df.select(*keys, F.struct(*order).alias("_scan_place")).filter(chosen)


def boundaries(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int = CHUNK_ROWS,
    repeated: bool = False,
) -> DataFrame:
    """For each series of more than about ``rows`` rows where its chunks begin, in ``_bounds``.

    An array of one place for each chunk but the first. ``repeated`` rows count once.
    """
    sample = _sample(df, keys, order, rows)
    sample = sample.distinct() if repeated else sample
    each = min(SAMPLES, rows)
    places = F.sort_array(F.collect_list("_scan_place"))
    bounds = F.filter(places, lambda _, i: F.pmod(i + 1, F.lit(each)) == 0)
    return sample.groupBy(*keys).agg(bounds.alias("_scan_bounds")).filter(F.size("_scan_bounds") > 0)


def _begun(bounds: Column, place: Column) -> Column:
    """How many of the sorted ``bounds`` lie at or before ``place``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])

    def step(found: Column, width: Column) -> Column:
        fits = (found + width <= F.size(bounds)) & (F.get(bounds, found + width - 1) <= place)
        return F.when(fits, found + width).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int = CHUNK_ROWS,
    copies: DataFrame | None = None,
) -> DataFrame | None:
    """``df`` with ``_chunk``, which never falls along ``order``, and ``_long``: there are others.

    Nothing, if no series is long. ``copies`` holds the rows of ``df``, each any number of times,
    and is asked for the boundaries instead where ``df`` is dear to compute.
    """
    asked = df if copies is None else copies
    bounds = staged(boundaries(asked, keys, order, rows, copies is not None), "bounds")
    if bounds.isEmpty():
        return None
    cut = _matched(df, bounds, keys, "left")
    found = _begun(F.col("_scan_bounds"), F.struct(*order))
    number = F.when(F.col("_scan_bounds").isNull(), 0).otherwise(found)
    return (
        cut.withColumn("_chunk", number.cast("int"))
        .withColumn("_long", F.col("_scan_bounds").isNotNull())
        .drop("_scan_bounds")
    )


@dataclass(frozen=True)
class _Scan:
    """Rows ready for windows by ``inside``, with what the chunks before and behind tell them."""

    rows: DataFrame
    inside: WindowSpec
    cut: bool

    def told(self, inside: Column, across: str) -> Column:
        return F.coalesce(inside, F.col(across)) if self.cut else inside

    def finished(self, df: DataFrame, keep_chunk: bool, *used: str) -> DataFrame:
        df = df.drop(*used)
        if not keep_chunk:
            return df.drop("_chunk", "_long")
        return df if self.cut else df.withColumn("_chunk", F.lit(0)).withColumn("_long", F.lit(False))


def _scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int | None,
    summary: Mapping[str, Column],
    carry: Mapping[str, Column],
    copies: DataFrame | None = None,
) -> _Scan:
    """``summary`` has one row a chunk; ``carry`` is computed over those of a series.

    Rows that have their ``_chunk`` already, from a step before, keep it. Without ``rows`` the
    series are known to be short.
    """
    cut = df if "_chunk" in df.columns else (chunked(df, keys, order, rows, copies) if rows else None)
    if cut is None:
        return _Scan(df, Window.partitionBy(*keys).orderBy(*order), False)
    per_chunk = cut.filter("_long").groupBy(*keys, "_chunk").agg(*[e.alias(n) for n, e in summary.items()])
    told = per_chunk.select(*keys, "_chunk", *[e.alias(n) for n, e in carry.items()])
    rows_ = _matched(cut, told, [*keys, "_chunk"], "left")
    return _Scan(rows_, Window.partitionBy(*keys, "_chunk").orderBy(*order), True)


def _series(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    rows: int | None = CHUNK_ROWS,
    keep_chunk: bool = False,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Add the previous row's ``lag`` and the next row's ``lead`` expressions, exactly.

    Rows equal in ``order`` are neighbours in no stated order, and so are with a plain window.
    ``keep_chunk`` leaves ``_chunk`` and ``_long`` in the result, for a further step in this order;
    ``copies`` is that of ``chunked``.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    here = F.lit(True).alias("_there")
    packed = df.withColumn("_scan_seen", F.struct(here, *[e.alias(n) for n, e in lag.items()]))
    packed = packed.withColumn("_scan_ahead", F.struct(here, *[e.alias(n) for n, e in lead.items()]))
    place, series = F.struct(*order), _series(keys)
    scan = _scan(
        packed, keys, order, rows,
        {"_scan_first": F.min_by("_scan_ahead", place), "_scan_last": F.max_by("_scan_seen", place)},
        {"_scan_before": F.lag("_scan_last").over(series), "_scan_behind": F.lead("_scan_first").over(series)},
        copies,
    )
    before = scan.told(F.lag("_scan_seen").over(scan.inside), "_scan_before")
    behind = scan.told(F.lead("_scan_ahead").over(scan.inside), "_scan_behind")
    out = scan.rows.withColumn("_scan_lag", before).withColumn("_scan_lead", behind)
    named = {n: F.col(f"_scan_lag.{n}") for n in lag} | {n: F.col(f"_scan_lead.{n}") for n in lead}
    out = out.withColumns(named) if named else out
    used = ("_scan_seen", "_scan_ahead", "_scan_lag", "_scan_lead", "_scan_before", "_scan_behind")
    return scan.finished(out, keep_chunk, *used)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    value: Column,
    rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` over the series up to this row."""
    before = _series(keys).rowsBetween(Window.unboundedPreceding, -1)
    scan = _scan(
        df.withColumn("_scan_value", value), keys, order, rows,
        {"_scan_total": F.sum("_scan_value")},
        {"_scan_offset": F.sum("_scan_total").over(before)},
    )
    upto = scan.inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_scan_value").over(upto)
    total = total + F.coalesce("_scan_offset", F.lit(0)) if scan.cut else total
    return scan.finished(scan.rows.withColumn(name, total), False, "_scan_value", "_scan_offset")


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    condition: Column | None = None,
    rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Add how many rows (that meet ``condition``) the series holds up to this one."""
    one = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return running_sum(df, keys, order, name, one.cast("bigint"), rows)


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    value: Column,
    rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Add the last ``value`` of the series up to this row that is not NULL."""
    before = _series(keys).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("_scan_value").isNotNull(), F.struct(*order))
    scan = _scan(
        df.withColumn("_scan_value", value), keys, order, rows,
        {"_scan_latest": F.max_by("_scan_value", known)},
        {"_scan_carried": F.last("_scan_latest", ignorenulls=True).over(before)},
    )
    upto = scan.inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = scan.told(F.last("_scan_value", ignorenulls=True).over(upto), "_scan_carried")
    return scan.finished(scan.rows.withColumn(name, latest), False, "_scan_value", "_scan_carried")
