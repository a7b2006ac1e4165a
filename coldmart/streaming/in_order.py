"""Stream state that meets its rows in order: they wait until the watermark has passed them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The processor runs in tasks; sent by value it needs no package installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# (what is known, rows in order, microseconds the clock stands at) -> (rows out, what is known now or
# None to forget the key, microseconds at which to be asked again or None)
Fold = Callable[[tuple | None, list[tuple], int], tuple[list[tuple], tuple | None, int | None]]


class InOrder(StatefulProcessor):
    """Keeps rows ``(microseconds, ...)`` until no earlier one can come, then folds them in order.

    What waits is what arrived within the lateness; what is known is one row. Rows behind the
    watermark never get here: Spark leaves them out and counts them.
    """

    def __init__(self, fold: Fold, key: str, fields: Sequence[str], waiting: str, known: str, out: Sequence[str]):
        self.fold, self.key, self.fields = fold, key, list(fields)
        self.waiting_schema, self.known_schema, self.out = waiting, known, list(out)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.known = handle.getValueState("known", self.known_schema)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            plain = batch[self.fields].astype(object).where(batch[self.fields].notna(), None)
            kept = [tuple(map(_plain, row)) for row in plain.itertuples(index=False, name=None)]
            if kept:
                self.waiting.appendList(kept)
                self._wake(min(row[0] for row in kept))
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((row for row in held if row[0] <= clock), key=_place)
        left = [row for row in held if row[0] > clock]
        known = tuple(self.known.get()) if self.known.exists() else None
        found, known, again = self.fold(known, due, clock)
        if due:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
                self._wake(min(row[0] for row in left))
        if known is None:
            self.known.clear()
        else:
            self.known.update(known)
            if again is not None and again > clock:
                self._wake(again)
        yield self._frame(key, found)

    def _frame(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in found], columns=[self.key, *self.out], dtype=object)

    def close(self) -> None:
        pass


def _plain(value):
    """A whole number that shared its column with NULLs came as a double."""
    return value if value is None or isinstance(value, str) else int(value)


def _place(row: tuple) -> tuple:
    """Rows by time, then by their other fields; NULL before any value."""
    return tuple((value is not None, value) if value is not None else (False, 0) for value in row)


def folded_in_order(
    rows: DataFrame,
    key: str,
    at: str,
    lateness: str,
    fields: str,
    fold: Fold,
    known: str,
    out: str,
) -> DataFrame:
    """``rows`` folded per ``key`` in the order of ``at``; ``fields`` names what else ``fold`` sees.

    ``fields``, ``known`` and ``out`` are schemas as text,
    of whole numbers and strings; no name may begin with an underscore. Timers go by event time, so state ends
    in an ``availableNow`` run as in one that never stops.
    """
    names = [part.split()[0] for part in fields.split(",")]
    timed = (
        rows.filter(F.col(at).isNotNull())
        .withWatermark(at, lateness)
        .withColumn("us", F.unix_micros(at))
        .select(F.col(key).cast("string").alias(key), at, "us", *names)
    )
    processor = InOrder(
        fold, key, ["us", *names], f"us BIGINT, {fields}", known, [part.split()[0] for part in out.split(",")]
    )
    return timed.groupBy(key).transformWithStateInPandas(
        processor, f"{key} STRING, {out}", outputMode="Append", timeMode="EventTime"
    )
