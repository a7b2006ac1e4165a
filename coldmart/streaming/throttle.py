"""At most one repeated failure per interval, counted from the last one kept.

Which rows are kept depends on which row was kept before, so a series is sequential by
nature, but it does not have to be walked in one task. Of the rows of one instant at most one
is kept, so one is chosen first. All a chunk of the others passes on is the time of the last
row it kept, and all it needs from before is the same number:

1. Each chunk (a bounded number of rows, see ``ordered.chunked``) works out that function
   alone: for every row it could start at, where the greedy walk ends. Walks merge, so the
   table keeps only the starts at which the outcome changes.
2. Neighbouring chunks' functions are composed, ``FAN`` at a time, in rounds, until a series
   has one; on the way back every block hands its parts what was kept before each.
3. Each chunk, told what was kept before it, picks its rows.

No task holds a series, only a chunk of it or ``FAN`` tables. A table is as long as there are
outcomes for starts within one interval of its beginning.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coldmart.operators.ordered import CHUNK_ROWS, MICROS, chunked

# The functions below run in tasks; sent by value they need no package installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = -(1 << 62)
FAN = 64  # functions composed at once


def _walk_ends(times: np.ndarray, starts: int, interval: int) -> np.ndarray:
    """Time of the last row kept when the walk begins at row 0, 1, ... ``starts - 1``."""
    size = len(times)
    follower = np.searchsorted(times, times + interval, side="left")
    last = np.where(follower < size, follower, np.arange(size))
    # Following the pointers of the pointers doubles the distance every time.
    while not np.array_equal(further := last[last], last):
        last = further
    return times[last[:starts]]


class Outcomes:
    """What a stretch makes of the time kept last before it.

    A walk that may go on at ``upto[i]`` or before, but not at ``upto[i - 1]``, ends at
    ``ends[i]``; one that may go on only after all of ``upto`` keeps nothing here.
    """

    def __init__(self, first: int, upto: np.ndarray, ends: np.ndarray) -> None:
        self.first, self.upto, self.ends = int(first), np.asarray(upto, np.int64), np.asarray(ends, np.int64)

    @staticmethod
    def of(times: np.ndarray, pause: int) -> Outcomes:
        """Of one chunk's sorted times. What was kept before it lies before its first row."""
        starts = min(int(np.searchsorted(times, times[0] + pause, side="left")) + 1, len(times))
        return Outcomes(times[0], times[:starts], _walk_ends(times, starts, pause))._merged()

    def _merged(self) -> Outcomes:
        changes = np.flatnonzero(np.r_[self.ends[1:] != self.ends[:-1], True])
        return Outcomes(self.first, self.upto[changes], self.ends[changes])

    def after(self, kept: np.ndarray, pause: int) -> np.ndarray:
        """The time kept last after this stretch, for each of ``kept`` before it."""
        place = np.searchsorted(self.upto, kept + pause, side="left")
        inside = place < len(self.upto)
        return np.where(inside, self.ends[np.minimum(place, len(self.upto) - 1)], kept)

    def then(self, later: Outcomes, pause: int) -> Outcomes:
        """This stretch and the one after it as one."""
        beyond = later.upto > self.upto[-1]
        upto = np.r_[self.upto, later.upto[beyond]]
        ends = np.r_[later.after(self.ends, pause), later.ends[beyond]]
        # What was kept before lies before the first row, so no walk goes on later than this.
        used = int(np.searchsorted(upto, self.first + pause, side="left")) + 1
        return Outcomes(self.first, upto[:used], ends[:used])._merged()


_TABLE = "first BIGINT, upto ARRAY<BIGINT>, ends ARRAY<BIGINT>"


def _tables(pdf: pd.DataFrame) -> list[Outcomes]:
    return [Outcomes(*row) for row in zip(pdf["first"], pdf["upto"], pdf["ends"])]


def _table_row(key: tuple, found: Outcomes, columns: list[str]) -> pd.DataFrame:
    row = [*key, found.first, found.upto.tolist(), found.ends.tolist()]
    return pd.DataFrame([row], columns=columns)


def throttle(
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    interval: float = 60.0,
    rows: int = CHUNK_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """The rows of ``events`` a reporter that stays quiet for ``interval`` seconds lets out.

    Of the rows of one instant the smallest by their other columns is let out. Rows without an
    instant are not.
    """
    keys, pause, columns = list(keys), int(interval * MICROS), events.columns
    tie = F.struct(*[c for c in columns if c not in (*keys, at)] or [at])
    whole = F.min_by(F.struct(*columns), tie).alias("_row")
    timed = events.withColumn("_at", F.unix_micros(at)).filter(F.col("_at").isNotNull())
    single = timed.groupBy(*keys, "_at").agg(whole)

    def pick(pdf: pd.DataFrame, kept: int) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable")
        times, chosen = pdf["_at"].to_numpy(), []
        while (place := int(np.searchsorted(times, kept + pause, side="left"))) < len(times):
            chosen.append(place)
            kept = int(times[place])
        return pdf.iloc[chosen][columns]

    cut = chunked(timed.select(*keys, "_at").distinct(), keys, ["_at"], rows)
    flat = single.select(*[F.col(f"_row.{c}").alias(c) for c in columns], "_at")
    if cut is None:
        alone = flat.groupBy(*keys).applyInPandas(lambda pdf: pick(pdf, NEVER), events.schema)
        return alone.select(*columns)
    told = cut.withColumnsRenamed({k: f"_of_{k}" for k in keys}).withColumnRenamed("_at", "_of_at")
    same = F.col("_at") == F.col("_of_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    placed = flat.join(told, same).select(*columns, "_at", "_chunk")

    key_ddl = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "_chunk", "first", "upto", "ends"]

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _table_row(key, Outcomes.of(np.sort(pdf["_at"].to_numpy()), pause), names)

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tables = _tables(pdf.sort_values("_chunk"))
        return _table_row(key, functools.reduce(lambda a, b: a.then(b, pause), tables), names)

    def hand_on(_: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        kept, carried = before["_kept"].to_numpy()[:1], []
        for table in _tables(pdf):
            carried.append(int(kept[0]))
            kept = table.after(kept, pause)
        return pdf[[*keys, "_chunk"]].assign(_kept=carried)

    level = cut.select(*keys, F.col("_chunk").cast("bigint").alias("_chunk"), "_at")
    level = level.groupBy(*keys, "_chunk").applyInPandas(summarise, f"{key_ddl}, _chunk BIGINT, {_TABLE}")
    most, levels = cut.agg(F.max("_chunk")).first()[0], [level]
    block = F.expr(f"_chunk div {fan}").alias("_chunk")
    while most >= fan:
        level = level.groupBy(*keys, block).applyInPandas(compose, f"{key_ddl}, _chunk BIGINT, {_TABLE}")
        levels.append(level)
        most //= fan
    # Named anew, as they meet the tables they come from.
    kept = levels[-1].select(*[F.col(k).alias(k) for k in keys]).distinct()
    kept = kept.withColumn("_chunk", F.lit(0).cast("bigint"))
    kept = kept.withColumn("_kept", F.lit(NEVER).cast("bigint"))
    for level in reversed(levels):
        kept = (
            level.groupBy(*keys, block)
            .cogroup(kept.groupBy(*keys, "_chunk"))
            .applyInPandas(hand_on, f"{key_ddl}, _chunk BIGINT, _kept BIGINT")
        )

    def pick_told(_: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return pick(pdf, int(before["_kept"].iloc[0]))

    placed = placed.withColumn("_chunk", F.col("_chunk").cast("bigint"))
    return (
        placed.groupBy(*keys, "_chunk")
        .cogroup(kept.groupBy(*keys, "_chunk"))
        .applyInPandas(pick_told, events.schema)
    )


def stream_throttle(
    events: DataFrame, key: str, at: str, columns: Sequence[str], interval: float = 60.0
) -> DataFrame:
    """Streaming form: per key the state is the time of the last row let out.

    A row older than that comes too late to be let out.
    """
    pause = int(interval * MICROS)
    schema = ", ".join(
        f"{c} {events.schema[c].dataType.simpleString()}" for c in (key, at, *columns)
    )

    def let_out(
        _: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        (kept,) = state.get if state.exists else (NEVER,)
        pdf = pd.concat(list(batches)).sort_values("_at", kind="stable")  # one micro-batch
        chosen = []
        for place, time in enumerate(pdf["_at"]):
            if time - pause >= kept:
                chosen.append(place)
                kept = int(time)
        state.update((kept,))
        yield pdf.iloc[chosen][[key, at, *columns]]

    return (
        events.select(key, at, *columns)
        .withColumn("_at", F.unix_micros(at))
        .groupBy(key)
        .applyInPandasWithState(
            let_out, schema, "kept BIGINT", "append", GroupStateTimeout.NoTimeout
        )
    )
