"""Pack documents into windows of tokens with little padding, by best-fit decreasing.

Texts become ids where they stand, and only the pieces' sizes move on. A document longer than a
window is first cut into full windows; what remains of each is dealt by hash into shards of
about ``SHARD`` pieces. A shard takes its pieces from long to short and puts each into the open
window with the least sufficient room; a segment tree over remaining capacities finds it. Each
shard leaves at most about one window badly filled, and no shard grows with the input.

Padding of a window is ``window`` minus what it holds; a window whose filling is a power of two
can also be batched at that size without any.

Defined cases: a null or empty text is its end id alone; equal rows are packed once each; the
table of pieces is written once, so a retry packs the same pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldmart.llm import scratch
from coldmart.llm.hashing import batches_of
from coldmart.llm.word_bpe import WordBpe

SHARD = 4096
END = 2


class Rooms:
    """Open windows by remaining capacity: a segment tree of how many there are."""

    def __init__(self, capacity: int) -> None:
        self._half = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._half)
        self._windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self._windows[room].append(window)
        self._add(room, 1)

    def _add(self, room: int, change: int) -> None:
        k, count = room + self._half, self._count
        while k:
            count[k] += change
            k >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least room of at least ``size`` and a window that has it, which is then taken out."""
        k, count, half = size + self._half, self._count, self._half
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < half:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - half
        self._add(room, -1)
        return room, self._windows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece, for pieces of at most ``capacity``."""
    window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms, opened = Rooms(capacity), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = rooms.tightest(size)
        if found is None:
            found = (capacity, opened)
            opened += 1
        room, window[k] = found
        offset[k] = capacity - room
        if room > size:
            rooms.put(room - size, int(window[k]))
    return window, offset


def _cut(batches, path: str, window: int):
    """(id, text) to pieces (id, start, length, ids_crc32, doc_tokens)."""
    bpe = WordBpe(path)
    for whole in batches:
        for batch in batches_of(whole, 1):
            owner, rows = [], []
            for k, ids in enumerate(bpe.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    owner.append(k)
                    rows.append((at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *columns],
                ["id", "start", "length", "ids_crc32", "doc_tokens"],
            )


def pack(
    docs: DataFrame, tokenizer: str, window: int = 4096, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row a piece.

    ``tokenizer`` is a file of the ``tokenizers`` library that every executor has.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    pieces = scratch.table(
        texts.mapInArrow(
            lambda batches: _cut(batches, tokenizer, window),
            f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
        ).withColumn("piece", F.monotonically_increasing_id()),
        "pieces",
    )
    # A full window is a sequence of its own; numbers from 2^62 on are theirs.
    full = pieces.filter(F.col("length") == window).select(
        "*", (F.col("piece") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    rest = pieces.filter(F.col("length") < window)
    shards = max(1, -(-rest.count() // SHARD))

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("piece", ignore_index=True)
        where, offset = best_fit_decreasing(shard["length"].to_numpy(), window)
        shard["sequence_id"] = (shard["shard"].to_numpy().astype(np.int64) << 32) + where
        shard["offset"] = offset
        return shard.drop(columns="shard")

    placed = (
        rest.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(packed, full.schema)
    )
    return full.union(placed).drop("piece")
