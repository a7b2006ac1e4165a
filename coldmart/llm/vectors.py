"""Rows of vectors in blocks, and queries in blocks, for searches by matrix products.

A vector takes part if it is not null and holds neither nulls nor non-finite numbers, and its row
has an id; shorter vectors count as padded with zeros. Blocks are rows of a table: ids and vectors
of up to ``ROWS`` rows as bytes, so one row of a join is one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldmart.llm import scratch

ROWS = 2048  # vectors in a block
ASKED = 128  # queries in a block, about
SAMPLE = 1024  # rows from which pivots and first bounds come


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id bigint, vec array<double>`` of the rows that take part."""
    x = F.col(vector)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(x.isNotNull() & F.col(key).isNotNull() & F.coalesce(fit, F.lit(False))).select(
        F.col(key).cast("bigint").alias("id"), x.cast("array<double>").alias("vec")
    )


def width_of(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("vec"))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles."""
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(np.float64)
    at = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), at.astype(np.int64)] = flat
    return out


def sample(vectors: DataFrame, width: int, n: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``n`` rows with the least hashes (a bounded number, on the driver)."""
    rows = vectors.orderBy(F.xxhash64("id", "vec"), "id").limit(n).toArrow()
    return rows.column("id").to_numpy(), matrix(rows.column("vec").combine_chunks(), width)


def cut(
    rows: DataFrame, width: int, keys: list[str], describe: Callable[[dict], dict], schema: str
) -> DataFrame:
    """Rows of ``rows(id, vec, *keys)``, as they lie, to blocks of equal ``keys[0]``.

    ``describe`` gets a block's columns as arrays and returns what the block holds (``schema``).
    """
    columns = ["id", "vec", *keys]

    def build(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def shaped(block):
            return pa.RecordBatch.from_pylist([describe(block)], schema=kinds)

        for batch in batches:
            new = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(columns) if n != "vec"}
            new["vec"] = matrix(batch.column(1), width)
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in columns}
            while len(held["id"]):
                first = held[keys[0]] if keys else np.zeros(len(held["id"]))
                run = int(np.argmax(first != first[0])) if (first != first[0]).any() else len(first)
                n = min(run, ROWS)
                if n == len(first) and n < ROWS:
                    break  # more of it may come
                yield shaped({c: v[:n] for c, v in held.items()})
                held = {c: v[n:] for c, v in held.items()}
        if held is not None and len(held["id"]):
            yield shaped(held)

    kinds = to_arrow(schema)
    return rows.select(*columns).mapInArrow(build, schema).withColumn("block", F.monotonically_increasing_id())


def blocks_of(
    rows: DataFrame, width: int, keys: list[str], describe: Callable[[dict], dict], schema: str
) -> DataFrame:
    """``cut``, written once."""
    return scratch.table(cut(rows, width, keys, describe, schema), "blocks")


def to_arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def query_rows(vectors: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``; of rows that share an id, the least vector."""
    return (
        vectors.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    )


def deals(queries: DataFrame) -> int:
    """How many blocks of about ``ASKED`` there are of ``queries``."""
    return max(1, -(-queries.count() // ASKED))


def dealt(queries: DataFrame, n: int | None = None) -> DataFrame:
    """``queries`` with a ``deal``, one of ``n``: about ``ASKED`` of them share one."""
    return queries.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(n or deals(queries))))


def best(found: DataFrame, k: int, order) -> DataFrame:
    """The first ``k`` of each query, ranked. Spark drops the others before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_of(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` least values, ties to smaller ids; complete where ties reach across."""
    if len(values) > k:
        limit = np.partition(values, k - 1)[k - 1]
        kept = np.flatnonzero(values <= limit)
    else:
        kept = np.arange(len(values))
    return kept[np.lexsort((ids[kept], values[kept]))][:k]
