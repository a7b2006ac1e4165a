"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to the mean of all, made one long, rotated by a fixed random rotation,
and kept as the signs of its coordinates, packed to bits, with two numbers: its length and its
inner product with its code. From those and a rotated query the inner product of query and vector
is estimated without bias, with an error that is within ``ERROR`` standard deviations of a known
bound. In each block of rows, only vectors whose distance could be among the best, by that bound,
are measured exactly; the best measured ones of all blocks are the answer.

All rows are indexed and every query meets every block of codes; the random error is the only
way to miss a neighbour. Queries are the rows stated, in blocks. Both meet in cells: a task holds
the blocks of one lane, whose size is bounded, and reads the blocks of queries of one part after
another; of each query it returns the best of the lane. Nothing is joined, so nothing is broadcast;
a block of queries is shuffled once a lane, a block of rows once a part.

Defined cases: see ``vectors``; zero vectors take no part; equal distances go to the smaller id;
a row is not its own answer, nor is another with the query's id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.llm import vectors

ERROR = 3.0
SEED = 20_240_117
HELD = 1 << 23  # coordinates of the rows in a lane, about
LANES = 64  # fewer blocks than that are a lane each, about
PART = 2048  # blocks of queries in a part, about
SLACK = 1e-9  # of squared lengths, for rounding of products


def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


class Codes:
    """Encoding and estimating around a centre."""

    def __init__(self, centre: np.ndarray) -> None:
        self.centre, self.turn = centre, rotation(len(centre))

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, lengths, and inner products of directions with their codes."""
        away = (rows - self.centre) @ self.turn
        length = np.sqrt((away * away).sum(axis=1))
        along = np.abs(away).sum(axis=1) / np.sqrt(len(self.centre)) / np.where(length > 0, length, 1)
        return np.packbits(away > 0, axis=1), length, np.where(length > 0, along, 1.0)

    def bounds(self, queries, bits, length, along) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distances, queries x rows, as the codes tell."""
        width = len(self.centre)
        away = (queries - self.centre) @ self.turn
        far = np.sqrt((away * away).sum(axis=1))[:, None]
        signs = np.unpackbits(bits, axis=1, count=width).astype(np.float32) * 2 - 1
        straight = (away.astype(np.float32) @ signs.T).astype(np.float64) / np.sqrt(width)
        both = straight / along  # of the query and the vector's direction
        spread = np.sqrt(np.maximum(1 - along**2, 0) / along**2 / max(width - 1, 1))
        error = far * (ERROR * spread + 1e-6)
        middle = far**2 + length**2 - 2 * length * both
        return middle - 2 * length * error, middle + 2 * length * error


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    away = q - v
    return np.sqrt((away * away).sum(axis=1))


def best_of(codes: Codes, held: list[tuple], asked: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int):
    """Ids and distances of the ``k`` best in some blocks for each query, of those that the codes choose.

    Chosen ones are measured by one product a block, and those that are among the best by it, but
    for rounding, by differences.
    """
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
    reach = np.full(len(asked), np.inf)  # the k-th best so far
    squares = (q * q).sum(axis=1)
    for ids, v, bits, length, along in held:
        least, most = codes.bounds(q, bits, length, along)
        own = ids[None, :] == asked[:, None]
        least[own] = most[own] = np.inf
        limit = bounds**2 * (1 + 1e-9)
        if len(ids) > k:
            limit = np.minimum(limit, np.partition(most, k - 1, axis=1)[:, k - 1])
        lengths = (v * v).sum(axis=1)
        rough = squares[:, None] + lengths - 2 * (q @ v.T)
        slack = SLACK * (squares + lengths.max())
        chosen = (least <= limit[:, None]) & ~own & ~(rough > (reach**2 + slack)[:, None])
        for i in np.flatnonzero(chosen.any(axis=1)):
            at = np.flatnonzero(chosen[i])
            if len(at) > k:
                at = at[~(rough[i, at] > np.partition(rough[i, at], k - 1)[k - 1] + 2 * slack[i])]
            near = np.concatenate([best[i][0], ids[at]])
            exact = np.concatenate([best[i][1], distances(q[i], v[at])])
            top = vectors.first_of(exact, near, k)
            best[i] = near[top], exact[top]
            if len(top) == k:
                reach[i] = exact[top[-1]]
    return best


def search(
    df: DataFrame, every: int, k: int, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row whose id ``every`` divides."""
    spark = df.sparkSession
    rows = vectors.usable(df, key, vector).filter(F.exists("vec", lambda c: c != 0))
    width = vectors.width_of(rows)

    def total(batches):
        sums, n = np.zeros(width), 0
        for batch in batches:
            sums, n = sums + vectors.matrix(batch.column(1), width).sum(axis=0), n + batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width + 1)), pa.array(np.append(sums, float(n)))], ["place", "x"]
        )

    sums = dict(
        rows.mapInArrow(total, "place bigint, x double").groupBy("place").agg(F.sum("x")).toPandas().values.tolist()
    )  # as many numbers as a vector has
    centre = np.array([sums.get(c, 0.0) for c in range(width)]) / max(sums.get(width, 0.0), 1.0)
    known_ids, known = vectors.sample(rows, width)
    shared = spark.sparkContext.broadcast((Codes(centre), known_ids, known))  # vectors.SAMPLE rows

    def describe(block: dict) -> dict:
        bits, length, along = shared.value[0].encode(block["vec"])
        return {
            "ids": block["id"].astype("<i8").tobytes(), "vecs": block["vec"].astype("<f8").tobytes(),
            "bits": bits.tobytes(), "lengths": length.tobytes(), "along": along.tobytes(),
        }

    blocks = vectors.cut(
        rows, width, [], describe, "ids binary, vecs binary, bits binary, lengths binary, along binary"
    )

    def ask(batches):
        """A block of queries, with bounds from the sample."""
        _, ids, known = shared.value
        for batch in batches:
            out = []
            for deal, asked in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = asked.values.field("id").to_numpy()
                q = vectors.matrix(asked.values.field("vec"), width)
                bound = np.full(len(mine), np.inf)
                for i in range(len(mine)):
                    near = np.sort(distances(q[i], known[ids != mine[i]]))
                    if len(near) >= k:
                        bound[i] = near[k - 1]
                out.append(
                    {"deal": deal, "asked": mine.astype("<i8").tobytes(), "asked_vecs": q.tobytes(),
                     "bounds": bound.tobytes()}
                )
            yield pa.RecordBatch.from_pylist(out, schema=vectors.to_arrow(ask_schema))

    ask_schema = "deal bigint, asked binary, asked_vecs binary, bounds binary"
    queries = vectors.query_rows(rows, every)
    deals = vectors.deals(queries)
    asked = (
        vectors.dealt(queries, deals)
        .groupBy("deal")
        .agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
        .mapInArrow(ask, ask_schema)
    )

    def look(batches):
        """The blocks of a cell, then block by block the queries that meet them."""
        cell, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != cell:
                    cell, held = row[0], []
                if row[1] is not None:
                    ids = np.frombuffer(row[1], "<i8")
                    held.append(
                        (ids, np.frombuffer(row[2]).reshape(len(ids), width),
                         np.frombuffer(row[3], np.uint8).reshape(len(ids), -1),
                         np.frombuffer(row[4]), np.frombuffer(row[5]))
                    )
                elif held:
                    mine = np.frombuffer(row[6], "<i8")
                    q = np.frombuffer(row[7]).reshape(len(mine), width)
                    best = best_of(shared.value[0], held, mine, q, np.frombuffer(row[8]), k)
                    found = [np.repeat(mine, [len(b[0]) for b in best]), *map(np.concatenate, zip(*best))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    n = int(sums.get(width, 0.0))
    lanes = max(1, min(-(-n // vectors.ROWS), LANES), -(-n * width // HELD))
    parts = -(-deals // PART)
    # Blocks that one task cuts have numbers in a row: they go to lanes in a row.
    first = F.pmod(F.xxhash64(F.shiftright("block", 33)), F.lit(lanes))
    lane = F.pmod(first + F.col("block").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(lanes))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cells = (
        blocks.withColumn("lane", lane).withColumn("part", each(parts))
        .unionByName(
            asked.withColumn("lane", each(lanes)).withColumn("part", F.pmod("deal", F.lit(parts))),
            allowMissingColumns=True,
        )
        .select(
            (F.col("lane") * parts + F.col("part")).cast("int").alias("cell"),
            "ids", "vecs", "bits", "lengths", "along", "asked", "asked_vecs", "bounds",
        )
    )
    met = (
        cells.repartitionById(lanes * parts, "cell")
        .sortWithinPartitions("cell", F.col("ids").isNull())
        .mapInArrow(look, "query_id bigint, vec_id bigint, score double")
    )
    return vectors.best(met, k, F.col("score").asc()).select("query_id", "rank", "vec_id", "score")
