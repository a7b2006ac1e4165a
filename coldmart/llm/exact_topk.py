"""Exact search for the largest inner products of whole-number vectors, by a pivot-distance index.

Vectors are scaled and floored to whole numbers. One more coordinate, ``sqrt(M - |v|^2)`` with the
largest squared length ``M``, makes all of them equally long, and for a query (with 0 there) the
largest inner product is the least Euclidean distance, so the triangle inequality holds.

Index: every row is keyed by its nearest pivot and its distance from it, sorted by both, and cut
into annuli of at most ``vectors.ROWS`` rows. A pivot with a third of all rows is as many annuli
as it needs; equal distances are told apart by id.

Search: a query's bound is its k-th best score so far, first among a bounded sample. Annuli that
cannot hold a score as good are left out: |d(q, p) - d(v, p)| is at most d(q, v). The nearest
annuli are searched first; their results tighten the bounds, the other annuli are compared with
the new ones, and what is then still in reach is searched. Scores are exact; so is the result.

Defined cases: see ``vectors``; equal scores go to the smaller id; a row is not its own answer,
nor is another with the query's id; scores beyond a long are shown as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldmart.llm import scratch, vectors

PIVOTS = 16
NEAREST = 4  # annuli of each block of queries in the first round
SLACK = 1e-6  # of distances, for rounding


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    limit = np.sqrt((q * q).sum(axis=1).max(initial=0) * (v * v).sum(axis=1).max(initial=0))
    if limit < 2**53:  # every partial sum is below it
        return (q @ v.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    long = exact(q).dot(exact(v).T) if q.size and v.size else np.zeros((len(q), len(v)), object)
    return np.clip(long, -(2**63), 2**63 - 1).astype(np.int64)


class Pivots:
    """Some vectors far from each other, in the space where all have one length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, longest: float, n: int = PIVOTS) -> None:
        self.longest, self.ids, self.rows = longest, ids, rows
        chosen = [0] if len(rows) else []
        while chosen and len(chosen) < min(n, len(rows)):
            self.points = rows[chosen]
            nearest = self.of_rows(rows).min(axis=1)
            if nearest.max() <= 0:
                break
            chosen.append(int(nearest.argmax()))
        self.points = rows[chosen]

    def _rest(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (v * v).sum(axis=1), 0))

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        both = v @ self.points.T + np.outer(self._rest(v), self._rest(self.points))
        return np.sqrt(np.maximum(2 * self.longest - 2 * both, 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        squares = (q * q).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(squares + self.longest - 2 * (q @ self.points.T), 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from a query a vector with at least this score can be."""
        squared = np.maximum((q * q).sum(axis=1) + self.longest - 2 * score, 0)
        return np.sqrt(squared) * (1 + SLACK) + SLACK * np.sqrt(self.longest)


def _block(block: dict) -> dict:
    return {
        "pivot": int(block["pivot"][0]), "low": float(block["distance"].min()),
        "high": float(block["distance"].max()), "ids": block["id"].astype("<i8").tobytes(),
        "vecs": block["vec"].astype("<f8").tobytes(),
    }


def search(
    df: DataFrame, every: int, k: int, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best for each row whose id ``every`` divides."""
    spark = df.sparkSession
    rows = vectors.usable(df, key, vector)
    width = vectors.width_of(rows)
    scaled = F.transform("vec", lambda c: F.floor(F.lit(scale) * c).cast("double"))
    rows = rows.select("id", scaled.alias("vec"))
    longest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, c: s + c * c))).first()[0] or 0.0
    pivots = Pivots(*vectors.sample(rows, width), longest)
    shared = spark.sparkContext.broadcast(pivots)  # vectors.SAMPLE rows

    def place(batches):
        for batch in batches:
            distances = shared.value.of_rows(vectors.matrix(batch.column(1), width))
            nearest = distances.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(nearest.astype(np.int32)),
                    pa.array(distances[np.arange(len(nearest)), nearest]),
                ],
                ["id", "vec", "pivot", "distance"],
            )

    placed = rows.mapInArrow(place, "id bigint, vec array<double>, pivot int, distance double")
    blocks = vectors.blocks_of(
        placed.repartitionByRange("pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id"),
        width,
        ["pivot", "distance"],
        _block,
        "pivot int, low double, high double, ids binary, vecs binary",
    )

    def ask(batches):
        at = shared.value
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), vectors.matrix(batch.column(1), width)
            scores = products(q, at.rows)
            bound = np.full(len(ids), np.nan)
            for i, mine in enumerate(ids):
                others = np.sort(scores[i][at.ids != mine])
                if len(others) >= k:
                    bound[i] = others[-k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], ["id", "vec", "deal", "bound"])

    queries = scratch.table(
        vectors.dealt(vectors.query_rows(rows, every)).mapInArrow(
            ask, "id bigint, vec array<double>, deal bigint, bound double"
        ),
        "queries",
    )

    def around(batches):
        """A block of queries: its ids, vectors and bounds, and its reach around every pivot."""
        for batch in batches:
            out = []
            for deal, asked in zip(batch.column(0).to_pylist(), batch.column(1)):
                asked = asked.values
                q, bound = vectors.matrix(asked.field("vec"), width), asked.field("bound").to_numpy()
                reach = np.where(np.isnan(bound), np.inf, shared.value.reach(q, np.nan_to_num(bound)))
                far = shared.value.of_queries(q)
                low, high = (far - reach[:, None]).min(axis=0), (far + reach[:, None]).max(axis=0)
                out.append(
                    {
                        "deal": deal, "asked": asked.field("id").to_numpy().astype("<i8").tobytes(),
                        "asked_vecs": q.astype("<f8").tobytes(), "reach": reach.astype("<f8").tobytes(),
                        "around": [
                            {"pivot": p, "near": float(a), "far": float(b), "middle": float(m)}
                            for p, (a, b, m) in enumerate(zip(low, high, far.mean(axis=0)))
                        ],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("deal", pa.int64()), ("asked", pa.binary()), ("asked_vecs", pa.binary()), ("reach", pa.binary()),
                 ("around", pa.list_(pa.struct([("pivot", pa.int32()), ("near", pa.float64()),
                                                ("far", pa.float64()), ("middle", pa.float64())])))]))

    def asked_of(bounded: DataFrame) -> DataFrame:
        gathered = bounded.groupBy("deal").agg(F.collect_list(F.struct("id", "vec", "bound")).alias("rows"))
        return scratch.table(
            gathered.mapInArrow(
                around,
                "deal bigint, asked binary, asked_vecs binary, reach binary,"
                " around array<struct<pivot: int, near: double, far: double, middle: double>>",
            ),
            "asked",
        )

    salts = 8

    def pairs(asked: DataFrame) -> DataFrame:
        """Which annuli the queries of a block can reach: ``deal, block, gap``."""
        rings = blocks.select("block", "pivot", "low", "high", F.pmod("block", F.lit(salts)).alias("salt"))
        wanted = (
            asked.select("deal", F.explode("around").alias("a"))
            .select("deal", "a.*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        )
        return wanted.join(rings, ["pivot", "salt"]).filter("near <= high AND far >= low").select(
            "deal", "block", F.greatest(F.col("low") - F.col("middle"), F.col("middle") - F.col("high")).alias("gap")
        )

    def look(batches):
        at = shared.value
        for batch in batches:
            found: list[list] = [[], [], []]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pivot, low, high, ids, vecs, asked, asked_vecs, reach = row
                ids, asked = np.frombuffer(ids, "<i8"), np.frombuffer(asked, "<i8")
                v = np.frombuffer(vecs, "<f8").reshape(len(ids), width)
                q = np.frombuffer(asked_vecs, "<f8").reshape(len(asked), width)
                reach, far = np.frombuffer(reach, "<f8"), at.of_queries(q)[:, pivot]
                met = np.flatnonzero((far - reach <= high) & (far + reach >= low))
                scores = products(q[met], v)
                for i, row_scores in zip(met.tolist(), scores):
                    others = np.flatnonzero(ids != asked[i])
                    top = others[vectors.first_of(-row_scores[others], ids[others], k)]
                    found[0] += [int(asked[i])] * len(top)
                    found[1] += ids[top].tolist()
                    found[2] += row_scores[top].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"]
            )

    def searched(asked: DataFrame, reached: DataFrame) -> DataFrame:
        questions = reached.select("deal", "block").join(asked.drop("around"), "deal")
        return (
            blocks.join(questions, "block")
            .select("pivot", "low", "high", "ids", "vecs", "asked", "asked_vecs", "reach")
            .mapInArrow(look, "query_id bigint, vec_id bigint, score bigint")
        )

    first = asked_of(queries)
    ring = F.row_number().over(Window.partitionBy("deal").orderBy("gap", "block"))
    near = scratch.table(pairs(first).withColumn("k", ring).filter(F.col("k") <= NEAREST), "near")
    found = scratch.table(vectors.best(searched(first, near), k, F.col("score").desc()), "found")
    tight = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("now"))
    bounded = queries.join(tight, "id", "left").withColumn(
        "bound", F.greatest("bound", F.col("now").cast("double"))
    )
    second = asked_of(bounded)
    rest = pairs(second).join(near.select("deal", "block"), ["deal", "block"], "left_anti")
    everything = found.select("query_id", "vec_id", "score").union(searched(second, rest))
    return vectors.best(everything, k, F.col("score").desc()).select("query_id", "rank", "vec_id", "score")
