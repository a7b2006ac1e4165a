"""Exact and approximate search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldmart.llm import exact_topk, rotated_codes, vectors

SCHEMA = "vec_id bigint, embedding array<float>"


def clashing(df):
    return df.select("*", *[F.lit(1).alias(n) for n in ("id", "vec", "pivot", "block", "deal", "score", "rank")])


def table(spark, seed, n, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [(int(k), (centres[k % 6] + 0.3 * rng.normal(size=width)).astype(np.float32).tolist()) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(n // 3)]  # one common vector
    odd = [[0.0] * width, None, [None] * width, [float("nan")] * width, [float("inf")] * width, [], [1.0, 2.0]]
    rows += [(100 * (k + 1_000), v) for k, v in enumerate(odd)]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (100, rows[100][1])]
    return spark.createDataFrame(rows, SCHEMA), rows, width


def fit(rows, width, zero=True):
    out = []
    for k, v in rows:
        if k is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if zero or any(v):
            out.append((k, np.array([*v, *[0.0] * (width - len(v))])))
    return out


def plain(rows, every, k, score, largest):
    queries = {}
    for i, v in rows:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v, key=tuple)
    out = []
    for i, q in queries.items():
        scored = [(score(q, v), j) for j, v in rows if j != i]
        scored.sort(key=lambda s: (-s[0] if largest else s[0], s[1]))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 2048])
def test_exact_topk_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "ROWS", block)
    monkeypatch.setattr(vectors, "SAMPLE", 40)
    df, rows, width = table(spark, 1, 600)
    got = sorted(map(tuple, exact_topk.search(clashing(df), every=50, k=5).collect()))
    scored = fit([(k, v) for k, v in rows], width)
    scored = [(k, np.floor(256 * v)) for k, v in scored]
    assert got == plain(scored, 50, 5, lambda q, v: int(q @ v), True)


def test_exact_topk_of_few_and_of_nothing(spark):
    two = spark.createDataFrame([(0, [1.0]), (50, [-2.0])], SCHEMA)
    got = sorted(map(tuple, exact_topk.search(two, 50, 5).collect()))
    assert got == [(0, 1, 50, -131072), (50, 1, 0, -131072)]
    assert exact_topk.search(two.limit(1), 50, 5).count() == 0
    assert exact_topk.search(two.limit(0), 50, 5).count() == 0


def test_products_of_long_vectors_are_exact():
    q, v = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**30, 1.0]])
    assert exact_topk.products(q, v).tolist() == [[2**60 + 3, 2**63 - 1]]


def test_codes_bound_the_distance():
    rng = np.random.default_rng(2)
    rows, queries = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    codes = rotated_codes.Codes(rows.mean(axis=0))
    least, most = codes.bounds(queries, *codes.encode(rows))
    exact = ((queries[:, None] - rows[None]) ** 2).sum(axis=2)
    assert ((least <= exact) & (exact <= most)).mean() > 0.99
    assert (least > np.sort(exact, axis=1)[:, 9:10]).mean() > 0.2  # and they tell something


@pytest.mark.parametrize("block", [16, 2048])
def test_nearest_neighbours_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "ROWS", block)
    monkeypatch.setattr(vectors, "SAMPLE", 40)
    df, rows, width = table(spark, 3, 600)
    got = sorted(map(tuple, rotated_codes.search(clashing(df), every=100, k=10).collect()))
    want = plain(
        fit(rows, width, zero=False), 100, 10, lambda q, v: float(rotated_codes.distances(q[None], v[None])[0]), False
    )
    assert [g[:2] for g in got] == [w[:2] for w in want]
    met = len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want})
    assert met / len({(w[0], w[2]) for w in want}) >= 0.95
    exact = {(i, j): s for i, _, j, s in plain(fit(rows, width, zero=False), 100, 10**9, lambda q, v: float(np.sqrt(((q - v) ** 2).sum())), False)}
    assert all(g[3] == pytest.approx(exact[g[0], g[2]], abs=1e-12) for g in got)


def test_blocks_and_queries_meet_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 16)
    monkeypatch.setattr(vectors, "SAMPLE", 40)
    df, _, width = table(spark, 4, 900)
    found = rotated_codes.search(df, every=3, k=4)
    one = sorted(map(tuple, found.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    monkeypatch.setattr(vectors, "ASKED", 8)
    for held, lanes, part in ((64, 1, 2048), (5, 2, 2048), (4, 3, 7), (1, 64, 1)):
        monkeypatch.setattr(rotated_codes, "HELD", held * 16 * width)
        monkeypatch.setattr(rotated_codes, "LANES", lanes)
        monkeypatch.setattr(rotated_codes, "PART", part)
        assert sorted(map(tuple, rotated_codes.search(df, every=3, k=4).collect())) == one


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e200])
def test_the_best_of_blocks_are_those_that_the_codes_choose(offset):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(400, 16)) + offset
    rows[200:300] = rows[7]  # equal distances go to the smaller id
    ids, q = rng.permutation(400).astype(np.int64), rows[[7, 8, 9]]
    with np.errstate(all="ignore"):
        codes = rotated_codes.Codes(rows.mean(axis=0))
        asked, bounds = ids[[7, 8, 9]], np.full(3, np.inf)
        blocks = [(ids[s], rows[s], *codes.encode(rows[s])) for s in (slice(0, 150), slice(150, 396), slice(396, 400))]
        got = rotated_codes.best_of(codes, blocks, asked, q, bounds, 5)
        for i in range(3):
            kept = []
            for own, v, *code in blocks:
                least, most = (x[0] for x in codes.bounds(q[i : i + 1], *code))
                least[own == asked[i]] = most[own == asked[i]] = np.inf
                limit = np.sort(most)[4] if len(own) > 5 else np.inf
                kept += [
                    (float(rotated_codes.distances(q[i], v[[j]])[0]), int(own[j]))
                    for j in np.flatnonzero((least <= limit) & (own != asked[i]))
                ]
            assert list(zip(got[i][1].tolist(), got[i][0].tolist())) == sorted(kept)[:5]


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = rotated_codes.search(df, every=100, k=10).collect()
    rows = df.toPandas()
    ids, all_rows = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    hits = total = 0
    for i in np.unique([g.query_id for g in got]):
        away = np.sqrt(((all_rows - all_rows[ids == i][0]) ** 2).sum(axis=1))
        away[ids == i] = np.inf
        best = set(ids[np.lexsort((ids, away))[:10]].tolist())
        hits += len(best & {g.vec_id for g in got if g.query_id == i})
        total += 10
    assert len(got) == total and hits / total >= 0.95


def test_nearest_of_few_and_of_nothing(spark):
    two = spark.createDataFrame([(0, [1.0]), (100, [-2.0]), (200, [0.0])], SCHEMA)
    assert sorted(map(tuple, rotated_codes.search(two, 100, 10).collect())) == [(0, 1, 100, 3.0), (100, 1, 0, 3.0)]
    assert rotated_codes.search(two.limit(0), 100, 10).count() == 0
