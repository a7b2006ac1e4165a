from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from coldmart.llm import catalog, merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    """All levels over some nodes, in plain Python."""
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([h(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, place):
    out = []
    for nodes in levels[:-1]:
        first = place // 8 * 8
        out += [n for k, n in enumerate(nodes[first : first + 8], first) if k != place]
        place //= 8
    return out


def folded(levels, place, leaf):
    for nodes in levels[:-1]:
        first = place // 8 * 8
        run = nodes[first : first + 8]
        run[place - first] = leaf
        leaf, place = h(run), place // 8
    return leaf


def by_hand(rows):
    """rows: (id, tree, leaf, claimed)"""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    low = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        low[name] = levels_of([r[2] for r in trees[name]])
    top = levels_of([low[name][-1][0] for name in names])
    root, out = top[-1][0], []
    for place, name in enumerate(names):
        for k, (key, _, leaf, claimed) in enumerate(trees[name]):
            proof = "".join(siblings(low[name], k) + siblings(top, place))
            end = folded(top, place, folded(low[name], k, claimed))
            out.append((key, leaf, low[name][-1][0], root, h([proof]), end, end == root, proof))
    return out


def check(spark, rows):
    leaves = spark.createDataFrame(rows, "id long, tree string, leaf string, claimed string")
    got = [tuple(r) for r in merkle.prove(leaves, proofs=True).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(rows), key=repr)


def leaf(k):
    return h([str(k)])


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_one_tree(spark, n):
    check(spark, [(k, "x", leaf(k), leaf(k if k % 3 else -k)) for k in range(n)])


def test_many_trees_of_all_sizes_with_a_null_one(spark):
    rows = [(k, f"t{t}", leaf((t, k)), leaf((t, k))) for t in range(20) for k in range(t + 1)]
    rows += [(k, None, leaf(("none", k)), leaf("wrong")) for k in range(3)]
    rows += [(0, "", leaf("empty"), leaf("empty")), (0, "é", leaf("e"), leaf("e")), (0, "Z", leaf("Z"), leaf("Z"))]
    check(spark, rows)


def test_more_than_one_block(spark):
    rows = [(k, "hot" if k % 50 else "rare", leaf(k), leaf(k if k % 7 else 0)) for k in range(4700)]
    check(spark, rows)


def test_repeated_and_null_ids(spark):
    rows = [(None, "a", leaf(1), leaf(1))] * 2 + [(5, "a", leaf(2), leaf(2))] * 9 + [(5, "a", leaf(3), leaf(4))]
    check(spark, rows)


def test_empty_table(spark):
    leaves = spark.createDataFrame([], "id long, tree string, leaf string, claimed string")
    assert merkle.prove(leaves).collect() == []


def test_leaves_of_values(spark):
    row = spark.createDataFrame([(1, None, "é", "")], "a long, b string, c string, d string")
    got = row.select(merkle.digest([F.col(c) for c in "abcd"])).first()[0]
    assert got == hashlib.sha256("1:1-2:é0:".encode()).hexdigest()


def test_the_query_lower_cases_texts_of_a_third(spark, tmp_path):
    rows = [(k, "SOME Text É" if k % 2 else None, "en", None, 3, "x") for k in range(40)] + [(None, "A", None, "s", 1, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tree string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["verified"] for r in catalog.queries()["op11_merkle"](spark, str(tmp_path)).collect()}
    wrong = {k for k in range(1, 40, 2) if zlib.crc32(str(k).encode()) % 3 == 0}
    assert {k for k, verified in got.items() if not verified} == wrong
    assert wrong and len(got) == 41
