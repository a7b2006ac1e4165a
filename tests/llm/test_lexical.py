from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from coldmart.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return TERM.findall(lowered)


def by_hand(docs, items, k):
    counted = [(key, terms(text)) for key, text in docs]
    counted = [(key, Counter(t), len(t)) for key, t in counted if t]
    n, length = len(counted), sum(c for *_, c in counted)
    df = Counter(t for _, tf, _ in counted for t in tf)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for key, tf, size in counted:
            m = 50 + (50 * size * n) // length
            score = 0
            for t in wanted & tf.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, key is None, key))
        for rank, (score, _, key) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, key, -score))
    return sorted(out, key=repr)


def check(spark, docs, items, k):
    of_docs = spark.createDataFrame(docs, "doc_id long, text string")
    of_items = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(of_docs.repartition(3), of_items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs, items, k)


WORDS = [f"w{k}" for k in range(40)] + ["É", "naïve", "x9", "UPPER"]


def prose(of, most):
    return " ".join(of.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=of.randrange(most)))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lexical, "SHORT", 3)


def test_a_corpus(spark):
    of = random.Random(1)
    docs = [(k, prose(of, 60)) for k in range(700)]
    docs += [(k, docs[3][1]) for k in range(1000, 1100)]  # equal scores
    items = [(k, prose(of, 12)) for k in range(25)]
    check(spark, docs, items, 10)


def test_nulls_empty_texts_repeated_rows_and_ties(spark):
    docs = [(None, "a b"), (1, None), (2, ""), (3, "A! b?"), (3, "A! b?"), (4, "c " * 50_000), (-9, "a,b"), (5, "...")]
    items = [(1, "a b"), (1, "c"), (2, None), (None, "c a"), (3, "zzz"), (1, "a b")]
    check(spark, docs, items, 4)


def test_nothing_to_search_or_to_ask(spark):
    check(spark, [], [(1, "a")], 3)
    check(spark, [(1, "a"), (2, "b")], [], 3)
    check(spark, [(1, "a"), (2, "b")], [(1, "?!")], 3)


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 9)
    of = random.Random(2)
    check(spark, [(k, prose(of, 30)) for k in range(200)], [(k, prose(of, 9)) for k in range(9)], 5)


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, "b", 5, 6)], "doc_id long, text string, n long, score long")
    items = spark.createDataFrame([(7, "b", "x", 1)], "item_id long, text string, term string, rank int")
    assert [r["doc_id"] for r in lexical.search(docs, items, 5).collect()]


@pytest.mark.parametrize("seed", range(6))
def test_one_shard_against_plain_sums(small, seed):
    of = np.random.default_rng(seed)
    n, n_terms, k = 400, 12, 15
    pairs = np.unique(of.integers(0, [n, n_terms], (3000, 2)), axis=0)
    pairs = pairs[pairs[:, 1] != 3]  # a wanted term that the shard lacks, before one that it has
    impacts = of.integers(0, 6 if seed % 2 else 10_000, len(pairs))
    shard = lexical.Shard(np.arange(n) * 3, pairs[:, 0], pairs[:, 1], impacts)
    best: list = []
    wanted = np.array([0, 3, 4, 7, 99])
    shard.search(wanted, best, k)
    sums = np.zeros(n, np.int64)
    held = np.isin(pairs[:, 1], wanted)
    np.add.at(sums, pairs[held, 0], impacts[held])
    want = sorted(((int(s), -3 * d) for d, s in enumerate(sums) if s), reverse=True)[:k]
    assert sorted(best, reverse=True) == want


def test_the_search_stops_early():
    n = 5000
    of = np.random.default_rng(0)
    impacts = of.integers(1, 100, n)
    impacts[[10, 4000]] = 10_000
    shard = lexical.Shard(np.arange(n), np.arange(n), np.zeros(n, np.int64), impacts)
    scored = []
    shard._score_all = lambda a, b, *rest: scored.append(int((b - a).sum()))
    best: list = []
    shard.search(np.array([0]), best, 2)
    assert best == [(10_000, -4000), (10_000, -10)] and not scored
