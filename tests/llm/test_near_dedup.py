"""Near-duplicates and components against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from coldmart.llm import near_dedup
from coldmart.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id bigint, text string"


def shingle_set(text, width=5):
    words = [w for w in (text or "").translate(LOWER).replace("\r", " ").replace("\x0b", " ").split() if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted(
        ((doc, len(s), least.get(find(k))) for k, ((doc, _), s) in enumerate(zip(rows, sets))), key=str
    )


def found(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]


def family(rng, base, copies, changes):
    out = []
    for _ in range(copies):
        new = list(base)
        for _ in range(changes):
            new[rng.randrange(len(new))] = "".join(rng.choices("xyz", k=6))
        out.append(" ".join(new))
    return out


def test_agrees_with_brute_force_on_odd_rows(spark):
    rng = random.Random(1)
    base = words(rng, 200)
    texts = [None, "", " \n", "a b c", "A  b\tC", "a b c d", " ".join(base), " ".join(base).upper(), "x" * 30000]
    texts += family(rng, base, 8, 2) + family(rng, words(rng, 300), 8, 4) + [" ".join(words(rng, 60))] * 3
    rows = list(enumerate(texts)) + [(None, " ".join(base)), (None, "lonely words here"), (3, "a b c")]
    docs = spark.createDataFrame(rows, DOC).select("*", *[F.lit(1).alias(n) for n in ("id", "node", "root", "row")])
    assert found(near_dedup.near_duplicates(docs)) == plain(rows)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {}
    for doc, text in rows:
        if not shingle_set(text):
            want[("empty", doc)] = 1
    components_of = {c for d, n, c in plain(rows) if n}
    named = {r.doc_id for r in kept.collect() if shingle_set(r.text) and r.doc_id is not None}
    assert named == {c for c in components_of if c is not None}
    assert sum(not shingle_set(r.text) for r in kept.collect()) == len(want)


def test_agrees_with_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert found(near_dedup.near_duplicates(docs)) == plain(rows)


def test_crowded_regions_lose_nothing(spark, monkeypatch):
    """One group of near copies far above the size of a region, with few partners a round."""
    monkeypatch.setattr(near_dedup, "REGION", 24)
    rng = random.Random(2)
    base = words(rng, 150)
    texts = [" ".join(base)] + family(rng, base, 120, 2) + [" ".join(words(rng, 80)) for _ in range(40)]
    # Many distinct sets with one signature: the difference is too small to show in it.
    wide = words(rng, 4000)
    texts += [" ".join([*wide[:k], "other", *wide[k:]]) for k in range(0, 3900, 60)]
    rows = list(enumerate(texts))
    assert found(near_dedup.near_duplicates(spark.createDataFrame(rows, DOC))) == plain(rows)


def test_crowds_of_several_groups_and_a_chain_lose_nothing(spark, monkeypatch):
    """Crowds that no prefix divides, and no first candidates: these save work, the rest finds all links."""
    monkeypatch.setattr(near_dedup, "DEPTHS", near_dedup.DEPTHS[:1])
    monkeypatch.setattr(near_dedup, "REGION", 6)
    monkeypatch.setattr(near_dedup, "BEST", 0)
    rng = random.Random(7)
    base = words(rng, 300)
    texts = []
    for k in range(2):
        texts += family(rng, [*base[:250], *words(rng, 30 + k)], 10, 2)
    link = list(base)
    for k in range(20):
        link[8 * k : 8 * k + 4] = words(rng, 4)
        texts.append(" ".join(link))
    rows = list(enumerate(texts))
    want = plain(rows)
    assert 1 < len({c for _, _, c in want}) < len(rows) / 4
    assert found(near_dedup.near_duplicates(spark.createDataFrame(rows, DOC))) == want


@pytest.mark.parametrize("shape", ["chain", "star", "none"])
def test_components(spark, shape):
    links = {"chain": [(k, k + 1) for k in range(40)], "star": [(0, k) for k in range(1, 90)] + [(100, 101)], "none": []}
    df = spark.createDataFrame(links[shape], "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    want = {"chain": dict.fromkeys(range(41), 0), "star": {**dict.fromkeys(range(90), 0), 100: 100, 101: 100}, "none": {}}
    assert got == want[shape]
