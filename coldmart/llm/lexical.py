"""Ranked lexical search: the documents that score highest for each item, exactly.

Documents are searched in shards of a few thousand. In a shard every term has its posting list in
the order of ids, and over the lists lies a sparse table that answers where the largest impact of
a stretch stands. An interval of documents can score no more than the sum of its terms' largest
impacts. The interval of the highest such bound is taken first; it is split at the document of its
largest single impact, which is scored, and both rests go back with bounds of their own. A short
interval is scored as a whole. The search of an item ends when no bound beats its k-th best; that
is carried from shard to shard of a task. The best of all tasks are ranked together in the end.

Items are taken in blocks whose terms are a stated number at most, each against all documents, so
what the executors are sent and the driver counts has a bound. A single item's terms must fit.

Defined cases: a null or empty text has no term, such a document is not counted and never found;
an item without terms finds nothing. Items with one id are one item with the terms of all of them.
Repeated documents are documents of their own. Ids are integers; a null id comes after all others.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldmart.llm import scratch
from coldmart.llm.hashing import batches_of

TERMS_AT_ONCE = 1 << 18  # of a block of items
SHARD = 1 << 13  # documents
POSTINGS = 1 << 20  # of a shard, unless one document has more
SHORT = 512  # postings of an interval that is scored as a whole

# Bytes of a term as they are, A-Z lower-cased, all other ASCII a blank.
_TERM_BYTES = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()

_LAST = np.iinfo(np.int64).max  # stands for a null id


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """Posting lists of some documents and the sparse table over them."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        """``ids`` in ascending order; a posting is a place among them, a term and an impact."""
        order = np.lexsort((docs, terms))
        self.ids, self.docs, self.impacts = ids, docs[order], impacts[order]
        terms = terms[order]
        self.terms, starts = np.unique(terms, return_index=True)
        self.ends = np.append(starts[1:], len(terms))
        self.starts = starts
        self.keys = terms * len(ids) + self.docs
        longest = int((self.ends - self.starts).max(initial=1))
        # Row j: where the largest impact of the 2**j postings from each on stands, the first of equals.
        self._table = [np.arange(len(terms), dtype=np.int32)]
        for j in range(longest.bit_length() - 1):
            low = self._table[-1]
            high = np.append(low[1 << j :], low[len(low) - (1 << j) :])[: len(low)]
            self._table.append(np.where(self.impacts[high] > self.impacts[low], high, low))
        self._entered = count()  # tells intervals of one bound apart
        self._table = np.stack(self._table)
        self._log = np.zeros(longest + 1, np.int64)
        for j in range(1, longest.bit_length()):
            self._log[1 << j :] = j

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the largest impact of each stretch ``a:b`` stands; none is empty."""
        j = self._log[b - a]
        left, right = self._table[j, a], self._table[j, b - (1 << j)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def search(self, terms: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Enter the documents of highest score into ``best``, a heap of (score, -id)."""
        at = np.flatnonzero(np.isin(self.terms, terms))
        if not len(at):
            return
        first = self.terms[at] * len(self.ids)  # the least key of each list
        queue: list[tuple] = []
        self._enter(queue, first, self.starts[at], self.ends[at], best, k)
        while queue:
            bound, _, first, a, b, top = heapq.heappop(queue)
            if not self._can_matter(-bound, a, best, k):
                continue
            if (b - a).sum() <= SHORT:
                self._score_all(a, b, best, k)
                continue
            doc = self.docs[top[self.impacts[top].argmax()]]
            middle = np.clip(np.searchsorted(self.keys, first + doc), a, b)
            met = middle < b
            met[met] = self.docs[middle[met]] == doc
            self._offer(int(self.impacts[middle[met]].sum()), int(self.ids[doc]), best, k)
            self._enter(queue, first, a, middle, best, k)
            self._enter(queue, first, middle + met, b, best, k)

    def _enter(self, queue, first, a, b, best, k) -> None:
        held = a < b
        if held.any():
            first, a, b = first[held], a[held], b[held]
            top = self.largest(a, b)
            bound = int(self.impacts[top].sum())
            if self._can_matter(bound, a, best, k):
                heapq.heappush(queue, (-bound, next(self._entered), first, a, b, top))

    def _can_matter(self, bound: int, a: np.ndarray, best: list[tuple[int, int]], k: int) -> bool:
        if bound <= 0 or len(best) < k:
            return bound > 0
        score, last = best[0]
        return bound > score or (bound == score and int(self.ids[self.docs[a].min()]) < -last)

    def _score_all(self, a: np.ndarray, b: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        lengths = b - a
        postings = np.arange(lengths.sum()) + np.repeat(a - (np.cumsum(lengths) - lengths), lengths)
        docs = self.docs[postings]
        lowest = docs.min()
        scores = np.zeros(docs.max() - lowest + 1, np.int64)
        np.add.at(scores, docs - lowest, self.impacts[postings])
        held = np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1))
        for doc in held[np.argsort(-scores[held], kind="stable")][:k].tolist():
            self._offer(int(scores[doc]), int(self.ids[lowest + doc]), best, k)

    @staticmethod
    def _offer(score: int, doc_id: int, best: list[tuple[int, int]], k: int) -> None:
        if score > 0:
            if len(best) < k:
                heapq.heappush(best, (score, -doc_id))
            else:
                heapq.heappushpop(best, (score, -doc_id))


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n: int, length: int) -> Iterator[Shard]:
    """Shards of the postings of ``batches``, with impacts by the corpus' ``n`` and ``length``."""

    def shard() -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = np.repeat(np.arange(len(ids)), table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        terms = table["terms"].combine_chunks().flatten().to_numpy().astype(np.int64)
        tf = table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 50 + (50 * table["n"].to_numpy() * n) // length
        impacts = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
        return Shard(ids[order], place[docs], terms, impacts)

    held: list[pa.RecordBatch] = []
    rows = postings = 0
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        at, before = 0, 0
        while at < batch.num_rows:
            end = min(at + SHARD - rows, int(np.searchsorted(ends, before + POSTINGS - postings, "right")))
            end = min(max(end, at if rows else at + 1), batch.num_rows)
            if end > at:
                held.append(batch.slice(at, end - at))
                rows, postings = rows + end - at, postings + int(ends[end - 1]) - before
                at, before = end, int(ends[end - 1])
            if at < batch.num_rows:
                yield shard()
                held, rows, postings = [], 0, 0
    if held:
        yield shard()


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` documents (``doc_id``, ``text``) that score highest for each of ``items``.

    Items have ``item_id`` and ``text``. Returns ``item_id``, ``rank``, ``doc_id`` and ``score``.
    A term's weight grows with its rarity, its share of a score falls off with repetition and with
    the length of the document; scores are whole numbers, equal ones go to the smaller id.
    """
    texts = items.select("item_id", F.col("text")).mapInArrow(_item_terms, "item_id long, term binary")
    texts = scratch.table(texts.distinct(), "lexical-items")
    blocks = -(-texts.count() // TERMS_AT_ONCE)
    found = []
    for block in range(blocks):
        chosen = texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found.append(scratch.table(_search_block(docs, chosen, k), "lexical-found"))
    if not found:
        nothing = "item_id long, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], nothing)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t) for i, text in zip(*map(pa.Array.to_pylist, batch.columns)) for t in set(terms_of(text))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            names=["item_id", "term"],
        )


def _search_block(docs: DataFrame, item_terms: DataFrame, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    terms_by_item: dict[int | None, list[bytes]] = {}
    for item, term in item_terms.collect():
        terms_by_item.setdefault(item, []).append(bytes(term))
    vocabulary = {t: j for j, t in enumerate(sorted({t for of in terms_by_item.values() for t in of}))}
    known = context.broadcast(vocabulary)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for batch in batches:
            for part in batches_of(batch, 1):
                ids, ns, terms, tfs, offsets = [], [], [], [], [0]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = terms_of(text.as_py())
                    if words:
                        counts = Counter(words)
                        met = sorted((wanted[t], counts[t]) for t in counts.keys() & wanted.keys())
                        ids.append(_LAST if doc_id is None else doc_id)
                        ns.append(len(words))
                        terms += [t for t, _ in met]
                        tfs += [tf for _, tf in met]
                        offsets.append(len(terms))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(ns, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tfs, pa.int64())),
                    ],
                    names=["id", "n", "terms", "tfs"],
                )

    given = docs.select(F.col("doc_id").cast("long"), "text")
    posted = given.mapInArrow(post, "id long, n long, terms array<int>, tfs array<long>")
    posted = scratch.table(posted, "lexical-postings")
    n, length = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
    # One count for each term of the block.
    counts = posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in counts:
        weights[term] = weight(n, df)
    wanted = context.broadcast(
        {item: np.array(sorted(vocabulary[t] for t in terms)) for item, terms in terms_by_item.items()}
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, list[tuple[int, int]]] = {item: [] for item in wanted.value}
        for shard in _shards(batches, weights, n, length):
            for item, terms in wanted.value.items():
                shard.search(terms, best[item], k)
        rows = [(item, -last, score) for item, of in best.items() for score, last in of]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([None if r[1] == _LAST else r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return posted.mapInArrow(look, "item_id long, doc_id long, score long")
