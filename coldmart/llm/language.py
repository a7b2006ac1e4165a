"""Language identification with spans, for texts that may mix languages.

A word's evidence is the sum over its letters of the log probabilities of letter trigrams (the
word's ends count as letters), one table a language. Script ranges narrow the candidates first: a
language takes part in a word only if it uses the word's script. A Viterbi path over the words
with a fixed penalty for each change of language then labels spans; a text whose best path
provably never changes is answered without walking it. The text's language is the one with most
letters, and its score the share of letters on that language's spans.

The model is fitted by Spark on at most about ``TRAIN_DOCS`` labelled documents (a documented
bound: the model is ``BUCKETS`` numbers a language, which more text hardly changes). They are dealt
out by label: a label is taken whole up to its share and by a rate of its own beyond, so a rare
language is learned whatever the size of the others. Which documents of a label, a hash of id and
text says, so copies of one text do not share one fate; a document delivered twice counts once. Trigram and script counts are summed before they reach
the driver. Prediction uses the text alone, all of it.

Defined cases: null texts and texts without letters are ``und`` with score 0; a text of which no
learned language uses any script gets the most frequent learned language with score 0; of equally
likely languages the first by name; without any labelled document everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.llm.hashing import batches_of

TRAIN_DOCS = 20_000
FEW_LABELS = 10_000  # whose rates are broadcast; more are joined
LEAST_DOCS = 100  # the share of a label, however many labels there are
BUCKETS = 1 << 18
PENALTY = 12.0  # in nats, for each change of language
WORST = 8.0  # how much one word can speak against a language
RARE_SCRIPT = 0.01  # share of its letters from which on a language uses a script
UNKNOWN = "und"

# Blocks of the Unicode standard, by script (0: any other).
SCRIPTS = [
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x2C60, 0x2C7F, 1), (0xA720, 0xA7FF, 1), (0xFF21, 0xFF5A, 1),
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2),
    (0x0400, 0x052F, 3), (0x1C80, 0x1C8F, 3), (0x2DE0, 0x2DFF, 3), (0xA640, 0xA69F, 3),
    (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5), (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6), (0x08A0, 0x08FF, 6),
    (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0A00, 0x0A7F, 9), (0x0A80, 0x0AFF, 10), (0x0B80, 0x0BFF, 11),
    (0x0C00, 0x0C7F, 12), (0x0C80, 0x0CFF, 13), (0x0D00, 0x0D7F, 14), (0x0E00, 0x0E7F, 15), (0x0E80, 0x0EFF, 16),
    (0x1000, 0x109F, 17), (0x10A0, 0x10FF, 18), (0x1100, 0x11FF, 19), (0xAC00, 0xD7AF, 19), (0x1200, 0x137F, 20),
    (0x1780, 0x17FF, 21), (0x3040, 0x309F, 22), (0x30A0, 0x30FF, 23), (0x31F0, 0x31FF, 23),
    (0x3400, 0x4DBF, 24), (0x4E00, 0x9FFF, 24), (0xF900, 0xFAFF, 24), (0x20000, 0x323AF, 24),
]
N_SCRIPTS = 25

_FINE = 10**12  # steps of a rate

_tables: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """255 for what is no letter, else the letter's script, by code point."""
    if not _tables:
        kinds = np.full(0x110000, 255, np.uint8)
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        kinds[letters] = 0
        for low, high, script in SCRIPTS:
            part = kinds[low : high + 1]
            part[part == 0] = script
        _tables.append(kinds)
    return _tables[0]


@dataclass
class Words:
    """The words of several texts: trigram buckets of all letters, and where words begin."""

    buckets: np.ndarray
    starts: np.ndarray  # first letter of each word, counted in letters
    scripts: np.ndarray  # of each word's first letter
    texts: np.ndarray  # the first word of each text, and their number

    @staticmethod
    def of(texts: list[str | None]) -> Words:
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        kinds = _kinds()[points]
        letter = kinds != 255
        framed = np.zeros(len(points) + 2, np.uint32)
        framed[1:-1] = np.where(letter, points, 0)
        at = np.flatnonzero(letter)
        mixed = (
            framed[at] * np.uint32(0x9E3779B1)
            + framed[at + 1] * np.uint32(0x85EBCA77)
            + framed[at + 2] * np.uint32(0xC2B2AE3D)
        )
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        first = framed[at] == 0
        return Words(
            (mixed >> np.uint32(14)).astype(np.int32),
            np.flatnonzero(first),
            kinds[at[first]],
            np.searchsorted(at[first], begins),
        )

    def letters(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.buckets)))


def _share(counts: list[int], most: int) -> float:
    """The level to which counts must be cut so that they sum up to ``most``."""
    left = float(most)
    for k, n in enumerate(sorted(counts)):
        level = left / (len(counts) - k)
        if n > level:
            return level
        left -= n
    return float(max(counts, default=0))


def training_rows(
    docs: DataFrame, label: str, text: str, most: int = TRAIN_DOCS, doc_id: str = "doc_id"
) -> tuple[DataFrame, dict[str, float]]:
    """``label, text`` of the documents to learn from, and the rate at which each label is taken."""
    labelled = docs.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("label"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("chance"),
    )
    counted = labelled.select("label", "chance").distinct().groupBy("label").count()
    counts = {r["label"]: r["count"] for r in counted.collect()}  # a row a language, as the model has
    share = max(_share(list(counts.values()), most), LEAST_DOCS)
    rates = {name: min(1.0, share / n) for name, n in counts.items()}
    if any(rate < 1 for rate in rates.values()):
        parts = labelled.sparkSession.createDataFrame(
            [(name, int(_FINE * rate)) for name, rate in rates.items()], "label string, part bigint"
        )
        # The rates are on the driver already; texts stay where they are until the few are chosen.
        parts = F.broadcast(parts) if len(rates) <= FEW_LABELS else parts
        labelled = labelled.join(parts, "label").filter(F.pmod("chance", F.lit(_FINE)) < F.col("part"))
    return labelled.dropDuplicates(["label", "chance"]).select("label", "text"), rates


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, log probabilities
    uses: np.ndarray  # N_SCRIPTS x languages
    usual: int  # the most frequent language

    @staticmethod
    def fit(docs: DataFrame, label: str, text: str, most: int = TRAIN_DOCS, doc_id: str = "doc_id") -> Model:
        """Fit on rows with a label; about ``most`` of them if there are more, dealt out by label."""
        labelled, rates = training_rows(docs, label, text, most, doc_id)

        def count(batches) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for whole in batches:
                for batch in batches_of(whole, 1):
                    names = np.array(batch.column(0).to_pylist(), object)
                    texts = batch.column(1).to_pylist()
                    for name in set(names.tolist()):
                        words = Words.of([t for t, m in zip(texts, names == name) if m])
                        sums = total.setdefault(name, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                        sums[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                        sums[BUCKETS:] += np.bincount(words.scripts, minlength=N_SCRIPTS)
            for name, sums in total.items():
                met = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(met), pa.string()), pa.array(met), pa.array(sums[met])],
                    ["label", "bucket", "n"],
                )

        counts = (
            labelled.mapInArrow(count, "label string, bucket bigint, n bigint")
            .groupBy("label", "bucket")
            .agg(F.sum("n").alias("n"))
            .toArrow()
        )  # at most BUCKETS + N_SCRIPTS rows a language
        languages = sorted(set(counts.column("label").to_pylist()))
        sums = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
        column = {name: k for k, name in enumerate(languages)}
        where = [column[x] for x in counts.column("label").to_pylist()]
        sums[counts.column("bucket").to_numpy(), where] = counts.column("n").to_numpy()
        letters, scripts = sums[:BUCKETS], sums[BUCKETS:]
        smoothed = letters + 0.05
        table = np.log(smoothed / smoothed.sum(axis=0)) if languages else smoothed
        used = scripts / np.maximum(scripts.sum(axis=0), 1)
        weights = np.array([rates[name] for name in languages])  # letters of all documents, not of those taken
        usual = int((letters.sum(axis=0) / weights).argmax()) if languages else 0
        return Model(languages, table.astype(np.float32), used >= RARE_SCRIPT, usual)

    def evidence(self, words: Words) -> np.ndarray:
        """Words x languages: log probabilities below the best's, down to ``-WORST``."""
        sums = np.add.reduceat(self.table[words.buckets], words.starts, axis=0)
        uses = self.uses[words.scripts]
        sums[~uses] = -np.inf
        sums[~uses.any(axis=1)] = 0.0
        return np.maximum(sums - sums.max(axis=1, keepdims=True), -WORST).astype(np.float64)


def path(evidence: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path, where each change costs ``penalty``.

    Staying is preferred where a change gains nothing, and the first language where two are equal.
    """
    total = evidence.sum(axis=0)
    best = int(total.argmax())
    if evidence.shape[1] == 1:
        return np.zeros(len(evidence), np.int64)
    # What any excursion to other languages could gain at most: the best stretch of gains.
    others = np.delete(evidence, best, axis=1).max(axis=1) - evidence[:, best]
    sums = np.concatenate([[0.0], np.cumsum(others)])
    if (sums - np.minimum.accumulate(sums)).max() <= penalty:
        return np.full(len(evidence), best)
    values, back = [0.0] * evidence.shape[1], []
    for row in evidence.tolist():
        top = max(values)
        source, floor = values.index(top), top - penalty
        back.append([k if v >= floor else source for k, v in enumerate(values)])
        values = [r + (v if v >= floor else floor) for r, v in zip(row, values)]
    out = np.empty(len(evidence), np.int64)
    state = values.index(max(values))
    for k in range(len(back) - 1, -1, -1):
        out[k] = state
        state = back[k][state]
    return out


def label_texts(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float, list[dict], float]]:
    """Language, score, spans (first word, words, language) and unlearned share of each text.

    The last is the share of its letters in words whose script no learned language uses.
    """
    words = Words.of(texts)
    if not len(words.starts) or not model.languages:
        yield from ((UNKNOWN, 0.0, [], float(a < b)) for a, b in zip(words.texts[:-1], words.texts[1:]))
        return
    evidence, letters = model.evidence(words), words.letters()
    known = model.uses[words.scripts].any(axis=1)
    for a, b in zip(words.texts[:-1], words.texts[1:]):
        if a == b:
            yield UNKNOWN, 0.0, [], 0.0
            continue
        along = path(evidence[a:b])
        weight = np.bincount(along, letters[a:b] * known[a:b], len(model.languages))
        if not weight.any():
            yield model.languages[model.usual], 0.0, [], 1.0
            continue
        top = int(weight.argmax())
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(along)) + 1, [b - a]])
        spans = [
            {"word": int(i), "words": int(j - i), "lang": model.languages[along[i]]}
            for i, j in zip(cuts[:-1], cuts[1:])
        ]
        total = letters[a:b].sum()
        unlearned = float((letters[a:b] * ~known[a:b]).sum() / total)
        yield model.languages[top], float(weight[top] / total), spans, unlearned


def identify(docs: DataFrame, model: Model, key: Column, text: str = "text") -> DataFrame:
    """``key, lang_pred, score, spans, unlearned`` for every row; ``key`` is any column that tells rows apart."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a megabyte a language, whatever the input

    def label(batches):
        for whole in batches:
            for batch in batches_of(whole, 1):
                found = list(label_texts(shared.value, batch.column(1).to_pylist()))
                kind = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([f[0] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], kind),
                        pa.array([f[3] for f in found], pa.float64()),
                    ],
                    ["key", "lang_pred", "score", "spans", "unlearned"],
                )

    keyed = docs.select(key.alias("key"), F.col(text).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.mapInArrow(
        label,
        f"key {kind}, lang_pred string, score double,"
        " spans array<struct<word: bigint, words: bigint, lang: string>>, unlearned double",
    )
