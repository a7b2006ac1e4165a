"""64-bit hashes of many words at once, with numpy, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 20  # symbols worked on at a time


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all others (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


_SYMBOLS = numbers(256, 1)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE)
        for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``symbols[start:end]`` of bytes; runs must not be empty."""
    up, down = _power_tables(len(symbols))
    sums = np.cumsum(_SYMBOLS[symbols] * up[: len(symbols)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix((sums[ends - 1] - before) * down[starts])


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, one after another, and where each begins and ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(n: int, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``SLICE`` that end at a break, so that no run is cut."""
    at = 0
    while at < n:
        if n - at <= SLICE:
            end = n
        else:
            k = int(np.searchsorted(breaks, at + SLICE, "right")) - 1
            end = int(breaks[k]) if k >= 0 and breaks[k] > at else -1
            if end < 0:
                end = int(breaks[k + 1]) if k + 1 < len(breaks) else n
        yield at, end
        at = end


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and how many words precede each text's first.

    Words are what stands between ASCII white space. Nulls have none.
    """
    data, offsets = utf8_of(texts)
    breaks = np.union1d(np.flatnonzero(_WHITE[data]), offsets)
    hashes, starts_all = [], []
    for a, b in slices(len(data), breaks):
        part = data[a:b]
        inside = ~_WHITE[part]
        fresh = np.ones(len(part), bool)
        fresh[1:] = ~inside[:-1]
        edges = offsets[(offsets >= a) & (offsets < b)] - a
        fresh[edges] = True
        starts = np.flatnonzero(inside & fresh)
        closes = np.zeros(len(part), bool)
        closes[:-1] = ~inside[1:]
        closes[-1] = True
        closes[edges[edges > 0] - 1] = True
        ends = np.flatnonzero(inside & closes) + 1
        if len(starts):
            hashes.append(run_hashes(_ASCII_LOWER[part], starts, ends))
            starts_all.append(starts + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


_PLACES = numbers(64, 2) | np.uint64(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word runs; of the whole, if it is shorter."""
    if not len(words):
        return words
    if len(words) < width:
        return mix(np.array([(words * _PLACES[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _PLACES[k]
    return np.unique(mix(total))


def batches_of(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of one text column, whole rows each."""
    lengths = np.diff(utf8_of(batch.column(column))[1])
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
