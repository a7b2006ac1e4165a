"""Token ids of many texts at once, for a tokenizer that splits texts into words first.

Ids are those of ``tokenizers``. As words of that tokenizer are encoded one by one, each distinct
word of a batch is looked up once and encoded only when it is new; words are found with numpy
over one-byte characters. Texts that do not fit (characters beyond Latin-1, strings of special
tokens) and tokenizers of another make are encoded by the library itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np

from coldmart.llm.hashing import run_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The make of tokenizer for which words are found here.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
_KIND[[c for c in range(256) if chr(c).isalpha()]] = _LETTER
_KIND[[c for c in range(256) if chr(c).isnumeric()]] = _NUMBER

REMEMBERED = 1_000_000  # distinct words a task keeps before it starts afresh
BATCH = 1 << 20  # characters


class WordBpe:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            make = json.load(file)
        normalizers = [n["type"] for n in (make["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern") for p in (make["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self._by_words = normalizers == _NORMALIZERS and splits[:1] == [{"Regex": _PATTERN}]
        self._special = [t["content"] for t in make["added_tokens"]]
        self._tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._ends = np.zeros(1 << 16, np.int64)  # ids of word k: _ends[k] to _ends[k + 1]

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end] or "") <= BATCH):
                size += len(texts[end] or "")
                end += 1
            yield from self._encode([t or "" for t in texts[at:end]])
            at = end

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        fit, plain = [], []
        for k, text in enumerate(texts):
            try:
                if not self._by_words or any(s in text for s in self._special):
                    raise UnicodeError
                plain.append(text.lower().encode("latin-1"))
                fit.append(k)
            except UnicodeError:
                out[k] = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if fit:
            for k, ids in zip(fit, self._by_word(plain)):
                out[k] = ids
        return out

    def _by_word(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"\n".join(texts)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts, ends = word_bounds(np.frombuffer(joined, np.uint8))
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        hashes = run_hashes(np.frombuffer(joined, np.uint8), starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        places = self._places(words)[which]
        lengths = self._ends[places + 1] - self._ends[places]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(upto[-1]) + np.repeat(self._ends[places] - upto[:-1], lengths)
        ids = self._ids[source]
        cuts = upto[np.searchsorted(starts, begins)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _places(self, words: list[bytes]) -> np.ndarray:
        if len(self._known) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self._known]
        if new:
            encoded = self._tokenizer.encode_batch_fast(
                [w.decode("latin-1") for w in new], add_special_tokens=False
            )
            n, filled = len(self._known), int(self._ends[len(self._known)])
            ids = np.array([i for e in encoded for i in e.ids], np.uint32)
            while len(self._ids) < filled + len(ids):
                self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            while len(self._ends) < n + len(new) + 1:
                self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
            self._ids[filled : filled + len(ids)] = ids
            self._ends[n + 1 : n + len(new) + 1] = filled + np.cumsum([len(e.ids) for e in encoded])
            self._known.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of Latin-1 characters (lower case) begin and end."""
    n = len(text)
    kind = np.zeros(n + 3, np.uint8)  # white space beyond the end
    kind[:n] = _KIND[text]
    fresh = np.ones(n + 3, bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    # 's 't 'm 'd 're 've 'll are words where an apostrophe begins one.
    marks = np.flatnonzero((text == ord("'")) & fresh[:n])
    if len(marks):
        ahead = np.concatenate([text, np.zeros(3, np.uint8)])
        one, two = ahead[marks + 1], ahead[marks + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        long |= (one == ord("l")) & (two == ord("l"))
        for met, width in ((short, 2), (long, 3)):
            at = marks[met]
            fresh[at + 1] = False
            fresh[at + width] |= kind[at + width] == _LETTER
    inside = kind != _SPACE
    starts = np.flatnonzero(inside & fresh)
    last = inside[:-1] & (~inside[1:] | fresh[1:])
    return starts, np.flatnonzero(last) + 1
