"""Encoding and decoding with a merge-type SentencePiece vocabulary.

A text becomes symbols, one a character; an agenda holds the pairs of neighbours that are pieces,
the best score first and the leftmost of equals. The best pair is joined, its new neighbours enter
the agenda, until it is empty. What is no piece falls back to the bytes of its UTF-8 form.

No piece holds a space mark after another character, or characters of two groups that no piece
links, so no pair ever spans the border between two such stretches: the agenda of a text falls
into those of its words, and a word met before is looked up. The vocabulary itself is asked for
these groups; where one holds marks inside pieces, a text is encoded as one word.

``encode_documents`` compares every batch with the sentencepiece library. Its rows come from the
agenda; ``agrees`` says whether the library gave the same ids and the same decoded text.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldmart.llm.hashing import batches_of

# Fixed values of the format: the mark that stands for a space, and the kinds of pieces.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

REMEMBERED = 1_000_000  # words a task keeps before it starts afresh
LONGEST_REMEMBERED = 64  # characters
GROUPS = 6  # of characters that are told apart as words are found
ROWS = 1 << 12  # words worked out at once
NEVER = np.iinfo(np.int32).max  # the rank of a pair that is no piece
WINDOW = 1 << 20  # characters worked on at a time


class Vocabulary:
    """Pieces, scores and settings, read from a model file with the library's own reader."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != trainer.BPE:
            raise ValueError("the vocabulary is not of the merge type")
        if kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("vocabularies with user-defined or unused pieces are not supported")
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces:
            raise ValueError("only vocabularies without text normalisation are supported")
        if not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies with byte fallback and leading space marks are supported")
        self.prefix = MARK if normalizer.add_dummy_prefix else ""
        self.mark = MARK if normalizer.escape_whitespaces else " "
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = [0] * 256
        for k, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = k
        self.controls = [k for k, kind in enumerate(self.kinds) if kind == CONTROL]
        self.end = [p.piece for p in proto.pieces].index(trainer.eos_piece)
        self.surfaces = [self._surface(p, trainer.unk_surface) for p in proto.pieces]
        self.by_words = all(self.mark not in piece.lstrip(self.mark) for piece in self.ids)
        groups = self._groups()
        self._number_pairs({c for group in groups for c in group})
        self.words = re.compile(self._words_of(groups) if self.by_words else "(?s:.+)")

    def _groups(self) -> list[list[str]]:
        """Characters, but for the mark, that longer pieces link as neighbours; the most pieces first."""
        leader: dict[str, str] = {}

        def lead(c: str) -> str:
            while leader.setdefault(c, c) != c:
                leader[c] = c = leader[leader[c]]
            return c

        for piece in self.ids:
            inner = piece.replace(self.mark, "")
            if len(piece) > 1 and inner:
                for c in inner:
                    leader[lead(c)] = lead(inner[0])
        held = Counter(lead(piece[-1]) for piece in self.ids if piece[-1] in leader)
        return [sorted(c for c in leader if lead(c) == first) for first, _ in held.most_common()]

    def _words_of(self, groups: list[list[str]]) -> str:
        """A pattern of stretches that no piece reaches out of.

        No piece spans two groups, so a word ends where its group does; small groups count as one.
        Characters of no group stay alone.
        """
        few = [[c for group in groups[GROUPS:] for c in group]]
        parts = ["[" + re.escape("".join(g)) + "]" for g in [*groups[:GROUPS], *few] if g]
        mark, inside = re.escape(self.mark), "|".join(f"{part}+" for part in parts)
        outside = f"[^{mark}" + "".join(part[1:-1] for part in parts) + "]+"
        return f"{mark}+(?:{inside})?|{inside}|{outside}" if parts else f"{mark}+|{outside}"

    def _number_pairs(self, joining: set[str]) -> None:
        """Symbols as numbers, and the pairs of them that make a piece, for many words at once."""
        symbols = [*self.ids, *sorted((joining | {self.mark}) - self.ids.keys())]
        number = {s: k for k, s in enumerate(symbols)}
        order = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = [
            (number[piece[:cut]] * len(symbols) + number[piece[cut:]], order[self.scores[piece]], number[piece])
            for piece in self.ids
            for cut in range(1, len(piece))
            if piece[:cut] in number and piece[cut:] in number
        ]
        keys, ranks, made = np.array(sorted(pairs), np.int64).reshape(-1, 3).T
        self.n_symbols = len(symbols)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ranks = np.append(ranks, NEVER).astype(np.int32)
        self.pair_makes = np.append(made, 0).astype(np.int32)
        self.ids_of_symbols = np.array([self.ids.get(s, -1) for s in symbols], np.int32)
        self.symbols_of_characters = np.arange(-2, -2 - 0x110000, -1, np.int32)
        for s, k in number.items():
            if len(s) == 1:
                self.symbols_of_characters[ord(s)] = k

    def _surface(self, piece, unknown: str) -> bytes:
        if piece.type == CONTROL:
            return b""
        if piece.type == UNKNOWN:
            return unknown.encode()
        if piece.type == BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        return piece.piece.replace(self.mark, " ").encode()


def agenda(text: str, vocabulary: Vocabulary) -> list[str]:
    """The pieces and single characters that remain of a text when no pair can be joined."""
    symbols, scores = list(text), vocabulary.scores
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    waiting = []
    for k in range(n - 1):
        joined = symbols[k] + symbols[k + 1]
        if joined in scores:
            waiting.append((-scores[joined], k, k + 1, joined))
    heapq.heapify(waiting)
    while waiting:
        _, left, right, joined = heapq.heappop(waiting)
        # A pair is stale when either side has grown or gone since it was entered.
        if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(joined):
            continue
        symbols[left], symbols[right] = joined, ""
        following = after[left] = after[right]
        if following >= 0:
            before[following] = left
            pair = joined + symbols[following]
            if pair in scores:
                heapq.heappush(waiting, (-scores[pair], left, following, pair))
        leading = before[left]
        if leading >= 0:
            pair = symbols[leading] + joined
            if pair in scores:
                heapq.heappush(waiting, (-scores[pair], leading, left, pair))
    return [s for s in symbols if s]


def agendas(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The agendas of many words at once: a row of symbols each, filled up with -1.

    A row's agenda is the ranks of its neighbouring pairs; each round joins the best pair of each
    row, the leftmost of equals, and asks anew for its two new pairs only.
    """

    def look_up(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * vocabulary.n_symbols + right, -1)
        at = np.searchsorted(vocabulary.pair_keys, keys)
        met = vocabulary.pair_keys[at] == keys
        return np.where(met, vocabulary.pair_ranks[at], NEVER), vocabulary.pair_makes[at]

    out = symbols.copy()
    width = symbols.shape[1]
    rows = np.arange(len(symbols))
    # One more column on both sides, so that the first and the last symbol have neighbours too.
    at = np.full((len(symbols), width + 2), -1, np.int32)
    at[:, 1:-1] = symbols
    ranks = look_up(at[:, :-1], at[:, 1:])[0]  # ranks[:, j]: of the pair in columns j and j + 1
    columns = np.arange(width + 2)
    while True:
        best = ranks.argmin(axis=1)
        busy = ranks[np.arange(len(ranks)), best] < NEVER
        if not busy.all():
            out[rows[~busy]] = at[~busy, 1:-1]
            rows, at, ranks, best = rows[busy], at[busy], ranks[busy], best[busy]
        if not len(rows):
            return out
        line = np.arange(len(rows))
        made = look_up(at[line, best], at[line, best + 1])[1]
        following = np.minimum(columns + (columns > best[:, None]), width + 1)
        at = np.take_along_axis(at, following, axis=1)
        ranks = np.take_along_axis(ranks, np.minimum(following[:, :-1], width), axis=1)
        at[line, best] = made
        ranks[line, best - 1] = look_up(at[line, best - 1], made)[0]
        ranks[line, best] = look_up(made, at[line, best + 1])[0]


class Codec:
    """Encodes and decodes texts with one vocabulary; remembers words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._vocabulary, self.prefix, self.end = vocabulary, vocabulary.prefix, vocabulary.end
        self._known: dict[str, bytes] = {}  # the ids of a word, four bytes each

    def windows(self, text: str | None) -> Iterator[str]:
        """A text in stretches of about ``WINDOW`` characters, each of which begins a word.

        Spaces are marks, and the text begins with the vocabulary's own mark, if it has one.
        """
        if not text:
            return
        marked = self._vocabulary.prefix + text.replace(" ", self._vocabulary.mark)
        mark, at = self._vocabulary.mark, 0
        while at < len(marked):
            end = at + WINDOW
            if self._vocabulary.by_words:
                # The next mark that follows another character: a word begins there.
                while True:
                    end = marked.find(mark, end)
                    if end < 0 or marked[end - 1] != mark:
                        break
                    end += 1
            # A mark alone at the end stays with the window before it.
            if end < 0 or end == len(marked) - 1 or not self._vocabulary.by_words:
                end = len(marked)
            yield marked[at:end]
            at = end

    def encode(self, windows: Sequence[str]) -> Iterator[array]:
        """Ids of each window, without end ids; words new to all of them are worked out together."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        known, words = self._known, [self._vocabulary.words.findall(w) for w in windows]
        new = set(chain.from_iterable(words)).difference(known)
        found = {w: self._long_word(w) for w in new if len(w) > LONGEST_REMEMBERED}
        new = sorted(new.difference(found), key=len)
        at = 0
        while at < len(new):
            # Words of up to one and a half times the shortest one's length make one table.
            end = min(bisect.bisect_right(new, len(new[at]) * 3 // 2, key=len), at + ROWS)
            known.update(zip(new[at:end], self._short_words(new[at:end])))
            at = end
        for of_window in words:
            ids = array("i")
            if found:
                ids.frombytes(b"".join(known[w] if w in known else found[w] for w in of_window))
            else:
                ids.frombytes(b"".join(map(known.__getitem__, of_window)))
            yield ids

    def _short_words(self, words: list[str]) -> list[bytes]:
        vocabulary, width = self._vocabulary, len(words[-1])
        padded = "".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le")
        characters = np.frombuffer(padded, np.uint32).reshape(len(words), width)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        inside = np.arange(width) < lengths[:, None]
        symbols = agendas(np.where(inside, vocabulary.symbols_of_characters[characters], -1), vocabulary)
        filled = symbols != -1
        ids = np.where(symbols >= 0, vocabulary.ids_of_symbols[np.maximum(symbols, 0)], -1)
        by_bytes = np.flatnonzero(((ids < 0) & filled).any(axis=1))
        ends = (4 * np.cumsum(filled.sum(axis=1))).tolist()
        flat = ids[filled].astype(np.int32).tobytes()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for k in by_bytes.tolist():
            out[k] = self._long_word(words[k])
        return out

    def _long_word(self, word: str) -> bytes:
        ids, of_bytes, out = self._vocabulary.ids, self._vocabulary.bytes, array("i")
        for symbol in agenda(word, self._vocabulary):
            found = ids.get(symbol)
            if found is None:
                out.extend(of_bytes[b] for b in symbol.encode())
            else:
                out.append(found)
        return out.tobytes()

    def decode(self, ids: Sequence[int], at_start: bool = True, own: bool = False) -> str:
        """The text of some ids; ``at_start`` if they begin a text, whose own mark is then dropped.

        ``own`` ids come from ``encode``, which gives no control piece. Bytes that are no UTF-8 show as one replacement character each.
        """
        vocabulary = self._vocabulary
        surfaces = vocabulary.surfaces
        try:
            text = b"".join(map(surfaces.__getitem__, ids)).decode()
            if any(i in ids for i in vocabulary.controls if not own):
                text = self._decode_by_runs(ids)  # a control piece ends a run of bytes
        except UnicodeDecodeError:
            text = self._decode_by_runs(ids)
        if at_start and vocabulary.prefix:
            shown = next((i for i in ids if vocabulary.kinds[i] != CONTROL), None)
            if shown is not None and vocabulary.kinds[shown] == NORMAL and surfaces[shown][:1] == b" ":
                return text[1:]
        return text

    def _decode_by_runs(self, ids: Sequence[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if self._vocabulary.kinds[i] == BYTE:
                run += self._vocabulary.surfaces[i]
            else:
                out += [_characters(bytes(run)), self._vocabulary.surfaces[i].decode()]
                run.clear()
        return "".join([*out, _characters(bytes(run))])


def _characters(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for width in (1, 2, 3, 4):
            try:
                out.append(run[at : at + width].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            width = 1
        at += width
    return "".join(out)


@functools.lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(Vocabulary(model))


@functools.lru_cache(maxsize=2)
def _library(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


# What ``encode_documents`` can return of a document.
OUTPUTS = {
    "ids": "array<int>",
    "decoded": "string",
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "agrees": "boolean",
}


def encode_documents(
    docs: DataFrame,
    model_path: str,
    key: str,
    text: str = "text",
    outputs: Sequence[str] = tuple(OUTPUTS),
) -> DataFrame:
    """Each document's ids with an end id, and the text those ids decode to.

    Returns ``key`` and ``outputs``: ``ids``, ``decoded``, the number of ids ``n_tokens``, digests
    of the ids (decimal, joined by spaces) and of the decoded text, and ``agrees``, the library's
    opinion of both. Asking for digests alone keeps ids and texts inside the task.

    A null text is an empty one and has the end id alone. Repeated rows give a row each, an empty
    table none; other columns are not read. Texts of any length are worked on in windows that
    begin words, so a task holds one Arrow batch and the ids of one text.
    """
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))
    wanted = list(outputs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, 1):
                columns = _encode_batch(part.column(1).to_pylist(), model.value, wanted)
                types = [schema.field(name).type for name in wanted]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(columns[n], t) for n, t in zip(wanted, types))],
                    names=["key", *wanted],
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    result = ", ".join([f"key {given.schema['key'].dataType.simpleString()}", *(f"{n} {OUTPUTS[n]}" for n in wanted)])
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], result).schema)
    return given.mapInArrow(encode, result).withColumnRenamed("key", key)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encode_batch(texts: list[str | None], model: bytes, wanted: Sequence[str]) -> dict[str, list]:
    own, library = codec(model), _library(model) if "agrees" in wanted else None
    texts = [text or "" for text in texts]
    columns: dict[str, list] = {name: [] for name in OUTPUTS}
    short = [text for text in texts if len(text) < WINDOW]
    together = own.encode([w for text in short for w in own.windows(text)])
    for text in texts:
        if len(text) < WINDOW:
            encoded = ((w, next(together)) for w in own.windows(text))
        else:
            encoded = ((w, *own.encode([w])) for w in own.windows(text))
        row = _of_text(text, encoded, own, library, wanted)
        for name in wanted:
            columns[name].append(row[name])
    return columns


def _of_text(text: str, encoded: Iterator, own: Codec, library, wanted: Sequence[str]) -> dict:
    of_ids, of_decoded = hashlib.sha256(), hashlib.sha256()
    all_ids, all_decoded, n_tokens, agrees = array("i"), [], 0, True
    for k, (window, packed) in enumerate(encoded):
        ids = packed.tolist()
        decoded = own.decode(ids, at_start=k == 0, own=True)
        if library and agrees:
            # The library puts its own mark before what it is given, so a later window goes without.
            theirs = library.encode(text if len(text) < WINDOW else window[len(own.prefix) :])
            agrees = theirs == ids and (k > 0 or library.decode(theirs) == decoded)
        if "ids_sha256" in wanted:
            of_ids.update(str(ids)[1:-1].replace(",", "").encode())
            of_ids.update(b" ")
        of_decoded.update(decoded.encode())
        n_tokens += len(ids)
        if "ids" in wanted:
            all_ids += packed
        if "decoded" in wanted:
            all_decoded.append(decoded)
    of_ids.update(str(own.end).encode())
    return {
        "ids": [*all_ids, own.end],
        "decoded": "".join(all_decoded),
        "n_tokens": n_tokens + 1,
        "ids_sha256": of_ids.hexdigest(),
        "decoded_sha256": of_decoded.hexdigest(),
        "agrees": agrees,
    }
