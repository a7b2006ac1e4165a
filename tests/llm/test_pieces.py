from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from coldmart.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as file:
    MODEL = file.read()
LIBRARY = SentencePieceProcessor(model_proto=MODEL)

PARTS = [
    "a", "e", "t", "h", " ", "  ", "▁", "\n", "\0", "é", "漢", "字", "😀", "́", "1", "<s>", "</s>",
    "<0x0A>", " ", "�", '"', "the", " the", "\t", "\r", " ⁇ ", "がが", "abc" * 30, " " * 40,
]


def encoded(texts):
    return pieces._encode_batch(texts, MODEL, list(pieces.OUTPUTS))


def check(texts):
    out = encoded(texts)
    for k, text in enumerate(texts):
        ids = LIBRARY.encode(text, add_eos=True)
        assert out["ids"][k] == ids, text
        assert out["decoded"][k] == LIBRARY.decode(ids), text
        assert out["n_tokens"][k] == len(ids)
        assert out["ids_sha256"][k] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert all(out["agrees"])


def test_mixed_parts_are_those_of_the_library():
    of = random.Random(3)
    check(["".join(of.choice(PARTS) for _ in range(of.randrange(25))) for _ in range(4000)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text_is_that_of_the_library(texts):
    check(texts)


def test_windows_change_nothing(monkeypatch):
    of = random.Random(4)
    texts = ["".join(of.choice(PARTS) for _ in range(of.randrange(60))) for _ in range(300)]
    whole = encoded(texts)
    monkeypatch.setattr(pieces, "WINDOW", 17)
    assert encoded(texts) == whole


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(29871, 29990)), max_size=8))
def test_any_ids_decode_as_with_the_library(ids):
    assert pieces.codec(MODEL).decode(ids) == LIBRARY.decode(ids)


def test_both_agendas_are_one():
    vocabulary = pieces.codec(MODEL)._vocabulary
    of = random.Random(5)
    words = ["".join(of.choice("▁aehinrté漢") for _ in range(of.randrange(1, 20))) for _ in range(500)]
    codec = pieces.Codec(vocabulary)
    words.sort(key=len)
    assert codec._short_words(words) == [codec._long_word(w) for w in words]


def test_one_very_long_word_and_text():
    check(["ab" * 100_000, "the end " * 400_000])


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    pieces.codec.cache_clear()
    for text in ("one two three four five", "six seven one", "two " * 5):
        check([text])


def test_other_vocabularies_are_refused():
    proto = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    with pytest.raises(ValueError, match="merge type"):
        pieces.Vocabulary(proto.SerializeToString())
    proto = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    proto.pieces[300].type = 4
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Vocabulary(proto.SerializeToString())


def test_rows_of_a_table(spark):
    rows = [(1, "the cat", 7), (1, "the cat", 7), (None, None, 0), (2, "", 1), (3, "x\ny", None)]
    docs = spark.createDataFrame(rows, "key long, text string, ids int")
    out = pieces.encode_documents(docs, PATH, "key").collect()
    assert sorted((r["key"] or 0, r["decoded"], r["n_tokens"]) for r in out) == [
        (0, "", 1), (1, "the cat", 3), (1, "the cat", 3), (2, "", 1), (3, "x\ny", 4)
    ]
    assert all(r["agrees"] for r in out)
    assert pieces.encode_documents(docs.limit(0), PATH, "key", outputs=["n_tokens"]).collect() == []
    assert pieces.encode_documents(docs, PATH, "key", outputs=["ids"]).columns == ["key", "ids"]
