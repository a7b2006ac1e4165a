"""Line dedup, license scan, language, chat formatting, packing and mixing on small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coldmart.llm import chat, language, licenses, line_dedup, mixing, packing, word_bpe
from coldmart.llm.template import TemplateError, compile_template, fold, parse

DATA = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, more="", **columns):
    rows = [
        (k, t, columns.get("lang", ["en"] * 999)[k], columns.get("source", ["s"] * 999)[k], None)
        for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    """Columns that the operators use as names of their own."""
    names = ["id", "row", "version", "key", "node", "size", "chance", "region", "position", "label", "piece"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


ODD = ["", None, "\n\n", "  \t", "Same line\nonly here", " SAME LINE \x0b\nÉcole", "x" * 50_000, "a\r\nb"]


# ---------------------------------------------------------------------- line dedup


def plain_line_dedup(texts, least, shortest=1):
    def key(line):
        return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)

    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < shortest or seen[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup_agrees_with_a_plain_version(spark, least):
    texts = [*ODD, "Same line\n\nsame line", "É\né\nécole", None, ""]
    got = line_dedup.drop_common_lines(clashing(docs_of(spark, texts)), min_docs=least)
    rows = got.select("row.doc_id", "n_lines", "n_dropped", "kept_text").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == plain_line_dedup(texts, least)


def test_line_dedup_on_the_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = line_dedup.drop_common_lines(docs, 10).orderBy("row.doc_id")
    assert [tuple(r) for r in got.select("n_lines", "n_dropped", "kept_text").collect()] == plain_line_dedup(texts, 10)


def test_line_dedup_of_equal_rows_and_of_nothing(spark):
    one = docs_of(spark, ["a\nb"])
    twice = line_dedup.drop_common_lines(one.union(one), min_docs=2).collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in twice] == [(2, 2, "")] * 2
    assert line_dedup.drop_common_lines(one.limit(0)).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    lines = [f"own {k}" if k % 2 else f"shared {k}" for k in range(200_000)]
    texts = ["\n".join(lines), "\n".join(lines[::2]), "\n".join(lines[1::2][:5] + ["end"])]
    got = line_dedup.drop_common_lines(docs_of(spark, texts), min_docs=2, distinct_ids=True)
    rows = got.orderBy("row.doc_id").collect()
    assert [(r.n_lines, r.n_dropped) for r in rows] == [(200_000, 100_005), (100_000, 100_000), (6, 5)]
    assert [r.kept_text for r in rows] == ["\n".join(lines[1::2][5:]), "", "end"]


def test_line_dedup_counts_a_document_delivered_often_once(spark):
    import corpus_pipeline

    often = docs_of(spark, ["a\nb"] * 12).withColumn("doc_id", F.lit(1).cast("bigint"))
    shared = docs_of(spark, [f"common\nown {k}" for k in range(10)]).withColumn("doc_id", F.col("doc_id") + 2)
    nameless = docs_of(spark, [f"said\nby {k}" for k in range(10)]).withColumn("doc_id", F.lit(None).cast("bigint"))
    out = corpus_pipeline.line_dedup_stage(spark, often.union(shared).union(nameless), "")
    kept = [r.text for r in out.collect()]
    want = ["a\nb"] * 12 + [f"own {k}" for k in range(10)] + [f"by {k}" for k in range(10)]
    assert sorted(kept) == sorted(want)


# -------------------------------------------------------------------- license scan


def plain_scan(text):
    tokens = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(tokens)) if tokens[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    step = max(len(t.split()) for v in licenses.TEMPLATES.values() for t, _ in v)
    labels, share = set(base), 0.0
    for at in range(0, max(len(tokens) - 1 - step, 0) + 1, step):
        block = tokens[at : at + 2 * step]
        held = set(block)
        for label, wordings in licenses.TEMPLATES.items():
            for wording, telling in wordings:
                whole, row = set(wording.split()), telling.split()
                least = len(whole) if len(whole) < 10 else licenses.THRESHOLD * len(whole) - 1e-9
                stands = any(block[i : i + len(row)] == row for i in range(len(block)))
                if stands and len(whole & held) >= least:
                    labels.add(label)
                    share = max(share, len(whole & held) / len(whole))
    return (
        len(tokens), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else share,
    )


def test_license_scan_agrees_with_a_plain_version(spark):
    filler = "lorem ipsum " * 70
    texts = [
        *ODD,
        "Released under the MIT License. under the mit license under the MIT-license",
        filler + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        "\nand associated documentation files, to deal in the software with no restriction" + filler,
        "This work is licensed under the GNU General Public License, version 3.",
        "CC BY-NC, cc by nc cc by nc",
        "license the under mit",
        filler + "Licensed under the Apache License, Version 2.0.",
    ]
    got = licenses.scan(clashing(docs_of(spark, texts))).orderBy("id").drop("id", "blocks").collect()
    assert [tuple(r) for r in got] == [plain_scan(t) for t in texts]
    assert "mit" in got[len(ODD) + 1].labels and got[len(ODD) + 1].base_labels == ""
    assert licenses.scan(docs_of(spark, ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs_of(spark, ["a"]), phrases={" ": "none"})


@pytest.mark.parametrize("form", ["Licensed under CC BY{} 4.0.", "Licensed under a Creative Commons Attribution{} 4.0 International License"])
def test_creative_commons_licenses_are_told_apart(spark, form):
    short = {"cc-by": "", "cc-by-sa": "-SA", "cc-by-nc": "-NC", "cc-by-nd": "-ND"}
    long = {"cc-by": "", "cc-by-sa": "-ShareAlike", "cc-by-nc": "-NonCommercial", "cc-by-nd": "-NoDerivatives"}
    more = short if "CC BY" in form else long
    filler = "by 4 0 nc sa nd and others " * 30
    texts = [form.format(m) for m in more.values()] + [filler + form.format(m) + " " + filler for m in more.values()]
    got = licenses.scan(docs_of(spark, texts)).orderBy("id").collect()
    assert [r.labels for r in got] == [*more, *more]
    assert all(r.score == 1.0 for r in got)
    both = licenses.scan(docs_of(spark, [" ".join(form.format(m) for m in more.values())])).first()
    assert both.labels == ",".join(sorted(more))


# ------------------------------------------------------------------------ language


def best_path(evidence, penalty):
    """Every path tried."""
    import itertools

    n, k = evidence.shape
    paths = itertools.product(range(k), repeat=n)
    return max(
        sum(evidence[i, s] for i, s in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
        for p in paths
    )


def test_the_path_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for _ in range(60):
        evidence = -rng.exponential(3, (rng.integers(1, 8), 3))
        penalty = float(rng.choice([0.5, 2.0, 6.0]))
        p = language.path(evidence, penalty)
        value = evidence[np.arange(len(p)), p].sum() - penalty * (np.diff(p) != 0).sum()
        assert value == pytest.approx(best_path(evidence, penalty))


def test_language_of_held_out_documents_and_of_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.Model.fit(docs.filter(~held), "lang", "text")
    found = language.identify(docs.filter(held), model, F.col("doc_id")).join(
        docs.select(F.col("doc_id").alias("key"), "lang"), "key"
    )
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.99

    texts = {r.lang: r.text for r in docs.filter("length(text) between 300 and 600").collect()}
    mixed = texts["en"] + "\n" + texts["de"]
    found = language.identify(docs_of(spark, [mixed, None, "", "12 !?", "Привет мир"]), model, F.col("doc_id"))
    rows = found.orderBy("key").collect()
    assert {s.lang for s in rows[0].spans} == {"en", "de"} and len(rows[0].spans) <= 4
    assert 0.3 < rows[0].score < 0.8
    assert sum(s.words for s in rows[0].spans) == len(re.findall(r"[^\W\d_]+", mixed))
    assert [(r.lang_pred, r.score) for r in rows[1:4]] == [("und", 0.0)] * 3
    assert rows[4].lang_pred == "en" and rows[4].score == 0.0


def test_language_without_labels_or_rows(spark):
    docs = docs_of(spark, ["some words", None], lang=[None, None])
    model = language.Model.fit(docs, "lang", "text")
    found = language.identify(clashing(docs), model, F.col("doc_id")).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * 2
    assert language.identify(docs.limit(0), model, F.col("doc_id")).count() == 0


def test_scripts_narrow_the_candidates(spark):
    russian, english = "привет мир это просто слова", "hello world these are just words"
    docs = docs_of(spark, [russian, english], lang=["ru", "en"])
    model = language.Model.fit(docs, "lang", "text")
    found = language.identify(docs_of(spark, ["слово мир hello", "words"]), model, F.col("doc_id"))
    assert [r.lang_pred for r in found.orderBy("key").collect()] == ["ru", "en"]


def test_rare_labels_are_learned_and_copies_do_not_share_one_fate(spark):
    english = [f"these are some plain english words number {'abcdefghij'[k % 10]}" for k in range(3000)]
    texts = ["one text that was copied"] * 900 + english + ["ქართული ენა სიტყვები"] * 4
    rows = [(k, t, "ka" if k >= 3900 else "en") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.Model.fit(docs, "lang", "text", most=300)
    assert model.languages == ["en", "ka"] and model.languages[model.usual] == "en"
    found = language.identify(docs.filter("doc_id >= 3900"), model, F.col("doc_id")).collect()
    assert [(r.lang_pred, r.score, r.unlearned) for r in found] == [("ka", 1.0, 0.0)] * 4
    taken, rates = language.training_rows(docs.union(docs), "lang", "text", most=300)
    assert rates["ka"] == 1 and rates["en"] == 296 / 3900
    copies = taken.filter("text LIKE 'one text%'").count()
    assert 20 < copies < 140 and 200 < taken.count() < 400


def test_the_pipeline_keeps_scripts_that_nothing_was_learned_of(spark):
    import corpus_pipeline

    texts = ["some english words", "ქართული ენა სიტყვები", "12 34", None]
    docs = docs_of(spark, texts, lang=["en", None, "en", None])
    kept = corpus_pipeline.language_id(spark, docs, "").orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang) for r in kept] == [(0, "en"), (1, "und")]


# ----------------------------------------------------------------- chat formatting


def test_templates_fold_and_render():
    source = (
        "{% if true and x == 'a' %}A{% elif false %}never{% else %}{{ 'b' + 'c' }}{% endif %}"
        "{% for i in list %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}"
        "{% generation %}{{ m['k'].j | upper }}{% endgeneration %}"
    )
    render = compile_template(source, chat.FILTERS)
    text, spans = render({"x": "z", "list": [1, 2], "m": {"k": {"j": "q"}}})
    assert (text, spans) == ("bc1,2Q", [(5, 6)])
    assert "never" not in repr(fold(parse(source, chat.FILTERS), chat.FILTERS))


@pytest.mark.parametrize(
    "source",
    ["{{ a.__class__() }}", "{% for %}{% endfor %}", "{% if a %}", "{{ a | nothing }}", "{{ 'a' + }}", "{% end %}"],
)
def test_templates_refuse_what_they_do_not_know(source):
    with pytest.raises(TemplateError):
        compile_template(source, chat.FILTERS)


def test_templates_reach_no_attributes():
    assert compile_template("{{ a.__class__ }}", {})({"a": "text"}) == ("", [])


def test_conversations_come_back_as_they_were(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "assistant", "<turn user>\n\\"),
        (2, 1, "assistant", None), (2, 0, None, "é\n𝕏"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"),
        (None, None, "system", "<>"),
    ]
    table = clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    formatted = chat.format_conversations(table)
    got = {r.id: r for r in chat.digests(formatted).collect()}
    texts = {r.id: r for r in formatted.collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    for conv, turns in by.items():
        turns = [t[1:] for t in sorted(turns)]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        assert chat.read_back(texts[conv].formatted) == turns
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turns), len(learned))
        assert got[conv].formatted_chars == len(texts[conv].formatted)
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


# ------------------------------------------------------------------------- packing


def test_words_are_encoded_as_the_library_does():
    library, own = Tokenizer.from_file(TOKENIZER), word_bpe.WordBpe(TOKENIZER)
    every = "".join(map(chr, range(256)))
    texts = [
        every, "It's we'll they've .'s ''s 's's 'sam I'm 'd've x'T 'RE 'll' '", "", None, "<|endoftext|> a",
        "naïve Über ÉCOLE ß", "Привет 你好 e\u0301", "½²3 45a6", "a\x1cb\x85c\xa0d", "\ud7ff", "Å K İ",
    ]
    texts += [chr(a) + chr(b) + "e" for a in (39, 46, 97, 49, 32, 0xE9) for b in range(256)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(5)
    for capacity in (10, 64, 100):
        sizes = rng.integers(1, capacity + 1, 300)
        window, offset = packing.best_fit_decreasing(sizes, capacity)
        rooms: dict[int, int] = {}
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):  # the same order: sorted is stable
            able = [r for r in rooms.values() if r >= sizes[k]]
            if able:
                assert rooms[window[k]] == min(able)
            else:
                assert window[k] not in rooms
            room = rooms.get(window[k], capacity)
            assert offset[k] == capacity - room
            rooms[window[k]] = room - sizes[k]


def test_packing_holds_every_id_once(spark):
    long = "word and other words " * 3000
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, long), (-4, long), (-4, long), (None, "x")], given.schema)
    docs = clashing(given.union(more))
    rows = packing.pack(docs, TOKENIZER, window=4096).collect()
    library = Tokenizer.from_file(TOKENIZER)
    left = defaultdict(list)
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            piece = np.array(ids[at : at + 4096], "<u4")
            left[r.doc_id].append((at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    got, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in left.items()}
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    filled = sum(r.length for r in rows)
    assert filled / (4096 * len(windows)) > 0.95
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


# -------------------------------------------------------------------------- mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(most * sizes[s] for s in names if s not in free)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: share[s] if s in free else float(most * sizes[s]) for s in names}
        free -= above


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(9)
    sources = ["b", "a", None, "é", "Z", "empty"]
    texts, of = [], []
    for k, n in enumerate([400, 60, 30, 5, 1]):
        for _ in range(n):
            texts.append(" ".join(["w"] * int(rng.integers(0, 40))))
            of.append(sources[k])
    texts += [None, ""]
    of += ["empty", "empty"]
    docs = spark.createDataFrame(
        [(k, t, None, s, 0) for k, (t, s) in enumerate(zip(texts, of))], DOC
    )
    rows = mixing.shares(clashing(docs)).collect()
    sizes = Counter()
    for s, t in zip(of, texts):
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken, largest = Counter(), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        s = of[r.id]
        assert r.size == len((texts[r.id] or "").split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.shares(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    mixed = mixing.mix(clashing(docs))
    assert mixed.columns == clashing(docs).columns
    assert mixed.groupBy("doc_id").count().count() == sum(r.taken > 0 for r in rows)
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)


def test_mixing_of_copies_ties_and_nothing(spark):
    docs = spark.createDataFrame([(None, "same words", None, "s", 0)] * 5 + [(1, "a b", None, "t", 0)], DOC)
    rows = mixing.shares(docs).collect()
    assert len({r.taken for r in rows if r.source_size == 10}) == 1
    assert mixing.shares(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    few = mixing.FEW_SOURCES
    mixing.FEW_SOURCES = 0  # the other way of joining
    try:
        assert sorted(map(str, mixing.shares(docs).collect())) == sorted(map(str, rows))
    finally:
        mixing.FEW_SOURCES = few
