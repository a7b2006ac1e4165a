"""License scan: exact phrases, and a set-similarity join with license texts.

Phrases are found word by word. The join looks for further blocks of text that contain a
license template: a block is a window of twice the longest template's words, every half
window, so that a passage as long as a template lies within one block. A block meets a
template when it holds at least ``threshold`` of the template's distinct words (all of them, if
they are fewer than ten) and, in a row, the words that tell the template from others: CC BY,
BY-SA, BY-NC and BY-ND differ in one word, and a share of words alone would mix them up.

The join orders tokens from rare to frequent, by their counts over all documents. At least one
of a template's first ``|T| - needed + 1`` tokens is in every block that meets it (prefix
filter); blocks with too few distinct words are out (length filter); a candidate whose matched
places leave too few tokens on either side is out (positional filter). What remains is counted
exactly. Templates are the caller's list, and only their own tokens are ranked, so the small
side of the join is as large as that list, however many documents there are.

Common words make no hot groups: only tokens of some template's prefix leave a document, each
window is joined where it stands, and the counts of a document are summed before the shuffle.

Defined cases: a null text has no words; equal rows are answered alike; a phrase or template
without words is an error, as is a template without its telling words.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.llm import scratch
from coldmart.llm.text import ascii_lower

# Fixed values of the contract: phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening statements of public licenses, each with the words that stand in a row in it and tell it
# from the others.
TEMPLATES = {
    "mit": (
        ("released under the mit license", "mit license"),
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software"
            " and associated documentation files to deal in the software without restriction",
            "permission is hereby granted",
        ),
    ),
    "apache-2": (
        ("licensed under the apache license version 2 0", "apache license version 2"),
        (
            "licensed under the apache license you may not use this file except in compliance with the license",
            "under the apache license",
        ),
    ),
    "cc-by": (
        ("licensed under cc by 4 0", "cc by 4"),
        ("licensed under a creative commons attribution 4 0 international license", "attribution 4"),
    ),
    "cc-by-sa": (
        ("licensed under cc by sa 4 0", "cc by sa 4"),
        ("licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4"),
    ),
    "cc-by-nc": (
        ("licensed under cc by nc 4 0", "cc by nc 4"),
        (
            "licensed under a creative commons attribution noncommercial 4 0 international license",
            "attribution noncommercial 4",
        ),
    ),
    "cc-by-nd": (
        ("licensed under cc by nd 4 0", "cc by nd 4"),
        (
            "licensed under a creative commons attribution noderivatives 4 0 international license",
            "attribution noderivatives 4",
        ),
    ),
    "gpl-3": (
        ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
        (
            "free software you can redistribute it and or modify it under the terms of the gnu general"
            " public license as published by the free software foundation",
            "gnu general public license",
        ),
    ),
    "bsd": (
        (
            "redistribution and use in source and binary forms with or without modification are permitted"
            " provided that the following conditions are met",
            "redistribution and use in source and binary forms",
        ),
    ),
}
THRESHOLD = 0.85
WHOLE_BELOW = 10  # distinct words


def needed_words(wording: str, threshold: float) -> int:
    """How many distinct words of a template a block must hold."""
    n = len(set(wording.split()))
    return n if n < WHOLE_BELOW else math.ceil(threshold * n - 1e-9)


_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN, -1)
    return F.array_remove(split, "")


def _starts(tokens: Column, joined: Column, phrase: str) -> Column:
    """Where a phrase's words stand; looked for only in texts that hold the phrase at all."""
    parts = phrase.split()
    last = F.size(tokens) - len(parts)

    def stands(i: Column) -> Column:
        met = F.get(tokens, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            met = met & (F.get(tokens, i + k) == part)
        return met

    return F.when(
        F.contains(joined, F.lit(f" {' '.join(parts)} ")),
        F.filter(F.sequence(F.lit(0), last), stands),
    ).otherwise(F.array().cast("array<int>"))


def _ranked(tokens: DataFrame, templates: Mapping[str, Sequence[tuple[str, str]]]) -> dict[str, int]:
    """Counts over the whole corpus of the words that templates use (that many rows)."""
    used = sorted({w for texts in templates.values() for t, _ in texts for w in t.split()})
    counted = (
        tokens.select(F.explode("tokens").alias("token"))
        .filter(F.col("token").isin(used))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = {row["token"]: row["n"] for row in counted.collect()}
    return {w: k for k, w in enumerate(sorted(used, key=lambda w: (found.get(w, 0), w)))}


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Sequence[tuple[str, str]]] = TEMPLATES,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    ``blocks`` lists what the join found: label, first word, words held. ``score`` is the largest
    share of a template that a block holds, 1 for a phrase, 0 where nothing was found.
    """
    if not all(p.split() for p in [*phrases, *(p for v in templates.values() for t in v for p in t)]):
        raise ValueError("a phrase or template without words")
    spark = docs.sparkSession
    texts = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text")
    )
    # Written once, as three passes read the words.
    tokens = scratch.table(texts.select("id", "version", words(F.col("text")).alias("tokens")), "license-words")
    rank = _ranked(tokens, templates)

    # The small side: every template's tokens, rare ones first, and its prefix.
    rows = []
    for label, wordings in sorted(templates.items()):
        for wording, telling in wordings:
            ordered = sorted(set(wording.split()), key=rank.__getitem__)
            needed = needed_words(wording, threshold)
            for place, token in enumerate(ordered[: len(ordered) - needed + 1]):
                rows.append((token, label, f" {telling} ", place, needed, ordered))
    side = spark.createDataFrame(
        rows,
        "token string, label string, telling string, place int, needed int, ordered array<string>",
    )
    step = max(len(t.split()) for v in templates.values() for t, _ in v)
    known = F.array(*[F.lit(w) for w in sorted(rank, key=rank.__getitem__)])
    prefixes = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1 - step, F.lit(0)), F.lit(step)),
        lambda at: F.struct(
            at.alias("at"), F.slice("tokens", at + 1, 2 * step).alias("words")
        ),
    )
    blocks = (
        tokens.filter(F.arrays_overlap("tokens", prefixes))
        .select("id", "version", F.explode(windows).alias("block"))
        .filter(F.arrays_overlap("block.words", prefixes))
        .select(
            "id",
            "version",
            F.col("block.at").alias("at"),
            F.concat(F.lit(" "), F.array_join("block.words", " "), F.lit(" ")).alias("said"),
            F.size(F.array_distinct("block.words")).alias("width"),
            # In the global order, as ``known`` is.
            F.array_intersect(known, F.col("block.words")).alias("held"),
        )
    )
    probes = blocks.select("*", F.posexplode("held").alias("held_place", "token"))
    shared = F.size(F.array_intersect("ordered", F.col("held")))
    met = (
        probes.join(side, "token")
        .filter(F.col("width") >= F.col("needed"))
        .filter(
            F.least("place", "held_place")
            + F.least(F.size("ordered") - F.col("place"), F.size("held") - F.col("held_place"))
            >= F.col("needed")
        )
        .filter(shared >= F.col("needed"))
        .filter(F.contains("said", F.col("telling")))
        .select(
            "id", "version", "label", "at", (shared / F.size("ordered")).alias("share"),
        )
    )
    found = met.groupBy(F.col("id").alias("of"), F.col("version").alias("of_version")).agg(
        F.collect_set("label").alias("joined"),
        F.max("share").alias("share"),
        F.sort_array(F.collect_set(F.struct("label", "at", "share"))).alias("blocks"),
    )

    joined = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    places = tokens.select("id", "version", "tokens", joined.alias("joined")).select(
        "id",
        "version",
        F.size("tokens").cast("bigint").alias("n_words"),
        *[_starts(F.col("tokens"), F.col("joined"), p).alias(f"p{k}") for k, p in enumerate(phrases)],
    )
    every = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    labels = F.array_compact(
        F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(v)) for k, v in enumerate(phrases.values())])
    )
    based = places.select(
        "id",
        "version",
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        labels.alias("base"),
    )
    none = F.array().cast("array<string>")
    return based.join(
        found,
        F.col("id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")),
        "left",
    ).select(
        "id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union("base", F.coalesce("joined", none))), ","
        ).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "blocks",
    )
