"""The pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_near_dedup import plain  # noqa: E402
from test_texts import plain_line_dedup, plain_targets  # noqa: E402

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages_one_by_one(spark, tmp_path):
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(-1, None, "en", "s", 0), (-2, "", None, None, None), (-3, "12 34", "de", "s", 5)]
    docs = given.union(spark.createDataFrame(odd, given.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_dedup", "mix", "pack"]

    def step(name, docs):
        out = stages[name](spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    told = step("language", docs)
    assert told.columns == docs.columns and told.dtypes == docs.dtypes
    assert {r["doc_id"] for r in rows_of(told)} == {r["doc_id"] for r in rows_of(given)}

    lines = step("line_dedup", told)
    assert lines.dtypes == docs.dtypes
    before = sorted(rows_of(told), key=lambda r: r["doc_id"])
    want = [t for _, _, t in plain_line_dedup([r["text"] for r in before], 10)]
    after = sorted(rows_of(lines), key=lambda r: r["doc_id"])
    assert [r["text"] for r in after] == want
    assert all(r["n_chars"] == len(r["text"]) for r, b in zip(after, before) if r["text"] != b["text"])

    near = step("near_dedup", lines)
    assert near.dtypes == docs.dtypes
    groups = plain([(r["doc_id"], r["text"]) for r in after])
    assert {r["doc_id"] for r in rows_of(near)} == {d for d, _, c in groups if d == c}

    mixed = step("mix", near)
    assert mixed.dtypes == docs.dtypes
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows_of(near):
        n = len((r["text"] or "").split())
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in rows_of(mixed):
        taken[r["source"]] += len(r["text"].split())
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6

    packed = step("pack", mixed)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()
    copies = Counter(r["doc_id"] for r in rows_of(mixed))
    firsts = Counter(r["doc_id"] for r in rows_of(packed) if r["start"] == 0)
    assert firsts == copies


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 200


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, DATA).count() == 0
