"""A corpus from raw documents to packed sequences, stage by stage.

Every stage works on all that the one before it kept and is written as Parquet before the next
one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldmart.llm import language, line_dedup, mixing, near_dedup, packing, scratch
from coldmart.session import tune

# Least share of a document's letters on spans of its language. Mixed texts are fine; only what
# has no language, or none that takes a third of it, goes.
LEAST_SCORE = 1 / 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language, with the language that the text shows.

    The model is fitted on the labels of the stage's own input. Texts without a letter, and those
    of which no language has a third, are rejected. Letters whose script no learned language uses
    count as one language, ``und``: the model cannot speak against them.
    """
    model = language.Model.fit(docs, "lang", "text")
    found = language.identify(docs, model, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = found.filter(F.greatest("score", "unlearned") >= LEAST_SCORE)
    shown = F.when(F.col("unlearned") > F.col("score"), language.UNKNOWN).otherwise(F.col("lang_pred"))
    return kept.select(
        *[(shown if c == "lang" else F.col(f"key.`{c}`")).alias(c) for c in docs.columns]
    )


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share."""
    found = line_dedup.drop_common_lines(docs, min_docs=10, min_length=1, distinct_ids=True)
    changed = F.col("n_dropped") > 0
    new = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars")),
    }
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.85."""
    return near_dedup.keep_one(docs, width=5, percent=85)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their weights; documents of wanted sources appear up to three times."""
    return mixing.mix(docs, weights=(1, 2, 3), most=3)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, window=4096).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

# No SQL says what the language model keeps; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch.folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
