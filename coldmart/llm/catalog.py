"""The registered queries of this subpackage, one for each operator, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldmart.llm import (
    chat,
    exact_topk,
    language,
    lexical,
    licenses,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    packing,
    pieces,
    rotated_codes,
    text,
    url_filter,
)
from coldmart.session import tune

Query = Callable[[SparkSession, str], DataFrame]

_registered: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    _registered[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_registered)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_url_filter(spark, sf_dir):
    rules = [
        ("org", "/", "allow"),
        ("example.org", "/es/", "block"),
        ("example.org", "/en/1", "block"),
        ("com", "/fr/", "allow"),
        ("com", "/de/", "block"),
    ]
    out = url_filter.judge(_table(spark, sf_dir, "pages"), rules, default="allow")
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query
def op2_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.Model.fit(docs.filter(~held_out), "lang", "text")
    out = language.identify(docs, model, F.col("doc_id")).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_exact_topk(spark, sf_dir):
    return exact_topk.search(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


@query
def op4_nearest(spark, sf_dir):
    return rotated_codes.search(_table(spark, sf_dir, "embeddings"), every=100, k=10)


@query
def op5_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    out = line_dedup.drop_common_lines(docs, min_docs=10, min_length=1, distinct_ids=True)
    return out.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


@query
def op6_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, window=4096).select(
        F.col("id").alias("doc_id"),
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    )


TRICKY = "\\### Assistant: </turn> ok"


@query
def op7_chat_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema
    )
    formatted = chat.format_conversations(rows.union(added))
    return chat.digests(formatted).withColumnRenamed("id", "conv_id")


@query
def op8_near_dedup(spark, sf_dir):
    out = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=85)
    same = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", same.alias("kept"))


@query
def op9_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
    )


@query
def op10_mixing(spark, sf_dir):
    out = mixing.shares(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op11_merkle(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = merkle.digest(fields)
    lowered = merkle.digest([*fields[:-1], text.ascii_lower(fields[-1])])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("tree"), leaf.alias("leaf"),
        F.when(tampered, lowered).otherwise(leaf).alias("claimed"),
    )
    return merkle.prove(leaves).withColumnRenamed("id", "doc_id")


@query
def op13_pieces(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    wanted = ["n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), path, "doc_id", outputs=wanted)


@query
def op12_lexical(spark, sf_dir):
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)
