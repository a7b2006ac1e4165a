"""Drop lines that many documents share.

Every line of every text is normalised and hashed to 128 bits; a first pass counts the
documents of each hash, a second finds the positions of the common ones, and each text is put
together again from the stretches between those positions. Only hashes and positions are
shuffled by line; a text moves once, to meet the positions of its own document.

A line in a third of all documents is harmless: its counts are summed before the shuffle, and
the join with the common hashes is a plain join whose large partitions Spark splits.

Defined cases: a null text is one empty line; empty keys (shorter than ``min_length``) are never
common; a text that loses all its lines becomes empty. A document counts once however often its
rows were delivered (a row without an id by its text), if ``distinct_ids`` asks for it, as the
registered query and the pipeline do; otherwise every row counts as a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldmart.functions.rows import computed
from coldmart.llm import scratch
from coldmart.llm.text import WHITE, ascii_lower


def _digest(lowered: Column, min_length: int) -> Column:
    """128 bits of a line's key; null for a key that is too short to count."""
    key = F.trim(lowered, F.lit(WHITE))
    return F.when(
        F.length(key) >= min_length,
        F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")),
    )


def _without(lines: Column, ends: Column) -> Column:
    """The lines between the positions ``ends``, which begin with -1 and end with their number.

    Both are columns of their own, so each stretch costs its own length.
    """
    stretches = F.transform(
        F.sequence(F.lit(1), F.size(ends) - 1),
        lambda i: F.slice(lines, F.get(ends, i - 1) + 2, F.get(ends, i) - F.get(ends, i - 1) - 1),
    )
    return F.array_join(F.flatten(stretches), "\n")


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_length: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    distinct_ids: bool = False,
) -> DataFrame:
    """All columns of ``docs`` in ``row``, with ``kept_text``, ``n_lines`` and ``n_dropped``."""
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("version", F.xxhash64("text"))
    hashed = scratch.table(
        whole.select(
            "id",
            "version",
            F.monotonically_increasing_id().alias("row_no"),
            F.transform(
                F.split(ascii_lower(F.col("text")), "\n", -1),
                lambda line: _digest(line, min_length),
            ).alias("keys"),
        ),
        "line-keys",
    )
    # A line counts once a row, or once a document; repeats go before the shuffle.
    nameless = F.when(F.col("id").isNull(), F.col("version"))
    owner = [F.col("id"), nameless] if distinct_ids else [F.col("row_no")]
    counted = hashed.select(F.explode("keys").alias("key"), F.struct(*owner).alias("owner"))
    counted = counted.filter("key IS NOT NULL").select("key.a", "key.b", "owner").distinct()
    # A table, so that the join below is a plain one whose large partitions Spark splits.
    common = scratch.table(
        counted.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs)
        .select("a", "b"),
        "common-lines",
    )
    placed = hashed.select("id", "version", F.posexplode("keys").alias("position", "key")).filter(
        "key IS NOT NULL"
    )
    gone = (
        placed.select("id", "version", "position", "key.a", "key.b")
        .join(common, ["a", "b"])
        .groupBy(F.col("id").alias("gone_id"), F.col("version").alias("gone_version"))
        .agg(F.sort_array(F.collect_set("position")).alias("gone"))
    )
    joined = whole.join(
        gone,
        F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")),
        "left",
    )
    cut = computed(joined, _lines=F.split("text", "\n", -1))
    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("_lines")))
    return computed(cut, _ends=ends).select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(_without(F.col("_lines"), F.col("_ends")))
        .alias("kept_text"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
