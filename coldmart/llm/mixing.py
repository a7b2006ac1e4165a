"""Mix sources to target weights by hash thresholds, without sorting documents.

A source's target is split into whole copies of the source and a remainder. For the remainder
each document has a fixed 48-bit hash; documents below a threshold get one copy more. The
threshold comes from histograms: words summed by source and hash bucket, the bucket in which
the remainder ends found from running sums over at most ``BUCKETS`` rows a source, and only
that bucket divided again, level by level. The thresholds are nested, so a larger target takes
what a smaller one took and more.

A source with a third of all rows is harmless: every histogram is summed before its shuffle,
and joins on the source are salted, or broadcast where the table of sources was counted small.

Defined cases: a null text has no words; a null source is a source of its own, the last;
documents without words take nothing; equal rows share their hash and their fate; sources
without words have target 0. Reruns agree, as nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldmart.llm import scratch
from coldmart.llm.text import WORD

BITS = 12
BUCKETS = 1 << BITS
LEVELS = 4
SALTS = 32
FEW_SOURCES = 10_000  # up to here the table of sources is sent to all executors


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def chance(doc_id: Column, text: Column) -> Column:
    """48 bits that depend on nothing but the document."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), content)
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: all words, shared by weight, capped.

    Sources are ordered by their cap for a unit of weight. In that order a source is capped as
    long as the rest, shared by weight, would give it more than its cap; the first that is not
    sets the level for all after it. One row a source, so one task may order them.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(w).cast("bigint") for w in weights])
    weighed = sizes.withColumn(
        "weight", F.get(given, (F.row_number().over(named) - 1) % len(weights))
    )
    cap = F.lit(most) * F.col("source_size")
    tight = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    onward = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = weighed.select(
        "source",
        "source_size",
        "weight",
        cap.alias("cap"),
        F.row_number().over(tight).alias("place"),
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .alias("rest"),
        F.sum("weight").over(onward).alias("open"),
    )
    free = F.col("weight") * F.col("rest") <= F.col("cap") * F.col("open")
    level = F.min(F.when(free, F.struct("place", "rest", "open"))).over(Window.partitionBy())
    share = (F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.open")
    return (
        filled.withColumn("level", level)
        .withColumn("free", F.col("place") >= F.col("level.place"))
        .select(
            "source",
            "source_size",
            F.when(F.col("free"), share).otherwise(F.col("cap").cast("double")).alias("target"),
        )
    )


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, below``: the hash below which the words of a source come nearest to ``left``."""
    state = wanted.filter("left > 0").select("source", "left", F.lit(0).cast("bigint").alias("low"))
    for level in range(LEVELS):
        width = BITS * (LEVELS - 1 - level)  # bits below this level's
        edge = _salted(state).select(F.col("source").alias("of"), "salt", "left", "low")
        inside = sized.join(
            edge,
            F.col("source").eqNullSafe(F.col("of"))
            & (sized["salt"] == edge["salt"])
            & (F.shiftright("chance", width + BITS) == F.shiftright("low", width + BITS)),
        )
        histogram = inside.groupBy(
            "source", "left", "low", F.shiftright("chance", width).alias("bucket")
        ).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket")
        reached = F.sum("words").over(running.rowsBetween(Window.unboundedPreceding, 0))
        state = (
            histogram.withColumn("reached", reached)
            .filter((F.col("reached") >= F.col("left")) & (F.col("reached") - F.col("words") < F.col("left")))
            .select(
                "source",
                (F.col("left") - (F.col("reached") - F.col("words"))).alias("left"),
                F.shiftleft("bucket", width).alias("low"),
                "words",
            )
        )
    nearer = F.when(2 * F.col("left") >= F.col("words"), 1).otherwise(0)  # with the last hash or not
    return state.select(F.col("source").alias("of"), (F.col("low") + nearer).alias("below"))


def mixture(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """``sized(id, source, size, chance, salt)`` and a row a source that says what it takes."""
    sized = scratch.table(
        docs.select(
            F.col(doc_id).alias("id"),
            F.col(source).cast("string").alias("source"),
            words_in(F.col(text)).alias("size"),
            chance(F.col(doc_id), F.col(text)).alias("chance"),
        ).withColumn("salt", (F.col("chance") % SALTS).cast("int")),
        "sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = scratch.table(
        targets(sums, weights, most).withColumn(
            "whole",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
            .otherwise(0)
            .cast("bigint"),
        ),
        "targets",
    )
    wanted = aimed.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    below = _thresholds(sized, wanted)
    taken = aimed.join(below, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("from"),
        "source_size",
        "target",
        "whole",
        F.coalesce("below", F.lit(0).cast("bigint")).alias("below"),
    )
    return sized, scratch.table(taken, "thresholds")


def _with_source(df: DataFrame, taken: DataFrame) -> DataFrame:
    """``df(source, chance, salt, ...)`` beside the row of its source."""
    if taken.count() <= FEW_SOURCES:
        return df.join(F.broadcast(taken), F.col("source").eqNullSafe(F.col("from")))
    spread = _salted(taken).withColumnRenamed("salt", "from_salt")
    return df.join(
        spread, F.col("source").eqNullSafe(F.col("from")) & (F.col("salt") == F.col("from_salt"))
    )


def _copies() -> Column:
    return F.col("whole") + (F.col("chance") < F.col("below")).cast("bigint")


def shares(docs: DataFrame, **options) -> DataFrame:
    """``id, size, source_size, target, taken``: how many words of each document the mix takes."""
    sized, taken = mixture(docs, **options)
    return _with_source(sized, taken).select(
        "id", "size", "source_size", "target", (_copies() * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    _, taken = mixture(docs, **options)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(options.get("source", "source")).cast("string").alias("source"),
        chance(F.col(doc_id), F.col(text)).alias("chance"),
        F.regexp_like(F.col(text), F.lit(WORD)).alias("worded"),
    ).withColumn("salt", (F.col("chance") % SALTS).cast("int"))
    repeated = _with_source(rows.filter("worded"), taken).withColumn("copies", _copies())
    once_each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return repeated.filter("copies > 0").select("row", once_each).select("row.*")
