from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from coldmart.operators.asof import asof_version, lookup_or_absent
from coldmart.operators.ordered import chunked, last_known, neighbours, running_count
from shapes import at


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    # One key holds most rows, one chunk is crowded, and there are chunks with a single row.
    rows = [("hot", rng.choice([rng.randint(-500, 500), rng.randint(40, 60)]), n) for n in range(300)]
    rows += [(f"k{n % 5}", rng.randint(-500, 500), 1000 + n) for n in range(60)]
    return spark.createDataFrame(rows, "k STRING, t BIGINT, n BIGINT").cache()


@pytest.mark.parametrize("length", [1, 7, 50, 10_000])
def test_neighbours_match_a_plain_window(series, length):
    w = Window.partitionBy("k").orderBy("t", "n")
    want = series.select("*", F.lag("n").over(w).alias("before"), F.lead("t").over(w).alias("after"))
    got = neighbours(series, ["k"], ["t", "n"], lag={"before": F.col("n")}, lead={"after": F.col("t")}, rows=length)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("length", [1, 9, 10_000])
def test_running_sums_match_a_plain_window(series, length):
    w = Window.partitionBy("k").orderBy("t", "n").rowsBetween(Window.unboundedPreceding, 0)
    odd = F.col("n") % 2 == 1
    want = series.select("*", F.count_if(odd).over(w).alias("c"))
    got = running_count(series, ["k"], ["t", "n"], "c", odd, length)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("length", [1, 6, 10_000])
def test_last_known_values_match_a_plain_window(series, length):
    w = Window.partitionBy("k").orderBy("t", "n").rowsBetween(Window.unboundedPreceding, 0)
    rare = F.when(F.col("n") % 37 == 1, F.col("n"))
    want = series.select("*", F.last(rare, ignorenulls=True).over(w).alias("v"))
    got = last_known(series, ["k"], ["t", "n"], "v", rare, length)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_null_keys_and_places_and_empty_tables(spark):
    rows = [(None, None, 1), (None, 5, 2), ("a", None, 3), ("a", 1, 4), (None, 7, 5)] + [("a", 9, k) for k in range(10, 40)]
    df = spark.createDataFrame(rows, "k STRING, t BIGINT, n BIGINT")
    w = Window.partitionBy("k").orderBy("t", "n")
    want = df.select("*", F.lag("n").over(w).alias("before"))
    got = neighbours(df, ["k"], ["t", "n"], lag={"before": F.col("n")}, rows=2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert running_count(df.limit(0), ["k"], ["t"], "c").collect() == []


@pytest.mark.parametrize("spread", [3600, 1])
def test_no_chunk_outgrows_its_bound_in_a_hot_hour_or_a_single_instant(spark, spread):
    rows, n = 400, 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 20 < 19, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("k"),
        (F.xxhash64("id") % spread).alias("t"),
        "id",
    )
    assert chunked(df, ["k"], ["t", "id"]) is None
    sizes = chunked(df, ["k"], ["t", "id"], rows).groupBy("k", "_chunk").count().collect()
    assert sum(r["count"] for r in sizes) == n
    assert max(r["count"] for r in sizes) <= 3 * rows
    assert sum(r["k"] == "hot" for r in sizes) >= 0.95 * n / rows / 2
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("after", F.lead("id").over(w)).agg(F.sum(F.xxhash64("k", "id", "after") % 1000)).first()
    got = neighbours(df, ["k"], ["t", "id"], lead={"after": F.col("id")}, rows=rows)
    assert got.agg(F.sum(F.xxhash64("k", "id", "after") % 1000)).first() == want


def test_rows_are_shuffled_once(spark, tmp_path):
    spark.range(5000).selectExpr("id % 3 as k", "id as t", "id as n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = running_count(df, ["k"], ["t"], "c", rows=500)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line and "_chunk" in line]
    # One of all rows for the window; the other is of the chunks' totals.
    assert len(exchanges) == 2


def test_no_join_gathers_a_series_by_its_key(spark, tmp_path):
    spark.range(5000).selectExpr("id % 3 as k", "id as t", "id as n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neighbours(df, ["k"], ["t"], lag={"before": F.col("n")}, rows=500)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    rows = got.filter("before is not null").agg(F.count("*"), F.min(F.col("n") - F.col("before")), F.max("t")).first()
    assert tuple(rows) == (4997, 3, 4999)


def test_a_chunk_is_a_quarter_of_a_million_rows(spark):
    df = spark.range(900_000).selectExpr("'a' as k", "id as t")
    sizes = [r["count"] for r in chunked(df, ["k"], ["t"]).groupBy("_chunk").count().collect()]
    assert sum(sizes) == 900_000 and max(sizes) < 500_000


def test_boundaries_from_copies_are_those_of_the_rows(spark):
    df = spark.range(40_000).selectExpr("if(id % 10 = 0, null, 'a') as k", "id as t")
    copies = df.unionByName(df).unionByName(df.filter("t < 5000"))
    want = chunked(df, ["k"], ["t"], 3000).collect()
    assert sorted(chunked(df, ["k"], ["t"], 3000, copies).collect(), key=str) == sorted(want, key=str)
    assert chunked(df, ["k"], ["t"], 60_000, copies) is None


def test_asof_finds_the_valid_version_by_brute_force(spark):
    rng = random.Random(11)
    versions, facts = [], []
    for key, count in (("hot", 60), ("few", 2), ("one", 1)):
        starts = sorted(rng.sample(range(0, 20_000), count))
        ends = [*starts[1:], None]
        for n, (start, end) in enumerate(zip(starts, ends)):
            if n % 9 == 4:
                end = start + (end - start) // 2 if end else end  # a hole
            versions.append((key, start, end, f"{key}-{n}"))
        versions.append((key, starts[0], starts[0], f"{key}-empty"))
        facts += [(key, rng.randint(-100, 25_000)) for _ in range(200)] + [(key, s) for s in starts]
    facts.append(("unknown", 5))
    want = sorted(
        (k, t, next((v for key, a, b, v in versions if key == k and a <= t and (b is None or t < b)), None))
        for k, t in facts
    )
    dim = spark.createDataFrame(
        [(k, at(a), None if b is None else at(b), v) for k, a, b, v in versions],
        "k STRING, valid_from TIMESTAMP, valid_to TIMESTAMP, v STRING",
    )
    rows = spark.createDataFrame([(k, t, at(t)) for k, t in facts], "k STRING, t INT, m TIMESTAMP")
    for length in (2, 20, 10**6):
        got = asof_version(rows, dim, "k", F.col("m"), ["v"], rows=length).select("k", "t", "v").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_asof_of_ten_thousand_versions_in_one_second(spark):
    micros = F.timestamp_micros
    versions = spark.range(10_000).select(
        F.lit("k").alias("k"), micros(F.col("id") * 100).alias("valid_from"),
        micros(F.when(F.col("id") < 9_999, (F.col("id") + 1) * 100)).alias("valid_to"), F.col("id").alias("v"),
    )
    facts = spark.range(30_000).select(F.lit("k").alias("k"), micros(F.col("id") * 40).alias("m"), "id")
    got = asof_version(facts, versions, "k", F.col("m"), ["v"], rows=1000)
    wrong = F.col("v") != F.least(F.expr("id * 40 div 100"), F.lit(9_999))
    assert got.agg(F.count_if(wrong), F.count("v")).first() == (0, 30_000)


def test_asof_of_facts_without_key_or_instant(spark):
    facts = spark.createDataFrame([(None, at(5)), ("a", None), ("a", at(5)), ("a", at(5))], "k STRING, m TIMESTAMP")
    versions = spark.createDataFrame([(None, at(0), None, 1), ("a", at(0), None, 2)], "k STRING, valid_from TIMESTAMP, valid_to TIMESTAMP, v INT")
    got = asof_version(facts, versions, "k", F.col("m"), ["v"])
    assert sorted(((r["k"], r["v"]) for r in got.collect()), key=str) == [("a", 2), ("a", 2), ("a", None), (None, None)]
    assert asof_version(facts, versions.limit(0), "k", F.col("m"), ["v"]).filter("v is not null").count() == 0


def test_lookup_falls_back_to_the_absent_member(spark):
    rows = spark.createDataFrame([("x",), ("y",), (None,)], "s STRING")
    dim = spark.createDataFrame([("x", 9)], "p STRING, key BIGINT")
    got = lookup_or_absent(rows, dim, F.col("s") == F.col("p"), "key").select("s", "key").collect()
    assert sorted(map(tuple, got), key=str) == [("x", 9), ("y", 0), (None, 0)]
