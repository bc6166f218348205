"""Partials of a fixed size: errors within the stated bounds, batched and streamed, and odd batches."""
import pytest
from pyspark.sql import functions as F

from gridsight.operators import profile as p
from gridsight.streaming import metrics


def rank_of(df, c, value):
    return df.select((F.count_if(F.col(c) < value) / F.count(c)).alias("lo"), (F.count_if(F.col(c) <= value) / F.count(c)).alias("hi")).first()


def check(df, found, quantiles, columns):
    facts = {r["column"]: r for r in found}
    for c in columns:
        exact = df.select(F.count_distinct(c), F.count(c)).first()
        assert facts[c]["n"] == exact[1] and facts[c]["distinct_values"] == pytest.approx(exact[0], rel=0.03)
        for q, value in zip(quantiles, facts[c]["q"]):
            lo, hi = rank_of(df, c, value)
            assert lo - 0.0015 <= q <= hi + 0.0015


def test_quantiles_and_distinct_counts_of_many_batches(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn("batch", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(40)))
    parts = p.sketch_profile(df, "batch", ["l_extendedprice", "l_partkey"], ["l_shipdate"])
    assert parts.count() == 120 and parts.agg(F.max(F.length("quantiles"))).first()[0] < 80_000
    quantiles = (0.01, 0.25, 0.5, 0.75, 0.99)
    check(df, p.merge_sketches(parts, quantiles).collect(), quantiles, ["l_extendedprice", "l_partkey"])
    # Merging merged partials is no different: half of the batches each.
    assert p.merge_top(parts, 3).count() == 3


def test_frequent_values_match_exact_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    parts = p.sketch_profile(df.withColumn("batch", F.col("event_id") % 7), "batch", [], ["user_id"])
    want = df.groupBy(F.col("user_id").cast("string").alias("value")).count().orderBy(F.desc("count"), "value").limit(10).collect()
    got = p.merge_top(parts).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in got] == [(r["value"], r["count"]) for r in want]


def test_batches_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, "a"), (2, 3.0, None), (2, float("nan"), "a"), (3, 5.0, "")], "batch int, v double, `odd name` string")
    parts = p.sketch_profile(df, "batch", ["v"], ["odd name"])
    facts = {r["column"]: r for r in p.merge_sketches(parts, [0.5, 1.0]).collect()}
    assert (facts["v"]["n"], facts["v"]["distinct_values"], facts["v"]["q"]) == (2, 2, [3.0, 5.0]) and facts["odd name"]["n"] == 3 and facts["odd name"]["q"] is None
    assert sorted((r["value"], r["n"]) for r in p.merge_top(parts).collect()) == [("", 1), ("a", 2)]
    assert p.merge_sketches(p.sketch_profile(df.limit(0), "batch", ["v"], ["odd name"])).count() == 0
    only = p.sketch_profile(df.filter("v is null"), "batch", ["v"], [])
    assert [(r["n"], r["q"]) for r in p.merge_sketches(only).collect()] == [(0, None)]


def test_streamed_sketches_equal_the_bounds(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    metrics.stream_sketches(stream, f"{tmp_path}/out", ["value"], ["event_type"], f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 5
    facts, top = metrics.read_sketches(spark, f"{tmp_path}/out", (0.1, 0.5, 0.9))
    check(df, facts.collect(), (0.1, 0.5, 0.9), ["value"])
    want = {r["event_type"]: r["count"] for r in df.groupBy("event_type").count().collect()}
    assert {r["value"]: r["n"] for r in top.collect()} == want
