"""The list that the URL query makes from the pages decides rows, by the filter and the join."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsight.llm import urls
from gridsight.llm.queries import URL_RULES, load


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_list_blocks_pages_at_every_size(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    assert not urls.listed_urls(pages).isEmpty()
    open_ = load()[0]["op9_url_filter"](spark, f"/root/testdata/{sf}").filter("rule is null")
    blocked, rest = open_.agg(F.count_if(F.col("verdict") == "block"), F.count(F.lit(1))).first()
    assert blocked >= 0.01 * rest and blocked < 0.2 * rest


def test_the_plan_joins_by_hash(spark):
    plan = load()[0]["op9_url_filter"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_false_positives_are_few_and_go_to_the_join(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("bad.org/"), "id").alias("canonical"))
    words = urls.blocked_bloom(listed)
    asked = spark.range(60_000).select("id", *[h.alias(n) for h, n in zip(urls._hashes(F.concat(F.lit("bad.org/"), "id")), "ab")]).orderBy("id").toPandas()
    hit = urls.may_hold(words, asked["a"].to_numpy(np.int64), asked["b"].to_numpy(np.int64))
    assert hit[:20_000].all() and hit[20_000:].mean() < 0.01


def test_poor_payloads_are_listed(spark):
    two = "<p>a<p>b"
    rows = [(1, "http://a.org/x", two + "### " * 10), (2, "http://a.org/y", two + "*** " * 9), (3, None, "%%% " * 20), (4, "http://a.org/z", None), (5, "http://www.a.org/x/", ""), (6, "http://b.org/", two + "%%%###***" * 5), (7, "http://c.org", "<p>"), (8, "http://d.org", two)]
    got = {r[0] for r in urls.poor_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"a.org/x", "b.org", "c.org"}
