"""Whole-table analyses: what is computed once for all parts."""
from pyspark.sql import functions as F

from gridsight.operators import charts, insights
from gridsight.plans import analyze as an


def test_roles_are_inferred_once_on_evenly_dealt_rows(spark, monkeypatch):
    seen = []
    for module in (an, insights, charts):
        plain = module.infer_roles
        monkeypatch.setattr(module, "infer_roles", lambda df, plain=plain: seen.append(df.rdd.getNumPartitions()) or plain(df))
    monkeypatch.setattr(an, "TABLE_ROWS", 50, raising=False)
    t = spark.range(200).coalesce(1).select(F.col("id").alias("key"), (F.col("id") * 37 % 101).cast("double").alias("amount"), (F.col("id") % 4).cast("string").alias("kind"))
    report = an.analyze(t, "key", ("insights", "visualizations"))
    assert seen == [4] and {"roles", "insights"} < set(report)
