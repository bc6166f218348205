"""Exact quantiles with linear interpolation that never gather a large group in one task.

``percentile`` keeps a map of all distinct values of a group, so it is used only for groups
whose row count is proven small. A larger group takes two passes: a sketch brackets each wanted
rank, then only the values inside the brackets are counted and read off exactly.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import as_double, fits, join_on, stack_metrics, union_all

EXACT_ROWS = 1_000_000
SKETCH_ACCURACY = 100_000


def quantile_table(df, cols, probs, by=(), exact_rows=None, accuracy=None):
    """(by..., column, n, q ARRAY<DOUBLE>) with one entry of ``q`` per probability."""
    limit = EXACT_ROWS if exact_rows is None else exact_rows
    accuracy = accuracy or SKETCH_ACCURACY
    by = list(by)
    base = df.select(*by, *[as_double(c).alias(f"v{i}") for i, c in enumerate(cols)])
    if fits(base, limit):
        return _direct(base, cols, probs, by)
    if not by:
        return _bracketed(base, cols, probs, by, accuracy)
    # At most one group per ``limit`` rows is large, so these sides are small, and no row moves to a task of its group.
    large = F.broadcast(base.groupBy(*by).count().filter(F.col("count") > limit).drop("count"))
    return union_all([
        _direct(join_on(base, large, by, "left_anti"), cols, probs, by),
        _bracketed(join_on(base, large, by, "left_semi"), cols, probs, by, accuracy),
    ])


def median_table(df, cols, by=()):
    """(by..., column, n, median)"""
    return quantile_table(df, cols, [0.5], by).withColumn("median", F.col("q")[0]).drop("q")


def quantile_values(df, cols, probs):
    """Driver-side {column: [values]}; bounded by columns x probabilities."""
    return {r["column"]: list(r["q"]) for r in quantile_table(df, cols, probs).collect() if r["q"] is not None}


def _direct(base, cols, probs, by):
    grid = F.array(*[F.lit(float(p)) for p in probs])
    aggs = []
    for i in range(len(cols)):
        aggs += [F.count(f"v{i}").alias(f"{i}_n"), F.percentile(f"v{i}", grid).alias(f"{i}_q")]
    return stack_metrics(base.groupBy(*by).agg(*aggs), cols, ["n", "q"], by)


def _bracketed(base, cols, probs, by, accuracy):
    eps = 4.0 / accuracy
    edges = F.array(*[F.lit(min(1.0, max(0.0, p + s))) for p in probs for s in (-eps, eps)])
    aggs = []
    for i in range(len(cols)):
        aggs += [
            F.count(f"v{i}").alias(f"n{i}"),
            F.percentile_approx(f"v{i}", edges, accuracy).alias(f"e{i}"),
        ]
    sketch = base.groupBy(*by).agg(*aggs)
    if by:
        joined = join_on(base, F.broadcast(sketch), by)
    else:
        row = sketch.first()
        joined = base.select("*", *[
            x for i in range(len(cols))
            for x in (F.lit(row[f"n{i}"]).alias(f"n{i}"),
                      F.array(*[F.lit(v).cast("double") for v in (row[f"e{i}"] or [None] * (2 * len(probs)))]).alias(f"e{i}"))
        ])
    below, inside = [], []
    for i in range(len(cols)):
        for j in range(len(probs)):
            lo, hi, v = F.col(f"e{i}")[2 * j], F.col(f"e{i}")[2 * j + 1], F.col(f"v{i}")
            below.append(F.count_if(v < lo).alias(f"b{i}_{j}"))
            inside.append(F.when((v >= lo) & (v <= hi), F.struct(
                F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v"))))
    counted = joined.groupBy(*by).agg(*below, *[F.max(f"n{i}").alias(f"n{i}") for i in range(len(cols))])
    heads = counted.select(*by, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"b{i}_{j}").alias("b"), F.col(f"n{i}").alias("n"),
                 (F.lit(float(p)) * (F.col(f"n{i}") - 1)).alias("pos"))
        for i in range(len(cols)) for j, p in enumerate(probs)
    ])).alias("_h")).select(*by, "_h.*")
    values = (
        joined.select(*by, F.explode(F.array_compact(F.array(*inside))).alias("_x")).select(*by, "_x.*")
        .groupBy(*by, "i", "j", "v").count()
    )
    upto = F.sum("count").over(Window.partitionBy(*by, "i", "j").orderBy("v"))
    values = values.withColumn("upto", upto)
    reach = F.col("upto") + F.col("b")
    found = (
        join_on(heads, values, [*by, "i", "j"], "left")
        .groupBy(*by, "i", "j", "n", "pos")
        .agg(F.min(F.when(reach > F.floor("pos"), F.col("v"))).alias("lo"),
             F.min(F.when(reach > F.ceil("pos"), F.col("v"))).alias("hi"))
        .withColumn("x", F.col("lo") + (F.col("pos") - F.floor("pos")) * (F.col("hi") - F.col("lo")))
    )
    names = F.array(*[F.lit(c) for c in cols])
    return (
        found.groupBy(*by, "i").agg(
            F.max("n").alias("n"),
            F.when(F.max("n") > 0, F.transform(
                F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"])).alias("q"))
        .select(*by, names[F.col("i")].alias("column"), "n", "q")
    )
