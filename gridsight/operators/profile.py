"""Descriptive profiles. Each pass over the rows is one wide aggregate."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import as_double, col, datetime_columns, distinct_table, metric_table, numeric_columns, string_columns, union_all, value_counts
from .ordered import gaps
from .quantiles import median_table, quantile_table


def _top(counts, n, by=("column",)):
    """The n most frequent values per group; ties go to the smaller value."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _modes(counts, by=("column",)):
    """The most frequent value per group, found by a partial aggregate."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("_b")
    return counts.groupBy(*by).agg(best).select(*by, F.col("_b.value").alias("mode"))


def numeric_summary(df, cols):
    """Count, moments and percentiles of numeric columns, rounded to 2 digits."""
    probs = {"p1": .01, "p5": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95, "p99": .99}
    moments = metric_table(df, cols, {
        "count": lambda c: F.count(as_double(c)), "mean": lambda c: F.avg(as_double(c)),
        "std": lambda c: F.stddev_samp(as_double(c)), "min": lambda c: F.min(as_double(c)),
        "max": lambda c: F.max(as_double(c)), "skewness": lambda c: F.skewness(as_double(c)),
        "kurtosis": lambda c: F.kurtosis(as_double(c)),
    })
    q = quantile_table(df, cols, list(probs.values())).select(
        "column", *[F.col("q")[i].alias(p) for i, p in enumerate(probs)])
    joined = moments.join(F.broadcast(q), "column")
    return joined.select("column", "count", *[
        (F.round(m, 2) + F.lit(0.0)).alias(m) for m in ["mean", "std", "min", *probs, "max", "skewness", "kurtosis"]])


def bin_edges(df, c, bins=None):
    """(n, lo, hi, k) on the driver. ``bins=None`` takes the larger of Sturges and Freedman-Diaconis."""
    stats = df.agg(F.count(as_double(c)).alias("n"), F.min(as_double(c)).alias("lo"), F.max(as_double(c)).alias("hi")).first()
    n, lo, hi = stats["n"], stats["lo"], stats["hi"]
    if not n:
        return 0, None, None, 0
    if lo == hi:
        return n, lo - 0.5, hi + 0.5, bins or 1
    if bins is None:
        q = quantile_table(df, [c], [.25, .75]).first()["q"]
        width = (hi - lo) / (math.log2(n) + 1)
        spread = 2 * (q[1] - q[0]) / n ** (1 / 3)
        if spread > 0:
            width = min(width, spread)
        bins = max(1, math.ceil((hi - lo) / width))
    return n, lo, hi, bins


def bin_index(value, lo, hi, k):
    return F.least(F.floor((value - F.lit(lo)) * k / F.lit(hi - lo)), F.lit(k - 1)).cast("int")


def equal_bins(df, c, k, lo, hi):
    """(bin, lo, hi, n) including empty bins."""
    counts = (
        df.select(as_double(c).alias("_v")).filter(F.col("_v").isNotNull())
        .groupBy(bin_index(F.col("_v"), lo, hi, k).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    width = (hi - lo) / k
    grid = df.sparkSession.range(k).select(
        F.col("id").cast("int").alias("bin"), (F.lit(lo) + F.col("id") * width).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("hi"))
    return grid.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def auto_histogram(df, c):
    _, lo, hi, k = bin_edges(df, c)
    return equal_bins(df, c, k, lo, hi)


def categorical_summary(df, cols, top=15):
    """Distinct count, mode and entropy (nats) per column, with its most frequent values."""
    counts = value_counts(df, cols)
    n = F.col("n")
    totals = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("total"),
        F.sum(n * F.log(n)).alias("_nlogn")
    ).withColumn("entropy", F.log("total") - F.col("_nlogn") / F.col("total")).drop("_nlogn")
    joined = _top(counts, top).join(F.broadcast(totals), "column").join(F.broadcast(_modes(counts)), "column")
    return joined.select(
        "column", "distinct_values", "total", "entropy", "mode", "rank", "value", "n",
        (100.0 * n / F.col("total")).alias("percent"))


def binary_summary(df, cols):
    """Count and percent of each value, with the mode."""
    counts = value_counts(df, cols)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(totals), "column").join(F.broadcast(_modes(counts)), "column")
        .select("column", "value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"), "mode")
    )


def gender_counts(df, c):
    return binary_summary(df, [c]).drop("column", "mode")


def likert_summary(df, cols):
    """Scale statistics, one row per scale point."""
    stats = metric_table(df, cols, {
        "count": lambda c: F.count(as_double(c)), "mean": lambda c: F.avg(as_double(c)),
        "std": lambda c: F.stddev_samp(as_double(c)), "min": lambda c: F.min(as_double(c)),
        "max": lambda c: F.max(as_double(c)),
    })
    counts = value_counts(df, cols).withColumn("value", F.col("value").cast("double"))
    # The counted values are few, so their number comes from there and not from a distinct count of all rows.
    stats = stats.join(counts.groupBy("column").agg(F.count_distinct("value").alias("scale_points")), "column")
    return (
        counts.join(F.broadcast(stats), "column").join(F.broadcast(median_table(df, cols).drop("n")), "column")
        .join(F.broadcast(_modes(counts)), "column")
        .select("column", "count", "mean", "median", "mode", "std", "min", "max", "scale_points", "value", "n",
                (100.0 * F.col("n") / F.col("count")).alias("percent"))
    )


RANGE_PATTERN = r"(\d+)\s*[-–—]\s*(\d+)"


def range_bounds(c):
    """(lo, hi) columns of interval text such as ``10-20``; null where the text holds none."""
    text = col(c).cast("string")
    part = lambda i: F.when(F.regexp_extract(text, RANGE_PATTERN, i) != "", F.regexp_extract(text, RANGE_PATTERN, i)).cast("double")
    return part(1), part(2)


def range_summary(df, cols, top=5):
    """Mean bounds and width of interval text, with its most frequent values."""
    stats = metric_table(df, cols, {
        "mean_lo": lambda c: F.avg(range_bounds(c)[0]), "mean_hi": lambda c: F.avg(range_bounds(c)[1]),
        "mean_width": lambda c: F.avg(range_bounds(c)[1] - range_bounds(c)[0]),
        "nulls": lambda c: F.count_if(col(c).isNull()),
    })
    return _top(value_counts(df, cols), top).join(F.broadcast(stats.join(distinct_table(df, cols), "column")), "column")


def word_count(c):
    """Number of whitespace-separated words; 0 for blank text."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def text_summary(df, cols):
    hashed = df.select(*[F.sha2(col(c).cast("string"), 256).alias(c) for c in cols])
    stats = metric_table(df, cols, {
        "mean_length": lambda c: F.avg(F.length(col(c))),
        "min_length": lambda c: F.min(F.length(col(c))), "max_length": lambda c: F.max(F.length(col(c))),
        "mean_words": lambda c: F.avg(word_count(col(c))), "nulls": lambda c: F.count_if(col(c).isNull()),
    })
    # Whole texts are not shuffled: their hashes are counted.
    return stats.join(distinct_table(hashed, cols), "column")


def date_parts(c):
    """Calendar parts of a timestamp; Monday is 0."""
    ts = col(c)
    return {"year": F.year(ts), "month": F.month(ts), "day_of_week": F.weekday(ts), "hour": F.hour(ts)}


def part_counts(df, cols, parts=("year", "month", "day_of_week", "hour")):
    """(column, part, value, n)"""
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("part"), date_parts(c)[p].alias("value"))
        for c in cols for p in parts
    ]))
    return (
        df.select(entries.alias("_p")).select("_p.*").filter(F.col("value").isNotNull())
        .groupBy("column", "part", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def gap_summary(df, ts):
    """One row of gap statistics in seconds (population and sample deviation)."""
    g = gaps(df, ts)
    s = F.col("gap_seconds")
    stats = g.agg(
        F.min(s).alias("gap_min"), F.max(s).alias("gap_max"), F.avg(s).alias("gap_mean"),
        F.stddev_samp(s).alias("gap_std"), F.stddev_pop(s).alias("gap_std_pop"),
    ).withColumn("column", F.lit(ts))
    median = median_table(g, ["gap_seconds"]).select(F.col("median").alias("gap_median"), F.lit(ts).alias("column"))
    return stats.join(F.broadcast(median), "column")


def datetime_summary(df, cols):
    """Range, interval statistics and calendar distribution of date columns."""
    spans = metric_table(df, cols, {
        "min_ts": lambda c: F.min(col(c)), "max_ts": lambda c: F.max(col(c)),
        "range_days": lambda c: (F.unix_micros(F.max(col(c)).cast("timestamp")) - F.unix_micros(F.min(col(c)).cast("timestamp"))) / 86400e6,
    })
    steps = union_all([gap_summary(df, c) for c in cols]).drop("gap_std_pop")
    return part_counts(df, cols).join(F.broadcast(spans), "column").join(F.broadcast(steps), "column")


def group_statistics(df, cat, num):
    """Count, mean, spread and quartiles of a measure per category."""
    v = as_double(num)
    moments = df.groupBy(cat).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantile_table(df, [num], [.25, .5, .75], [cat]).select(
        F.col(cat).alias("_g"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    return moments.join(q, moments[cat].eqNullSafe(q["_g"])).drop("_g")


def dataset_info(df, roles=None):
    """(section, name, value, percent) facts about a table."""
    cols = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(cols)],
        *[x for i, c in enumerate(datetime_columns(df)) for x in (
            F.date_format(F.min(col(c)), "yyyy-MM-dd HH:mm:ss").alias(f"from_{i}"),
            F.date_format(F.max(col(c)), "yyyy-MM-dd HH:mm:ss").alias(f"to_{i}"))],
    )
    kinds = {}
    for f in df.schema:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    text = lambda e: e.cast("string")
    none = F.lit(None).cast("double")
    share = lambda part, whole: F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))
    fact = lambda s, n, v, p=none: F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.alias("value"), p.alias("percent"))
    nulls = [F.col(f"null_{i}") for i in range(len(cols))]
    total = sum(nulls[1:], nulls[0])
    facts = [
        fact("size", "rows", text(F.col("rows"))), fact("size", "columns", F.lit(str(len(cols)))),
        fact("nulls", "total", text(total), share(total, F.col("rows") * len(cols))),
        fact("nulls", "columns_with_nulls", text(sum([(x > 0).cast("int") for x in nulls[1:]], (nulls[0] > 0).cast("int")))),
        *[fact("nulls", c, text(nulls[i]), share(nulls[i], F.col("rows"))) for i, c in enumerate(cols)],
        *[fact("types", k, F.lit(str(v)), F.lit(100.0 * v / len(cols))) for k, v in kinds.items()],
        *[x for i, c in enumerate(datetime_columns(df)) for x in (
            fact("time_from", c, F.col(f"from_{i}")), fact("time_to", c, F.col(f"to_{i}")))],
    ]
    info = row.select(F.explode(F.array(*facts)).alias("_f")).select("_f.*")
    if roles is not None:
        info = info.unionByName(roles.groupBy("role").count().select(
            F.lit("roles").alias("section"), F.col("role").alias("name"), text(F.col("count")).alias("value"),
            (100.0 * F.col("count") / len(cols)).alias("percent")))
    return info


def column_profile(df, cols):
    """(column, metric, value) facts that suit the kind of each column."""
    num = [c for c in cols if c in numeric_columns(df)]
    text = [c for c in cols if c in string_columns(df)]
    dates = [c for c in cols if c in datetime_columns(df)]
    parts = [_long(metric_table(df, cols, {
        "nulls": lambda c: F.count_if(col(c).isNull())})),
        _long(distinct_table(df, cols).withColumnRenamed("distinct_values", "distinct"))]
    if num:
        q = quantile_table(df, num, [.25, .5, .75]).select(
            "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
        g1 = lambda c: corrected_skew(as_double(c))
        parts.append(_long(metric_table(df, num, {
            "mean": lambda c: F.avg(as_double(c)), "std": lambda c: F.stddev_samp(as_double(c)),
            "min": lambda c: F.min(as_double(c)), "max": lambda c: F.max(as_double(c)),
            "skew": g1, "kurtosis": lambda c: corrected_kurtosis(as_double(c)),
        })))
        parts += [_long(q), _long(iqr_outliers(df, num, 1.5).select("column", F.col("outliers")))]
    if text:
        counts = value_counts(df, text)
        parts.append(_long(metric_table(df, text, {"mean_length": lambda c: F.avg(F.length(col(c)))})))
        totals = counts.groupBy("column").agg((100.0 * F.max("n") / F.sum("n")).alias("top_percent"))
        parts.append(_long(totals))
    for c in dates:
        g = gaps(df, c).agg(
            (F.min("gap_seconds") / 86400).alias("gap_min_days"), (F.avg("gap_seconds") / 86400).alias("gap_mean_days"),
            (F.max("gap_seconds") / 86400).alias("gap_max_days"),
            (F.sum("gap_seconds") / 86400).alias("range_days")).withColumn("column", F.lit(c))
        parts.append(_long(g))
    return union_all(parts)


def _long(df):
    metrics = [c for c in df.columns if c != "column"]
    return df.select("column", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select("column", "_m.*")


def corrected_skew(v):
    """Bias-corrected skewness (G1)."""
    n = F.count(v)
    return F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def corrected_kurtosis(v):
    """Bias-corrected excess kurtosis (G2)."""
    n = F.count(v)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(v) + 6.0))


def fences(df, cols, k):
    """(column, q1, q3, low, high): the k x IQR fences."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return quantile_table(df, cols, [.25, .75]).select(
        "column", q1.alias("q1"), q3.alias("q3"),
        (q1 - k * (q3 - q1)).alias("low"), (q3 + k * (q3 - q1)).alias("high"))


def iqr_outliers(df, cols, k=1.5):
    """(column, q1, q3, low, high, n, outliers, percent): values beyond the fences."""
    f = {r["column"]: r for r in fences(df, cols, k).collect()}
    outside = lambda c: (as_double(c) < F.lit(f[c]["low"])) | (as_double(c) > F.lit(f[c]["high"]))
    t = metric_table(df, cols, {
        "q1": lambda c: F.any_value(F.lit(f[c]["q1"]).cast("double")), "q3": lambda c: F.any_value(F.lit(f[c]["q3"]).cast("double")),
        "low": lambda c: F.any_value(F.lit(f[c]["low"]).cast("double")), "high": lambda c: F.any_value(F.lit(f[c]["high"]).cast("double")),
        "n": lambda c: F.count(as_double(c)), "outliers": lambda c: F.count_if(outside(c)),
    })
    return t.withColumn("percent", F.when(F.col("n") > 0, 100.0 * F.col("outliers") / F.col("n")).otherwise(0.0))


def profile(df, pairs=10):
    """(section, name, metric, value): duplicates, column facts and the strongest correlations."""
    from .statistics import pearson
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    dup = counts.agg(F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_n").alias("rows")).select(F.explode(F.array(
        F.struct(F.lit("duplicate_rows").alias("metric"), F.col("duplicates").cast("double").alias("value")),
        F.struct(F.lit("rows").alias("metric"), F.col("rows").cast("double").alias("value")))).alias("m"))
    out = [dup.select(F.lit("table").alias("section"), F.lit("").alias("name"), "m.*"),
           column_profile(df, df.columns).select(F.lit("column").alias("section"), F.col("column").alias("name"), "metric", "value")]
    num = numeric_columns(df)
    if len(num) > 1:
        top = pearson(df, num).filter(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "a", "b").limit(pairs)
        out.append(top.select(F.lit("correlation").alias("section"), F.col("a").alias("name"), F.col("b").alias("metric"), F.col("r").alias("value")))
    return union_all(out)


def basic_stats(df):
    """Type, nulls, distinct values and, for numbers, range, mean and median."""
    num = numeric_columns(df)
    v = lambda c: as_double(c) if c in num else F.lit(None).cast("double")
    types = dict(df.dtypes)
    t = metric_table(df, df.columns, {
        "type": lambda c: F.any_value(F.lit(types[c])), "nulls": lambda c: F.count_if(col(c).isNull()), "min": lambda c: F.min(v(c)),
        "max": lambda c: F.max(v(c)), "mean": lambda c: F.avg(v(c)),
    }).join(distinct_table(df, df.columns), "column")
    if not num:
        return t.withColumn("median", F.lit(None).cast("double"))
    return t.join(F.broadcast(median_table(df, num).drop("n")), "column", "left")


def partial_profile(df, batch, numeric, categorical):
    """Mergeable partials, one set per batch: sums for numbers, counts for categories."""
    v = as_double
    sums = metric_table(df, numeric, {
        "n": lambda c: F.count(v(c)), "total": lambda c: F.sum(v(c)), "total_sq": lambda c: F.sum(v(c) * v(c)),
        "m2": lambda c: F.var_pop(v(c)) * F.count(v(c)), "low": lambda c: F.min(v(c)), "high": lambda c: F.max(v(c))}, [batch])
    none = lambda t: F.lit(None).cast(t)
    sums = sums.select(F.col(batch).alias("batch"), "column", none("string").alias("value"), "n", "total", "total_sq", "m2", "low", "high")
    counts = value_counts(df, categorical, [batch]).select(
        F.col(batch).alias("batch"), "column", "value", "n",
        *[none("double").alias(c) for c in ("total", "total_sq", "m2", "low", "high")])
    return sums.unionByName(counts)


def merge_numeric(partials):
    """Mean, population deviation and range from any number of partials."""
    p = partials.filter(F.col("value").isNull() & (F.col("n") > 0))
    whole = p.groupBy("column").agg(F.sum("n").alias("_n"), (F.sum("total") / F.sum("n")).alias("_mean"))
    # Squares are taken around the common mean, so a large offset costs no digits.
    far = F.col("total") / F.col("n") - F.col("_mean")
    return p.join(F.broadcast(whole), "column").groupBy("column").agg(
        F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * far * far) / F.first("_n")).alias("std"),
        F.min("low").alias("min"), F.max("high").alias("max"))


def merge_counts(partials, top=10):
    """The most frequent values and the mode from any number of partials."""
    counts = partials.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("n").alias("n"))
    return _top(counts, top).join(F.broadcast(_modes(counts)), "column")


#: Quantile sketches of this size err by less than 0.15% of the ranks, distinct sketches of 2^14 registers by about 1%;
#: counts of frequent items are exact while a column has at most ``TRACKED`` values.
QUANTILE_SIZE = 4096
DISTINCT_BITS = 14
TRACKED = 10_000


def sketch_profile(df, batch, numeric, categorical):
    """Mergeable partials of a fixed size, one row per batch and column: a quantile sketch of numbers, a distinct sketch
    of all values, and a sketch of frequent values of categories. However many values a column has, a partial stays small."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = df.select(col(batch).alias("batch"), *[as_double(c).alias(f"n{i}") for i, c in enumerate(numeric)], *[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categorical)])
    aggs, parts = [], []
    for i, c in enumerate(numeric):
        v = F.col(f"n{i}")
        aggs += [F.count(v).alias(f"n{i}_n"), F.kll_sketch_agg_double(v, QUANTILE_SIZE).alias(f"n{i}_q"), F.hll_sketch_agg(v.cast("string"), DISTINCT_BITS).alias(f"n{i}_d")]
        parts.append((c, f"n{i}", True))
    for i, c in enumerate(categorical):
        aggs += [F.count(f"c{i}").alias(f"c{i}_n"), F.hll_sketch_agg(F.col(f"c{i}"), DISTINCT_BITS).alias(f"c{i}_d"), F.expr(f"approx_top_k_accumulate(c{i}, {TRACKED})").alias(f"c{i}_t")]
        parts.append((c, f"c{i}", False))
    wide = rows.groupBy("batch").agg(*aggs)
    top = next((f.dataType for f in wide.schema if f.name.endswith("_t")), None)
    structs = [F.struct(
        F.lit(c).alias("column"), F.col(f"{p}_n").alias("n"), (F.col(f"{p}_q") if number else none("binary")).alias("quantiles"),
        F.col(f"{p}_d").alias("distinct"), *([(none(top) if number else F.col(f"{p}_t")).alias("top")] if top else [])) for c, p, number in parts]
    return wide.select("batch", F.explode(F.array(*structs)).alias("_p")).select("batch", "_p.*")


def merge_sketches(parts, quantiles=(0.25, 0.5, 0.75)):
    """(column, n, distinct_values, q ARRAY) from any number of partials; q is null for categories."""
    g = parts.groupBy("column").agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("_d"), F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("quantiles"))).alias("_q"))
    number = g.join(F.broadcast(parts.groupBy("column").agg(F.max(F.col("quantiles").isNotNull() & (F.col("n") > 0)).alias("_number"))), "column")
    q = F.array(*[F.kll_sketch_get_quantile_double("_q", F.lit(float(p))) for p in quantiles])
    return number.select("column", "n", F.hll_sketch_estimate("_d").alias("distinct_values"), F.when(F.col("_number"), q).alias("q"))


def merge_top(parts, n=10):
    """(column, value, n, rank) of the most frequent values of the categories, from any number of partials; ties by value."""
    merged = parts.filter("top is not null").groupBy("column").agg(F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("_t"))
    # One more than is asked for would not settle ties: the whole list of tracked values is ranked.
    items = merged.select("column", F.explode(F.expr(f"approx_top_k_estimate(_t, {TRACKED})")).alias("_i")).select("column", F.col("_i.item").alias("value"), F.col("_i.count").alias("n")).filter("value is not null")
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def column_stats(df, cols, bins=10):
    """Statistics with up to ``bins`` equal bins per numeric column; the last bin includes the maximum."""
    stats = metric_table(df, cols, {
        "count": lambda c: F.count(as_double(c)), "missing": lambda c: F.count_if(as_double(c).isNull()),
        "min": lambda c: F.min(as_double(c)), "max": lambda c: F.max(as_double(c)), "mean": lambda c: F.avg(as_double(c)),
        "std": lambda c: F.stddev_pop(as_double(c)),
    }).join(F.broadcast(median_table(df, cols).drop("n")), "column").join(distinct_table(df.select(*[as_double(c).alias(c) for c in cols]), cols), "column")
    known = {r["column"]: r for r in stats.collect() if r["count"]}
    parts = []
    for c, r in known.items():
        k = min(bins, r["distinct_values"])
        lo, hi = r["min"], r["max"] if r["max"] > r["min"] else r["min"] + 1.0
        parts.append(equal_bins(df, c, k, lo, hi).withColumn("column", F.lit(c)))
    names = F.broadcast(df.sparkSession.createDataFrame(
        [tuple(r) for r in known.values()], stats.schema))
    b = union_all(parts).withColumnsRenamed({"lo": "bin_lo", "hi": "bin_hi"})
    return b.join(names, "column")


def top_values(df, cols, n=10):
    return _top(value_counts(df, cols), n)


def portfolio_stats(files, as_of):
    """Number of datasets, rows held, mean quality, and datasets created in the month of ``as_of``."""
    month = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    return files.agg(
        F.count(F.lit(1)).alias("datasets"), F.sum("rows").alias("total_rows"), F.avg("quality").alias("mean_quality"),
        F.count_if(F.date_trunc("month", F.col("created")) == month).alias("created_this_month"))


def grouped_sums(df, dim, measures):
    return df.groupBy(F.coalesce(col(dim).cast("string"), F.lit("Unknown")).alias(dim)).agg(
        *[F.sum(as_double(m)).alias(m) for m in measures], F.count(F.lit(1)).alias("rows"))


def distinct_counts(df, cols, approx=False):
    """Exact distinct counts, or sketches when ``approx``; the result says which."""
    t = metric_table(df, cols, {"distinct_values": lambda c: F.approx_count_distinct(col(c))}) if approx else distinct_table(df, cols)
    return t.withColumn("approximate", F.lit(bool(approx)))


def crosstab(df, a, b, wide=False):
    """Contingency counts, long by default."""
    pairs = df.filter(col(a).isNotNull() & col(b).isNotNull())
    if wide:
        return pairs.groupBy(a).pivot(b).count().na.fill(0)
    return pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df, c):
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * (100.0 / max(df.count(), 1)))


def service_metrics(df, by, ok, latency):
    """Requests, success rate and latency per key, with an overall row under ``ALL``."""
    frame = df.select(col(by).cast("string").alias("key"), ok.alias("_ok"), as_double(latency).alias("latency"))
    both = frame.unionByName(frame.withColumn("key", F.lit("ALL")))
    stats = both.groupBy("key").agg(
        F.count(F.lit(1)).alias("requests"), (100.0 * F.count_if("_ok") / F.count(F.lit(1))).alias("success_rate"),
        F.avg("latency").alias("mean_latency"))
    q = union_all([
        quantile_table(frame, ["latency"], [.5, .95], ["key"]),
        quantile_table(frame, ["latency"], [.5, .95]).withColumn("key", F.lit("ALL")),
    ]).select("key", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))
    return stats.join(q, "key")


def error_digest(df, kind, ts, message, key, n=10):
    """The n most recent messages per kind, with the kind's count."""
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("kind_count"))
    w = Window.partitionBy(kind).orderBy(F.desc(ts), F.desc(key))
    recent = df.select(kind, ts, message, key).withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)
    return recent.join(counts, kind)


def duration_totals(df, kind, duration):
    """Count, total, mean and longest duration per kind."""
    d = as_double(duration)
    return df.groupBy(kind).agg(F.count(d).alias("count"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.max(d).alias("max"))


def common_gaps(df, ts, n=3):
    """The most frequent gaps in whole seconds; ties go to the shorter gap."""
    counts = gaps(df, ts).groupBy(F.round("gap_seconds").cast("long").alias("gap")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("gap")).limit(n)
