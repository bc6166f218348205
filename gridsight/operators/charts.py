"""Chart datasets: small tidy aggregates of whole tables, never drawings."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import statistics as st
from .common import as_double, col, datetime_columns, distinct_table, metric_table, union_all
from .ordered import display_granularity, half_trend, resample
from .profile import binary_summary, bin_edges, bin_index, corrected_kurtosis, corrected_skew, crosstab, equal_bins, fences, group_statistics, likert_summary
from .quantiles import quantile_table
from .relational import sample_grid, sample_n, top_with_others
from .roles import columns_by_role, infer_roles
from .text import bin_label, word_cloud


def histogram(df, c, bins=15):
    """Equal bins with labels, midpoints and local peaks, and the shape of the distribution."""
    _, lo, hi, k = bin_edges(df, c, bins)
    w = Window.orderBy("bin")
    n = F.col("n")
    peak = F.coalesce((n > F.lag("n").over(w)) & (n > F.lead("n").over(w)), F.lit(False))
    shape = df.agg(corrected_skew(as_double(c)).alias("s"), corrected_kurtosis(as_double(c)).alias("k")).first()
    skew, kurt = shape["s"] or 0.0, shape["k"] or 0.0
    kind = "normal" if abs(skew) <= 1 else "right-skewed" if skew > 0 else "left-skewed"
    kind += "" if abs(kurt) <= 1 else " heavy-tailed" if kurt > 0 else " light-tailed"
    b = equal_bins(df, c, k, lo, hi).withColumn("peak", peak)
    return b.select("bin", bin_label(F.col("lo"), F.col("hi")).alias("label"), ((F.col("lo") + F.col("hi")) / 2).alias("midpoint"), "n", "peak",
                    (F.sum(F.col("peak").cast("int")).over(Window.partitionBy()) > 1).alias("multimodal"), F.lit(kind).alias("shape"))


def _shares(counts):
    """Percent of each value and the entropy in bits (also relative to its maximum); bounded by the chart's categories."""
    every = Window.partitionBy()
    p = F.col("n") / F.sum("n").over(every)
    t = counts.withColumn("_p", p)
    entropy = -F.sum(F.col("_p") * F.log2("_p")).over(every)
    most = F.log2(F.count(F.lit(1)).over(every).cast("double"))
    return t.select("value", "n", (100 * F.col("_p")).alias("percent"), entropy.alias("entropy"), F.when(most > 0, entropy / most).otherwise(0.0).alias("balance"))


def category_bars(df, c, n=12):
    """The n-1 largest categories and the rest as Others."""
    return _shares(top_with_others(df, c, n))


def pie(df, c, n=8):
    return category_bars(df, c, n)


def time_line(df, ts, c, granularity="auto", key=None):
    """Mean per period with the trend between the halves of the line (beyond 10%)."""
    if granularity == "auto":
        granularity = display_granularity(df, ts).first()["granularity"]
    line = resample(df, ts, c, {"hourly": "h", "daily": "d", "weekly": "w", "monthly": "m"}[granularity])
    t = half_trend(line.withColumn("_k", F.col("ts")), "ts", "value", "_k").first()
    change = t["change_percent"] or 0.0
    trend = "increasing" if change > 10 else "decreasing" if change < -10 else "stable"
    return line.select("ts", "value", F.lit(granularity).alias("granularity"), F.lit(trend).alias("trend"))


def correlation_heatmap(df, cols):
    """Every ordered pair of columns with r to 2 digits."""
    r = F.round("r", 2)
    pairs = st.pearson(df, cols).select("a", "b", r.alias("r"))
    mirror = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, r double")
    return union_all([pairs, mirror, own]).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("r").alias("value"))


def scatter(df, x, y, key, n=5000):
    """At most n hash-chosen points with r, rho and the kind of relation measured on all rows."""
    rows = df.select(key, as_double(x).alias("x"), as_double(y).alias("y")).dropna()
    r = st.pearson(rows, ["x", "y"]).first()["r"]
    rho = st.spearman(rows, ["x", "y"]).first()["rho"]
    kind = st.polynomial_fit(rows, "x", "y").first()["relationship"]
    if kind == "linear" and abs(rho or 0) > abs(r or 0) + 0.2:
        kind = "non-linear"
    return sample_n(rows, n, key).withColumns({"r": F.lit(r).cast("double"), "rho": F.lit(rho).cast("double"), "relationship": F.lit(kind)})


def group_means(df, cat, num, n=10):
    """Mean, spread and count of the n largest groups by mean, with the analysis of variance over all groups."""
    f = st.anova(df, cat, num).first()
    g = group_statistics(df, cat, num).select(cat, "mean", "std", "median", "count")
    top = g.orderBy(F.desc("mean"), cat).limit(n)
    every = Window.partitionBy()
    spread = F.max("mean").over(every) - F.min("mean").over(every)
    return top.withColumns({
        "f_statistic": F.lit(f["f_statistic"]).cast("double"), "significant": F.lit(bool(f["p_value"] is not None and f["p_value"] < 0.05)),
        "magnitude_percent": F.when(F.avg("mean").over(every) != 0, 100 * spread / F.abs(F.avg("mean").over(every)))})


def box_plot(df, c, max_outliers=50):
    """(kind, name, value): whiskers, quartiles and the most distant outliers of each side."""
    v = as_double(c)
    q1, mid, q3 = quantile_table(df, [c], [.25, .5, .75]).first()["q"]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    ends = df.agg(F.min(F.when(v >= low, v)).alias("lo"), F.max(F.when(v <= high, v)).alias("hi")).first()
    parts = [("lower_whisker", ends["lo"]), ("q1", q1), ("median", mid), ("q3", q3), ("upper_whisker", ends["hi"])]
    box = df.sparkSession.createDataFrame([("box", k, float(x)) for k, x in parts], "kind string, name string, value double")
    side = lambda cond, order, name: df.filter(cond).select(F.lit("outlier").alias("kind"), F.lit(name).alias("name"), v.alias("value")).orderBy(order).limit(max_outliers)
    return union_all([box, side(v < low, F.asc("value"), "low"), side(v > high, F.desc("value"), "high")])


def grouped_histogram(df, cat, num, bins=10):
    """Shared bins with the percent of each category in each bin, and the test between categories."""
    _, lo, hi, k = bin_edges(df, num, bins)
    counts = df.select(col(cat).alias("category"), as_double(num).alias("_v")).dropna().groupBy("category", bin_index(F.col("_v"), lo, hi, k).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("category").agg(F.sum("n").alias("total"))
    width = (hi - lo) / k
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    pair = distinct_table(df, [cat]).first()["distinct_values"] == 2
    test = st.welch_t(df, cat, num).first() if pair else st.anova(df, cat, num, drop_constant=False).first()
    p = test["p_value"] if test else None
    return grid.join(counts, ["category", "bin"], "left").select(
        "category", "bin", bin_label(F.lit(lo) + F.col("bin") * width, F.lit(lo) + (F.col("bin") + 1) * width).alias("label"),
        (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("percent"),
        F.lit("t-test" if pair else "ANOVA").alias("test"), F.lit(bool(p is not None and p < 0.05)).alias("significant"))


def likert_bars(df, c):
    return likert_summary(df, [c]).select("value", "n", "percent", "mean", "median")


def binary_bars(df, c):
    return binary_summary(df, [c]).drop("column")


def word_cloud_data(df, c):
    return word_cloud(df, c).select(F.col("word").alias("text"), F.col("n").alias("value"))


def text_length_histogram(df, c):
    return histogram(df.select(F.length(col(c)).alias(f"{c}_length")), f"{c}_length")


def range_bars(df, c):
    return category_bars(df, c)


def likert_heatmap(df, cols):
    return correlation_heatmap(df, cols)


def category_heatmap(df, a, b):
    return crosstab(df, a, b).withColumnsRenamed({a: "x", b: "y", "n": "value"})


def _edges(df, x, y):
    return df.agg(F.min(as_double(x)).alias("x0"), F.max(as_double(x)).alias("x1"), F.min(as_double(y)).alias("y0"), F.max(as_double(y)).alias("y1"), F.count(F.lit(1)).alias("n")).first()


def hexbin(df, x, y, bins=20):
    """Counts on a bins x bins grid whose odd rows are shifted by half a cell."""
    e = _edges(df, x, y)
    dx, dy = ((e["x1"] - e["x0"]) / bins) or 1.0, ((e["y1"] - e["y0"]) / bins) or 1.0
    cells = df.select(as_double(x).alias("_x"), as_double(y).alias("_y")).dropna().groupBy(
        F.floor((F.col("_x") - e["x0"]) / dx).alias("i"), F.floor((F.col("_y") - e["y0"]) / dy).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    shift = F.when(F.col("j") % 2 == 0, 0.0).otherwise(0.5)
    return cells.select((F.lit(e["x0"]) + (F.col("i") + shift) * dx + dx / 2).alias("x"), (F.lit(e["y0"]) + F.col("j") * dy + dy / 2).alias("y"), "n")


def density_grid(df, x, y):
    """Counts and point sizes (1 to 10) on a square grid of min(50, sqrt(n / 5)) cells a side."""
    e = _edges(df, x, y)
    k = max(1, min(50, math.ceil(math.sqrt(e["n"] / 5))))
    dx, dy = ((e["x1"] - e["x0"]) / k) or 1.0, ((e["y1"] - e["y0"]) / k) or 1.0
    cells = df.select(as_double(x).alias("_x"), as_double(y).alias("_y")).dropna().groupBy(
        F.floor((F.col("_x") - e["x0"]) / dx).alias("i"), F.floor((F.col("_y") - e["y0"]) / dy).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(1), F.ceil(10.0 * F.col("n") / F.max("n").over(Window.partitionBy()))).cast("int")
    return cells.select((F.lit(e["x0"]) + (F.col("i") + 0.5) * dx).alias("x"), (F.lit(e["y0"]) + (F.col("j") + 0.5) * dy).alias("y"), "n", size.alias("size"))


def sankey(df, a, b):
    """(nodes, links) of a pair of categories; a value on both sides is one node."""
    from .relational import link_endpoints
    links = crosstab(df, a, b).select(col(a).cast("string").alias("source"), col(b).cast("string").alias("target"), F.col("n").alias("value"))
    return link_endpoints(links), links


def network(links):
    """(nodes, links): weighted degree and number of neighbours of each node."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.col("value")),
        F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.col("value")))).alias("_e")).select("_e.*")
    merged = ends.groupBy("node", "other").agg(F.sum("value").alias("value"))
    return merged.groupBy("node").agg(F.sum("value").alias("degree"), F.count(F.lit(1)).alias("neighbours")), links


def neighbours(links, node):
    """The nodes linked with one node."""
    other = F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))
    return links.filter((F.col("source") == node) | (F.col("target") == node)).select(other.alias("node")).distinct()


def waterfall_chart(df, name, value, pos):
    from .ordered import waterfall
    return waterfall(df, name, value, pos)


def treemap(df, name, value):
    """Summed value per name with its place between the smallest and the largest."""
    g = df.groupBy(F.coalesce(col(name).cast("string"), F.lit("")).alias("name")).agg(F.sum(F.coalesce(as_double(value), F.lit(0.0))).alias("value"))
    every = Window.partitionBy()
    lo, hi = F.min("value").over(every), F.max("value").over(every)
    return g.withColumn("scale", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(0.0))


def heatmap_matrix(df, x, y, value, correlation=False):
    """Cells scaled between the smallest and largest value, or between -1 and 1 for correlations."""
    v = F.coalesce(as_double(value), F.lit(0.0))
    cells = df.select(col(x).alias("x"), col(y).alias("y"), v.alias("value"))
    e = {"lo": -1.0, "hi": 1.0} if correlation else cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first().asDict()
    span = (e["hi"] or 0.0) - (e["lo"] or 0.0)
    return cells.withColumn("scale", (F.col("value") - F.lit(e["lo"])) / span if span else F.lit(0.0))


def donut(df, name, value):
    g = df.groupBy(col(name).cast("string").alias("name")).agg(F.sum(as_double(value)).alias("value"))
    total = F.sum("value").over(Window.partitionBy())
    return g.select("name", "value", total.alias("total"), F.when(total != 0, 100 * F.col("value") / total).otherwise(0.0).alias("percent"))


def bubble(df, x, y, size, n, key):
    """Grid-representative points with a size of at least 0.1."""
    rows = df.select(key, as_double(x).alias("x"), as_double(y).alias("y"), F.greatest(F.coalesce(as_double(size), F.lit(1.0)), F.lit(0.1)).alias("size")).dropna()
    return sample_grid(rows, "x", "y", n, key)


def gantt(df, start, end, group, name):
    """Group headers (position 0) followed by the group's tasks in order of start."""
    rows = df.select(F.coalesce(col(group).cast("string"), F.lit("Default")).alias("group"), col(name).cast("string").alias("name"), col(start).alias("start"), col(end).alias("end"))
    head = rows.groupBy("group").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("group", F.lit(None).cast("string").alias("name"), "start", "end", F.lit(True).alias("header"))
    return head.unionByName(rows.withColumn("header", F.lit(False))).withColumn(
        "hours", (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 3.6e9).orderBy("group", F.desc("header"), "start", "name")


def forecast_line(forecast):
    """Forecast points with their bounds, one row per series and step."""
    return forecast.select("series_id", "step", "ts", "forecast", "lower", "upper")


def pca_scatter(df, cols, key, n=1000):
    from .learn import pca
    from .ordered import hash_rank
    scores, _ = pca(df, cols, k=2)
    return scores.orderBy(hash_rank(col(key))).limit(n).select(key, "pc1", "pc2")


def _one(fn):
    return lambda df, c, key: fn(df, *c)


CHARTS = {
    "histogram": _one(histogram), "bar": lambda df, c, key: group_means(df, *c) if len(c) == 2 else category_bars(df, *c), "pie": _one(pie),
    "line": _one(time_line), "area": _one(time_line), "heatmap": _one(category_heatmap), "correlation": lambda df, c, key: correlation_heatmap(df, c),
    "scatter": lambda df, c, key: scatter(df, *c, key), "bubble": lambda df, c, key: bubble(df, *c, 5000, key), "box": _one(box_plot),
    "grouped_histogram": _one(grouped_histogram), "likert": _one(likert_bars), "binary": _one(binary_bars), "word_cloud": _one(word_cloud_data),
    "text_length": _one(text_length_histogram), "range": _one(range_bars), "hexbin": _one(hexbin), "density": _one(density_grid),
    "sankey": lambda df, c, key: sankey(df, *c)[1], "network": lambda df, c, key: network(sankey(df, *c)[1])[0], "treemap": _one(treemap), "donut": _one(donut),
    "pca": lambda df, c, key: pca_scatter(df, c, key),
}


def chart(df, chart_type, cols, key=None):
    """One chart dataset by type and columns; ``key`` names the row key where points are chosen."""
    return CHARTS[chart_type](df, list(cols), key)


def automatic_charts(df, key, n=8, roles=None):
    """{name: dataset} of the n charts that suit the table's roles best; ``n=None`` builds all of them.

    Columns compete by what is measured on all of them: variance, distinct values, correlation and outliers. ``roles`` are
    those of the table, if known already.
    """
    by = columns_by_role(infer_roles(df) if roles is None else roles)
    num, cats, dates = by.get("numeric", []), by.get("categorical", []), by.get("datetime", [])
    likert, text = by.get("likert", []), by.get("text", [])
    facts = {r["column"]: r["distinct_values"] for r in distinct_table(df, cats).collect()} if cats else {}
    picks = []
    if num:
        var = {r["column"]: r["v"] or 0.0 for r in metric_table(df, num, {"v": lambda c: F.var_samp(as_double(c))}).collect()}
        num = sorted(num, key=lambda c: (-var[c], c))
        picks += [("histogram", [c]) for c in num[:2]]
    small_cats = sorted((c for c in cats if facts[c] <= 8), key=lambda c: (facts[c], c))
    picks += [("pie", [c]) for c in (by.get("gender", []) or small_cats)[:1]]
    picks += [("bar", [c]) for c in sorted((c for c in cats if facts[c] <= 15), key=lambda c: (-facts[c], c))[:1]]
    picks += [("line", [dates[0], num[0]])] if dates and num else []
    if len(num) >= 2:
        best = st.pearson(df, num).orderBy(F.desc_nulls_last(F.abs("r")), "a", "b").first()
        picks.append(("scatter", [best["a"], best["b"]] if best["r"] is not None and abs(best["r"]) > 0.5 else num[:2]))
    picks += [("bar", [c, num[0]]) for c in cats if num and 2 <= facts[c] <= 10][:1]
    picks += [("correlation", num)] if len(num) >= 3 else []
    if num:
        f = {r["column"]: r for r in fences(df, num, 1.5).collect()}
        out = df.agg(*[F.count_if((as_double(c) < f[c]["low"]) | (as_double(c) > f[c]["high"])).alias(f"o{i}") for i, c in enumerate(num)]).first()
        picks += [("box", [c]) for _, c in sorted((-out[i], c) for i, c in enumerate(num) if out[i] > 0)[:1]]
    picks += [("grouped_histogram", [c, num[0]]) for c in cats if num and facts[c] == 2][:1]
    picks += [("likert", [c]) for c in likert] + [("binary", [c]) for c in by.get("binary", [])]
    picks += [("text_length", [c]) for c in text] + [("range", [c]) for c in by.get("range", [])]
    picks += [("correlation", likert)] if len(likert) >= 2 else []
    picks += [("word_cloud", [c]) for c in text]
    return {f"{t}:{','.join(c)}": chart(df, t, c, key) for t, c in picks[:n]}


def chart_sizes(charts):
    """(name, points) of a set of charts."""
    return union_all([d.agg(F.count(F.lit(1)).alias("points")).select(F.lit(name).alias("name"), "points") for name, d in charts.items()])
