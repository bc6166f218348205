"""Chart recommendations: rules over evidence tables, one row of evidence per column or group of columns.

Evidence for all columns (or pairs) of a kind comes from one wide job, and the rules run on that small table.
"""
import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chart_rules as rules
from ..functions.special import p_value
from . import statistics as st
from ..session import pin
from .common import as_double, col, datetime_columns, distinct_table, metric_table, union_all, value_counts
from .dates import date_difference
from .ordered import with_row_index
from .profile import corrected_skew, iqr_outliers
from .roles import columns_by_role, infer_roles


def apply_rules(evidence, rule_set, family):
    """(columns, chart_type, score, category, subcategory, complexity, description) for the rules that hold."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(F.expr(cond), F.lit(False)), F.struct(
            F.lit(kind).alias("chart_type"), F.round(F.expr(score).cast("double"), 4).alias("score"), F.lit(cat).alias("category"), F.lit(sub or "standard").alias("subcategory"),
            F.lit(level).alias("complexity"), F.concat(F.lit(f"{kind.replace('_', ' ')} ({family}): "), F.array_join("columns", ", ")).alias("description")))
        for kind, cat, sub, level, cond, score in rule_set]))
    return evidence.select("columns", F.explode(found).alias("_r")).select("columns", "_r.*")


def _single(t):
    return t.withColumn("columns", F.array("column")).drop("column")


# ---- evidence


def numeric_evidence(df, cols):
    t = metric_table(df, cols, {"rows": lambda c: F.count(F.lit(1)), "non_null": lambda c: F.count(as_double(c)), "skew": lambda c: corrected_skew(as_double(c))})
    out = iqr_outliers(df, cols, 1.5).select("column", F.col("percent").alias("outlier_percent"))
    t = t.join(F.broadcast(out), "column").join(distinct_table(df, cols), "column")
    return _single(t.withColumns({"distinct_ratio": F.col("distinct_values") / F.col("rows"), "null_percent": 100.0 * (F.col("rows") - F.col("non_null")) / F.col("rows")}).drop("non_null", "distinct_values"))


def category_evidence(df, cols):
    """k and the share of the top value."""
    return _single(value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("k"), (F.max("n") / F.sum("n")).alias("top_share")))


def datetime_evidence(df, cols):
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    span = metric_table(df, cols, {"range_days": lambda c: (F.max(micros(c)) - F.min(micros(c))) / 86400e6})
    months = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.month(col(c)).alias("m")) for c in cols])).alias("_s")).select("_s.*").filter("m IS NOT NULL")
    cv = months.groupBy("column", "m").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg((F.stddev_samp("n") / F.avg("n")).alias("month_cv"))
    return _single(span.join(F.broadcast(cv), "column", "left"))


def likert_evidence(df, cols):
    return _single(distinct_table(df, cols).select("column", F.col("distinct_values").alias("points")))


def text_evidence(df, cols):
    return _single(metric_table(df, cols, {"mean_length": lambda c: F.avg(F.length(col(c)))}))


def numeric_pairs(df, cols):
    t = st.pair_table(df, st.column_pairs(cols), {"rows": lambda a, b: F.count(F.lit(1)), "r": lambda a, b: st.clean_corr(as_double(a), as_double(b))})
    return t.withColumn("columns", F.array("a", "b")).drop("a", "b")


def group_moments(df, cats, nums):
    """(cat, num, group, n, m, v): moments of every measure in every group of every category, in one job."""
    stacked = df.select(*[as_double(n).alias(f"v{i}") for i, n in enumerate(nums)], F.explode(F.array(*[
        F.struct(F.lit(c).alias("cat"), col(c).cast("string").alias("group")) for c in cats])).alias("_c")).select("*", "_c.*").drop("_c").filter(F.col("group").isNotNull())
    g = stacked.groupBy("cat", "group").agg(*[x for i in range(len(nums)) for x in (F.count(f"v{i}").alias(f"n{i}"), F.avg(f"v{i}").alias(f"m{i}"), F.var_samp(f"v{i}").alias(f"s{i}"))])
    return g.select("cat", "group", F.explode(F.array(*[
        F.struct(F.lit(c).alias("num"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"s{i}").alias("v")) for i, c in enumerate(nums)])).alias("_m")).select("cat", "group", "_m.*").filter("n > 0")


def category_numeric_pairs(df, cats, nums):
    g = group_moments(df, cats, nums)
    n, m = F.col("n"), F.col("m")
    t = g.groupBy("cat", "num").agg(
        F.count(F.lit(1)).alias("k"), (F.stddev_samp("m") / F.when(F.avg("m") != 0, F.avg("m"))).alias("cv"), F.min("n").alias("smallest"), F.sum("n").alias("t"),
        (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)).alias("between"), F.sum((n - 1) * F.coalesce("v", F.lit(0.0))).alias("within"))
    d1, d2 = F.col("k") - 1, F.col("t") - F.col("k")
    f = F.when((d1 > 0) & (d2 > 0) & (F.col("within") > 0), (F.col("between") / d1) / (F.col("within") / d2))
    significant = (F.col("k") >= 3) & (F.col("smallest") >= 5) & (p_value("f", f, d1, d2) < 0.05)
    return t.select(F.array("cat", "num").alias("columns"), "k", "cv", F.coalesce(significant, F.lit(False)).alias("significant"))


def chi_square_pairs(df, pairs):
    """(a, b, k1, k2, p) of many category pairs from one count of all their cells."""
    entry = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), col(a).cast("string").alias("x"), col(b).cast("string").alias("y"))
    cells = df.select(F.explode(F.array(*[entry(a, b) for a, b in pairs])).alias("_p")).select("_p.*").dropna().groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("a", "b", *k))
    c = cells.withColumns({"r": over("x"), "c": over("y"), "t": over()})
    e = F.col("r") * F.col("c") / F.col("t")
    g = c.withColumn("e", e).groupBy("a", "b").agg(
        F.count_distinct("x").alias("k1"), F.count_distinct("y").alias("k2"), F.first("t").alias("t"), F.sum("e").alias("seen"), F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).alias("plain"),
        F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("e")) - 0.5, F.lit(0.0)), 2) / F.col("e")).alias("yates"))
    df_ = (F.col("k1") - 1) * (F.col("k2") - 1)
    chi = F.when(df_ == 1, F.col("yates")).otherwise(F.col("plain") + F.col("t") - F.col("seen"))
    return g.select("a", "b", "k1", "k2", F.when(df_ > 0, p_value("chi2", chi, df_)).alias("p"))


def category_pairs(df, cats):
    return chi_square_pairs(df, st.column_pairs(cats)).select(F.array("a", "b").alias("columns"), "k1", "k2", "p")


def datetime_category_pairs(df, dates, cats):
    marked = df.withColumns({f"_dow_{i}": F.weekday(col(d)) for i, d in enumerate(dates)})
    t = chi_square_pairs(marked, [(f"_dow_{i}", c) for i in range(len(dates)) for c in cats])
    names = F.create_map(*[x for i, d in enumerate(dates) for x in (F.lit(f"_dow_{i}"), F.lit(d))])
    return t.select(F.array(names[F.col("a")], F.col("b")).alias("columns"), F.col("k2").alias("k"), "p")


def datetime_numeric_pairs(df, dates, nums, key):
    """Change from the first to the last quarter of the rows in time order; one ordering per date column."""
    parts = []
    for d in dates:
        rows = df.filter(col(d).isNotNull()).select(key, d, *[n for n in nums if n not in (key, d)])
        indexed, n = with_row_index(rows, [d, key]), rows.count()
        q, i = max(n // 4, 1), F.col("row_index")
        t = metric_table(indexed, nums, {
            "rows": lambda c: F.count(F.lit(1)), "lo": lambda c: F.avg(F.when(i < q, as_double(c))), "hi": lambda c: F.avg(F.when(i >= n - q, as_double(c))),
            "range_days": lambda c: (F.unix_micros(F.max(d).cast("timestamp")) - F.unix_micros(F.min(d).cast("timestamp"))) / 86400e6})
        change = F.when(F.col("lo") != 0, (F.col("hi") - F.col("lo")) / F.abs("lo") * 100)
        parts.append(t.select(F.array(F.lit(d), F.col("column")).alias("columns"), "rows", "range_days", change.alias("change_percent")))
    return union_all(parts)


def datetime_pairs(df, dates):
    return union_all([date_difference(df, a, b).select(F.array(F.lit(a), F.lit(b)).alias("columns"), "consistent") for a, b in st.column_pairs(dates)])


def binary_numeric_pairs(df, bins, nums):
    g = group_moments(df, bins, nums)
    pick = lambda fn, c: fn(F.col(c), F.col("group"))
    t = g.groupBy("cat", "num").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"), *[pick(fn, c).alias(f"{c}{i}") for i, fn in ((1, F.min_by), (2, F.max_by)) for c in ("n", "m", "v")])
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    stat = (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)
    dof = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    ok = (F.col("k") == 2) & (F.col("smallest") > 1) & (e1 + e2 > 0)
    return t.select(F.array("cat", "num").alias("columns"), "smallest", p_value("t", F.when(ok, stat), F.when(ok, dof)).alias("p"))


def _by_category(df, cats, *kept):
    """The rows once per category column: (cat, group, kept...), null groups left out."""
    first = df.select(*[col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(cats)], *kept)
    groups = F.explode(F.array(*[F.struct(F.lit(c).alias("cat"), F.col(f"_c{i}").alias("group")) for i, c in enumerate(cats)])).alias("_g")
    rest = [c for c in first.columns if c not in {f"_c{i}" for i in range(len(cats))}]
    return first.select(groups, *rest).select("_g.*", *rest).filter(F.col("group").isNotNull())


def numeric_datetime_categories(df, nums, dates, cats, key):
    """Whether the groups of a category part, some rising and some falling by over 20% from their first to their last
    quarter, for every (number, date, category) in one pass: rows are numbered once within all groups side by side."""
    measures = F.explode(F.array(*[F.struct(F.lit(n).alias("num"), F.lit(d).alias("date"), as_double(n).alias("value"), col(d).cast("timestamp").alias("at")) for n in nums for d in dates])).alias("_m")
    long = _by_category(df, cats, measures, col(key).alias("_key")).select("cat", "group", "_m.*", "_key").dropna()
    by = ["num", "date", "cat", "group"]
    indexed = with_row_index(long, ["at", "_key"], by)
    sizes = indexed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n >= 8")
    i, k = F.col("row_index"), F.floor(F.col("n") / 4)
    g = indexed.join(sizes, by).groupBy(*by).agg(F.avg(F.when(i < k, F.col("value"))).alias("early"), F.avg(F.when(i >= F.col("n") - k, F.col("value"))).alias("late"))
    change = F.when(F.col("early") != 0, (F.col("late") - F.col("early")) / F.abs("early") * 100).otherwise(0.0)
    part = g.groupBy("num", "date", "cat").agg(((F.max(change) > 20) & (F.min(change) < -20)).alias("diverging"))
    kinds = df.sparkSession.createDataFrame([(n, d, c) for n in nums for d in dates for c in cats], "num string, date string, cat string")
    counts = distinct_table(df, cats).select(F.col("column").alias("cat"), F.col("distinct_values").alias("k"))
    both = kinds.join(F.broadcast(counts), "cat").join(part, ["num", "date", "cat"], "left")
    return both.select(F.array("num", "date", "cat").alias("columns"), "k", F.coalesce("diverging", F.lit(False)).alias("diverging"))


def numeric_datetime_category(df, num, date, cat, key):
    return numeric_datetime_categories(df, [num], [date], [cat], key)


def two_numeric_categories(df, pairs, cats):
    """Span of the correlation across the groups (of at least 10 rows) of each category, for many pairs in one pass."""
    nums = sorted({c for pair in pairs for c in pair})
    long = _by_category(df, cats, *[as_double(c).alias(f"v{i}") for i, c in enumerate(nums)])
    at = {c: F.col(f"v{i}") for i, c in enumerate(nums)}
    g = long.groupBy("cat", "group").agg(F.count(F.lit(1)).alias("n"), *[st.clean_corr(at[a], at[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    big = lambda i: F.when(F.col("n") >= 10, F.col(f"r{i}"))
    row = g.groupBy("cat").agg(F.count(F.lit(1)).alias("k"), *[(F.max(big(i)) - F.min(big(i))).alias(f"s{i}") for i in range(len(pairs))])
    spans = F.array(*[F.struct(F.array(F.lit(a), F.lit(b), F.col("cat")).alias("columns"), F.col(f"s{i}").alias("span")) for i, (a, b) in enumerate(pairs)])
    return row.select("k", F.explode(spans).alias("_s")).select("k", "_s.*")


def two_numeric_category(df, pairs, cat):
    return two_numeric_categories(df, pairs, [cat])


def numeric_triples(df, cols):
    r = {frozenset((x["a"], x["b"])): abs(x["r"] or 0.0) for x in st.pearson(df, cols).collect()}
    rows = [(list(t), any(r[frozenset(p)] > 0.7 for p in itertools.combinations(t, 2))) for t in itertools.combinations(cols, 3)]
    return df.sparkSession.createDataFrame(rows, "columns array<string>, strong boolean")


def correlation_evidence(df, cols):
    found = st.pearson(df, cols)
    pairs = df.sparkSession.createDataFrame(found.collect(), found.schema)  # a row per pair of columns
    strong = pairs.filter("abs(r) > 0.7").count()
    grouped = not st.multicollinear_groups(pairs).isEmpty()
    return df.sparkSession.createDataFrame([(list(cols), strong, grouped)], "columns array<string>, strong_pairs int, grouped boolean")


def series_evidence(df, date, cols):
    """Time span and the season's deviation over the residual's, of the measure where it is largest."""
    from .series import decompose, stack_series
    days = datetime_evidence(df, [date]).first()["range_days"] or 0.0
    ratio = None
    if days > 60:
        freq, period = ("d", 7) if days < 180 else ("w", 52) if days < 900 else ("m", 12)
        parts = decompose(stack_series(df, [date], cols, freq), period)
        each = parts.groupBy("series_id").agg((F.stddev_samp("seasonal") / F.nullif(F.stddev_samp("residual"), F.lit(0.0))).alias("x"))
        ratio = each.agg(F.max("x").alias("x")).first()["x"]
    return df.sparkSession.createDataFrame([([date, *cols], float(days), ratio)], "columns array<string>, range_days double, seasonal_ratio double")


# ---- recommendations


def recommend_charts(df, key, cols=None):
    """All recommendations for single columns, pairs, triples and the whole table."""
    by = {r: [c for c in cs if cols is None or c in cols] for r, cs in columns_by_role(infer_roles(df)).items()}
    num, cats = by.get("numeric", []), by.get("categorical", []) + by.get("gender", [])
    dates = [c for c in by.get("datetime", []) if c in datetime_columns(df)]
    bins, likert, text, ranges = (by.get(r, []) for r in ("binary", "likert", "text", "range"))
    pairs = [*itertools.combinations(num, 2)]
    jobs = [
        (num, lambda: numeric_evidence(df, num), rules.NUMERIC, "numeric"), (cats, lambda: category_evidence(df, cats), rules.CATEGORICAL, "categorical"),
        (dates, lambda: datetime_evidence(df, dates), rules.DATETIME, "datetime"), (likert, lambda: likert_evidence(df, likert), rules.LIKERT, "likert"),
        (bins, lambda: category_evidence(df, bins), rules.BINARY, "binary"), (text, lambda: text_evidence(df, text), rules.TEXT, "text"),
        (ranges, lambda: category_evidence(df, ranges), rules.RANGE, "range"), (pairs, lambda: numeric_pairs(df, num), rules.NUMERIC_NUMERIC, "numeric by numeric"),
        (cats and num, lambda: category_numeric_pairs(df, cats, num), rules.CATEGORICAL_NUMERIC, "categorical by numeric"),
        (dates and num, lambda: datetime_numeric_pairs(df, dates, num, key), rules.DATETIME_NUMERIC, "datetime by numeric"),
        (cats[1:], lambda: category_pairs(df, cats), rules.CATEGORICAL_CATEGORICAL, "categorical by categorical"), (dates[1:], lambda: datetime_pairs(df, dates), rules.DATETIME_DATETIME, "datetime by datetime"),
        (dates and cats, lambda: datetime_category_pairs(df, dates, cats), rules.DATETIME_CATEGORICAL, "datetime by categorical"),
        (bins and num, lambda: binary_numeric_pairs(df, bins, num), rules.BINARY_NUMERIC, "binary by numeric"),
        (likert[1:], lambda: numeric_pairs(df, likert), rules.LIKERT_LIKERT, "likert by likert"),
        (num[2:], lambda: numeric_triples(df, num), rules.THREE_NUMERIC, "three numeric"), (num[2:], lambda: correlation_evidence(df, num), rules.CORRELATION, "correlation"),
    ]
    jobs += [(num[1:], lambda d=d: series_evidence(df, d, num), rules.SERIES, "time series") for d in dates]
    jobs += [
        (num and dates and cats, lambda: numeric_datetime_categories(df, num, dates, cats, key), rules.NUMERIC_DATETIME_CATEGORICAL, "numeric, datetime and categorical"),
        (pairs and cats, lambda: two_numeric_categories(df, pairs, cats), rules.TWO_NUMERIC_CATEGORICAL, "two numeric by categorical")]
    return union_all([apply_rules(evidence(), rule_set, family) for wanted, evidence, rule_set, family in jobs if wanted])


def best_charts(recs, quality=80.0, k=6):
    """The k best and most varied: first of each chart type, then new categories, one complex chart, then by score."""
    scaled = recs.withColumn("score", F.round(F.col("score") * F.lit(0.8 + quality / 500), 4))
    w = Window.partitionBy("chart_type", "category", "complexity").orderBy(F.desc("score"), F.array_join("columns", ","), "subcategory")
    # Each list is cut to what the greedy fill could use, so a handful of rows reach the driver.
    rows = scaled.withColumn("_first", F.row_number().over(w)).filter(F.col("_first") <= 2 * k).collect()
    order = sorted(rows, key=lambda r: (-r["score"], r["chart_type"], ",".join(r["columns"]), r["subcategory"]))
    chosen, types, cats = [], set(), set()

    def take(r):
        chosen.append(r)
        types.add(r["chart_type"])
        cats.add(r["category"])

    for fresh in (lambda r: r["chart_type"] not in types, lambda r: r["category"] not in cats):
        for r in order:
            if len(chosen) < k and r not in chosen and fresh(r):
                take(r)
    if len(chosen) < k and not any(r["complexity"] == "high" for r in chosen):
        for r in [r for r in order if r["complexity"] == "high" and r not in chosen][:1]:
            take(r)
    for r in order:
        if len(chosen) < k and r not in chosen:
            take(r)
    chosen.sort(key=lambda r: (-r["score"], r["chart_type"], ",".join(r["columns"]), r["subcategory"]))
    return recs.sparkSession.createDataFrame([(i, *[r[c] for c in recs.columns]) for i, r in enumerate(chosen, 1)],
                                             "position int, " + ", ".join(f"{n} {t}" for n, t in recs.dtypes))


# Kinds of columns (number, date, other) that each chart dataset takes.
BUILDABLE = {
    "histogram": ["n"], "box": ["n"], "pie": ["o"], "bar": ["o", "on"], "line": ["dn"], "area": ["dn"], "scatter": ["nn"], "hexbin": ["nn"], "heatmap": ["oo"], "sankey": ["oo"],
    "network": ["oo"], "grouped_histogram": ["on"], "bubble": ["nnn"], "word_cloud": ["o"], "range": ["o"], "likert": ["n"], "donut": ["on"], "treemap": ["on"],
}


def build_charts(df, key, k=6, quality=80.0):
    """{name: dataset} of the best charts that have a dataset of their own."""
    from .charts import chart
    from .common import numeric_columns
    num, dates = set(numeric_columns(df)), set(datetime_columns(df))
    kind = lambda c: "n" if c in num else "d" if c in dates else "o"
    recs = pin(recommend_charts(df, key))
    # The best are chosen among those with a dataset: one small table of types and columns decides which.
    seen = recs.select("chart_type", "columns").distinct().collect()
    fit = [r for r in seen if "".join(map(kind, r["columns"])) in BUILDABLE.get(r["chart_type"], [])]
    able = recs.join(F.broadcast(df.sparkSession.createDataFrame(fit, "chart_type string, columns array<string>")), ["chart_type", "columns"], "left_semi").select(recs.columns)
    chosen = best_charts(able, quality, k).orderBy("position").collect()
    return {f"{r['chart_type']}:{','.join(r['columns'])}": chart(df, r["chart_type"], list(r["columns"]), key) for r in chosen}
