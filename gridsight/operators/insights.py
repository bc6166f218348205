"""Ranked findings. Statistics come from the profile and test operators; texts are expressions over those small tables."""

# The wording of all sentences below; results must agree on it.
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import statistics as st
from .common import as_double, col, datetime_columns, metric_table, union_all, value_counts
from .ordered import half_trend
from .profile import _top, binary_summary, column_profile, corrected_skew, dataset_info, iqr_outliers, likert_summary, numeric_summary, range_bounds, word_count
from .quantiles import median_table
from .roles import columns_by_role, infer_roles
from .text import common_words, gender_shares

SCHEMA = "type string, title string, content string, importance double, columns array<string>"


def _insight(kind, title, content, importance, columns):
    return [F.lit(kind).alias("type"), title.alias("title"), content.alias("content"), importance.cast("double").alias("importance"), columns.alias("columns")]


def _one(c="column"):
    return F.array(F.col(c))


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def fixed(value, digits):
    """Fixed decimals, rounded by the exact binary value, without digit grouping."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def summary_insight(df, roles):
    """Size, kinds of columns, missing values and time span."""
    by = columns_by_role(roles)
    dates = [c for c in by.get("datetime", []) if c in datetime_columns(df)]
    row = df.agg(F.count(F.lit(1)).alias("n"), sum((F.count_if(col(c).isNull()) for c in df.columns[1:]), F.count_if(col(df.columns[0]).isNull())).alias("nulls"),
                 *([F.date_format(F.min(col(dates[0])), "yyyy-MM-dd").alias("a"), F.date_format(F.max(col(dates[0])), "yyyy-MM-dd").alias("b")] if dates else []))
    kinds = [f"{len(by[r])} {label}" for r, label in (("categorical", "categorical"), ("datetime", "datetime"), ("binary", "binary"), ("likert", "likert scale"), ("gender", "gender")) if by.get(r)]
    k = len(df.columns)
    pct = 100.0 * F.col("nulls") / (F.col("n") * k)
    parts = [
        "This dataset contains ", F.col("n").cast("string"), f" rows and {k} columns. It has {len(by.get('numeric', []))} numeric columns" + (", " + ", ".join(kinds) + " columns. " if kinds else ". "),
        F.when(F.col("nulls") > 0, _text("There are ", F.col("nulls").cast("string"), " missing values (", fixed(pct, 1), "% of all data). ")).otherwise("The dataset is complete with no missing values. ")]
    if dates:
        parts.append(F.coalesce(_text("The data spans from ", F.col("a"), " to ", F.col("b"), "."), F.lit("")))
    return row.select(*_insight("summary", F.lit("Dataset Overview"), _text(*parts), F.lit(10), F.array().cast("array<string>")))


def distribution_insights(df, cols):
    """Centre, skew and outliers of the numeric columns."""
    t = metric_table(df, cols, {"mean": lambda c: F.avg(as_double(c)), "skew": lambda c: corrected_skew(as_double(c))})
    t = t.join(F.broadcast(median_table(df, cols).drop("n")), "column").join(F.broadcast(iqr_outliers(df, cols, 1.5).select("column", "outliers", "percent")), "column")
    shape = F.when(F.col("skew") > 1, "right-skewed").when(F.col("skew") < -1, "left-skewed").otherwise("normally distributed")
    found = F.when(F.col("outliers") > 0, _text("There are ", F.col("outliers").cast("string"), " outliers (", fixed(F.col("percent"), 1), "% of the data).")).otherwise("No significant outliers were detected.")
    content = _text("The ", F.col("column"), " variable has an average of ", fixed(F.col("mean"), 2), " and a median of ", fixed(F.col("median"), 2), ". It appears to be ", shape, " (skewness: ", fixed(F.col("skew"), 2), "). ", found)
    level = F.when((F.abs("skew") > 1.5) | (F.col("percent") > 5), 8).otherwise(7)
    return t.select(*_insight("distribution", _text("Distribution of ", F.col("column")), content, level, _one()))


def correlation_insights(df, cols, top=3):
    t = st.pearson(df, cols).filter(F.abs("r") >= 0.7).orderBy(F.desc(F.abs("r")), "a", "b").limit(top)
    up = F.col("r") > 0
    word = lambda yes, no: F.when(up, yes).otherwise(no)
    content = _text("There is a strong ", word("positive", "negative"), " correlation (", fixed(F.col("r"), 2), ") between ", F.col("a"), " and ", F.col("b"), ". This means that as ", F.col("a"), " ",
                    word("increases", "decreases"), ", ", F.col("b"), " tends to ", word("increase", "decrease"), " as well.")
    return t.select(*_insight("correlation", _text("Correlation between ", F.col("a"), " and ", F.col("b")), content, F.least(F.lit(9), F.floor(F.abs("r") * 10)), F.array("a", "b")))


def trend_insights(df, ts, cols, key):
    """Second half against first half of each measure in time order (5% is stable)."""
    span = df.agg(F.date_format(F.min(ts), "yyyy-MM-dd").alias("a"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("b")).first()
    t = union_all([half_trend(df, ts, c, key).withColumn("column", F.lit(c)) for c in cols])
    p, trend = F.col("change_percent"), F.col("direction")
    tail = F.when(trend == "stable", "there was no significant change in values.").otherwise(_text("there was a ", fixed(F.abs(p), 1), "% ", trend, " trend."))
    content = _text("The ", F.col("column"), " shows a ", trend, f" trend over time. From {span['a']} to {span['b']}, ", tail)
    level = F.when(F.abs(p) > 50, 9).when(F.abs(p) > 20, 8).otherwise(7)
    return t.select(*_insight("trend", _text("Trend in ", F.col("column"), " over Time"), content, level, F.array(F.lit(ts), F.col("column"))))


def outlier_insights(df, cols):
    """Columns with more than 1% of values beyond the 1.5 x IQR fences."""
    f = {r["column"]: r for r in iqr_outliers(df, cols, 1.5).filter("percent > 1").collect()}
    if not f:
        return df.sparkSession.createDataFrame([], SCHEMA)
    v, low, high = as_double, lambda c: F.lit(f[c]["low"]), lambda c: F.lit(f[c]["high"])
    t = metric_table(df, list(f), {
        "n": lambda c: F.any_value(F.lit(f[c]["outliers"])), "percent": lambda c: F.any_value(F.lit(f[c]["percent"])), "low": lambda c: F.any_value(low(c)), "high": lambda c: F.any_value(high(c)),
        "below": lambda c: F.count_if(v(c) < low(c)), "above": lambda c: F.count_if(v(c) > high(c)), "lowest": lambda c: F.min(v(c)), "highest": lambda c: F.max(v(c))})
    content = _text("The ", F.col("column"), " variable has ", F.col("n").cast("string"), " outliers (", fixed(F.col("percent"), 1), "% of data). There are ", F.col("below").cast("string"), " values below ", fixed(F.col("low"), 2),
                    " and ", F.col("above").cast("string"), " values above ", fixed(F.col("high"), 2), ". ", F.when(F.col("above") > 0, _text("The highest outlier is ", fixed(F.col("highest"), 2), ". ")).otherwise(""),
                    F.when(F.col("below") > 0, _text("The lowest outlier is ", fixed(F.col("lowest"), 2), ".")).otherwise(""))
    return t.select(*_insight("outlier", _text("Outliers in ", F.col("column")), content, F.least(F.lit(8), 5 + F.floor(F.col("percent") / 2)), _one()))


def pattern_insights(df, cols):
    """Categories whose top 3 values hold more than 60% of the rows."""
    counts = value_counts(df, cols)
    total = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    top = _top(counts, 3).join(F.broadcast(total), "column").filter((F.col("k") >= 3) & (F.col("total") >= 10))
    share = _text("'", F.col("value"), "' (", fixed(100.0 * F.col("n") / F.col("total"), 1), "%)")
    g = top.groupBy("column").agg((100.0 * F.sum("n") / F.first("total")).alias("p"), F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("rank", share.alias("s")))).alias("l")).filter("p > 60")
    content = _text("The top 3 values in ", F.col("column"), " account for ", fixed(F.col("p"), 1), "% of all data: ", F.array_join(F.transform("l", lambda x: x["s"]), ", "), ".",
                    F.when(F.col("k") > 10, _text(" There are ", F.col("k").cast("string"), " unique values in total.")).otherwise(""))
    return g.select(*_insight("pattern", _text("Value Distribution in ", F.col("column")), content, F.when(F.col("p") > 90, 8).when(F.col("p") > 75, 7).otherwise(6), _one()))


def binary_insights(df, cols):
    """Balance of two-valued columns; more than 40 points apart is an imbalance."""
    t = binary_summary(df, cols)
    rank = F.struct((-F.col("n")).alias("neg"), "value", "percent")
    g = t.groupBy("column").agg(F.min(rank).alias("a"), F.max(rank).alias("b"), F.count(F.lit(1)).alias("k")).filter("k = 2")
    gap = F.col("a.percent") - F.col("b.percent")
    wide = gap > 40
    strong = _text("The ", F.col("column"), " variable shows a strong imbalance with '", F.col("a.value"), "' representing ", fixed(F.col("a.percent"), 1),
                   "% of all values. This significant imbalance may indicate a potential bias in the data collection or a natural class distribution.")
    even = _text("The ", F.col("column"), " variable has a relatively balanced distribution with '", F.col("a.value"), "' at ", fixed(F.col("a.percent"), 1), "% and '", F.col("b.value"), "' at ", fixed(F.col("b.percent"), 1), "%.")
    title = _text(F.when(wide, "Imbalance in ").otherwise("Distribution of "), F.col("column"))
    return g.select(*_insight("pattern", title, F.when(wide, strong).otherwise(even), F.when(wide, F.least(F.lit(8), 5 + F.floor(gap / 10))).otherwise(5), _one()))


def likert_insights(df, cols):
    """Tendency of the answers, and polarisation when the two end points hold more than half."""
    t = likert_summary(df, cols)
    g = t.filter("count >= 10").groupBy("column").agg(
        F.first("mean").alias("mean"), F.first("min").alias("lo"), F.first("max").alias("hi"), F.first("mode").alias("mode"), F.max("percent").alias("top"),
        F.sum(F.when(F.col("value").isin(F.col("min"), F.col("max")), F.col("percent")).otherwise(0.0)).alias("ends")).filter("hi > lo")
    mean, lo, hi = F.col("mean"), F.col("lo"), F.col("hi")
    point = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    good, bad = mean > (hi + lo) * 0.6 / (hi - lo), mean < (hi + lo) * 0.4 / (hi - lo)
    tone = F.when(good, "are generally positive").when(bad, "tend to be negative").otherwise("are relatively balanced")
    content = _text("Responses for ", F.col("column"), " ", tone, " with an average rating of ", fixed(mean, 2), " on a scale from ", point(lo), " to ", point(hi), ". The most common response was ", point(F.col("mode")), " (", fixed(F.col("top"), 1), "% of responses).")
    title = _text(F.when(good, "Positive").when(bad, "Negative").otherwise("Balanced"), " Ratings in ", F.col("column"))
    level = F.least(F.lit(8), 5 + F.floor(F.abs(mean - (lo + hi) / 2) / ((hi - lo) / 2) * 5))
    poles = _text("The responses for ", F.col("column"), " show polarization, with ", fixed(F.col("ends"), 1), "% of responses at the extreme values (", point(lo), " and ", point(hi), "). This suggests divided opinions or experiences among respondents.")
    return g.select(*_insight("pattern", title, content, level, _one())).unionByName(
        g.filter("ends > 50").select(*_insight("pattern", _text("Polarized Responses in ", F.col("column")), poles, F.lit(7), _one())))


def gender_insights(df, cols):
    """Balance of the identified genders; more than 20 points apart is an imbalance."""
    t = union_all([gender_shares(df, c).withColumn("column", F.lit(c)) for c in cols]).filter("male + female > 0")
    m, f = F.col("male_percent"), F.col("female_percent")
    wide = F.abs(m - f) > 20
    ratio = F.coalesce(fixed(F.col("ratio"), 1), F.lit("inf"))
    strong = _text("There is a significant gender imbalance in the ", F.col("column"), " column, with ", fixed(m, 1), "% male and ", fixed(f, 1), "% female (ratio ", ratio, ":1). The data is skewed towards ", F.when(m > f, "male").otherwise("female"), " participants.")
    even = _text("The gender distribution in ", F.col("column"), " is relatively balanced with ", fixed(m, 1), "% male and ", fixed(f, 1), "% female.")
    title = _text(F.when(wide, "Gender Imbalance in ").otherwise("Gender Distribution in "), F.col("column"))
    return t.select(*_insight("pattern", title, F.when(wide, strong).otherwise(even), F.when(wide, F.least(F.lit(8), 5 + F.floor(F.abs(m - f) / 10))).otherwise(5), _one()))


def range_insights(df, cols):
    """Mean bounds and width of interval text, and whether the widths follow one pattern."""
    lo, hi = lambda c: range_bounds(c)[0], lambda c: range_bounds(c)[1]
    width = lambda c: hi(c) - lo(c)
    t = metric_table(df, cols, {"n": lambda c: F.count(width(c)), "lo": lambda c: F.avg(lo(c)), "hi": lambda c: F.avg(hi(c)), "w": lambda c: F.avg(width(c)), "s": lambda c: F.stddev_samp(width(c)),
                                "a": lambda c: F.min(width(c)), "b": lambda c: F.max(width(c))}).filter("n > 0")
    one = lambda c: fixed(F.col(c), 1)
    tail = F.when(F.col("b") > 2 * F.col("w"), _text("There's significant variation in range widths, from ", one("a"), " to ", one("b"), ".")).otherwise(
        _text("Range widths are relatively consistent, with all between ", one("a"), " and ", one("b"), "."))
    content = _text("The ranges in the ", F.col("column"), " column span from an average minimum of ", one("lo"), " to an average maximum of ", one("hi"), ", with an average width of ", one("w"), ". ", tail)
    same = _text("The ranges in ", F.col("column"), " follow a consistent pattern with an average width of ", one("w"), " and low variation (CV: ", fixed(F.col("s") / F.col("w"), 2), "). This suggests these ranges represent a standardized measurement or classification system.")
    return t.select(*_insight("pattern", _text("Range Analysis for ", F.col("column")), content, F.lit(6), _one())).unionByName(
        t.filter("n >= 10 AND s / w < 0.2").select(*_insight("pattern", _text("Consistent Range Pattern in ", F.col("column")), same, F.lit(7), _one())))


def text_insights(df, cols):
    """Length of the texts, and their most common words where they are long enough."""
    share = lambda cond: 100 * F.avg(cond.cast("double"))
    t = metric_table(df, cols, {
        "chars": lambda c: F.avg(F.length(col(c))), "words": lambda c: F.avg(word_count(col(c))), "sd": lambda c: F.stddev_samp(F.length(col(c))), "n": lambda c: F.count(col(c)),
        "short": lambda c: share(word_count(col(c)) <= 3), "long": lambda c: share(word_count(col(c)) >= 50)}).persist()
    s, l = F.col("short"), F.col("long")
    tail = F.when(s > 50, _text("Most entries (", fixed(s, 1), "%) are very short (3 or fewer words), suggesting brief responses or keywords.")).when(
        l > 20, _text("A significant portion (", fixed(l, 1), "%) are long texts (50+ words), suggesting detailed responses or paragraphs.")).otherwise(
        _text("Entries are moderate in length, with ", fixed(s, 1), "% very short and ", fixed(l, 1), "% very long."))
    content = _text("Text in the ", F.col("column"), " column averages ", fixed(F.col("chars"), 1), " characters and ", fixed(F.col("words"), 1), " words per entry. ", tail)
    out = t.select(*_insight("pattern", _text("Text Length Analysis for ", F.col("column")), content, F.when(F.col("sd") / F.col("chars") > 1, 7).otherwise(5), _one()))
    for r in t.filter("n >= 20 AND words >= 5").select("column").collect():
        words = common_words(df, r["column"])
        item = F.struct((-F.col("n")).alias("neg"), F.col("word"), _text("'", F.col("word"), "' (", fixed(F.col("percent"), 1), "%)").alias("s"))
        g = words.agg(F.array_sort(F.collect_list(item)).alias("l")).filter(F.size("l") > 0)
        content = _text(f"Common words in {r['column']} include: ", F.array_join(F.transform("l", lambda x: x["s"]), ", "), ". These frequent terms may indicate common themes or topics in the text.")
        out = out.unionByName(g.select(*_insight("pattern", F.lit(f"Common Words in {r['column']}"), content, F.lit(6), F.array(F.lit(r["column"])))))
    return out


def series_insights(df, ts, value, freq="m"):
    """Trend and season, stationarity and change points of one measure over time."""
    from .series import PERIODS, decomposition_text, prepare_series, series_evidence
    e = series_evidence(prepare_series(df, ts, value, (), freq), PERIODS[freq]).persist()
    cols = F.array(F.lit(ts), F.lit(value))
    parts = e.filter("has_trend IS NOT NULL")
    say = decomposition_text(parts).select(*_insight("time_series", F.lit(f"Time Series Analysis of {value}"), F.col("text"), F.lit(8), cols))
    still = F.when(F.col("stationary"), "The time series is stationary and can be modeled without differencing.").otherwise("The time series is non-stationary. Apply differencing before modeling.")
    unit = e.filter("stationary IS NOT NULL").select(*_insight("time_series", F.lit("Stationarity Analysis"), still, F.lit(7), cols))
    cps = e.filter("change_points > 0").select(*_insight("time_series", F.lit("Change Points"), _text("Detected ", F.col("change_points").cast("string"), " change points in the level of the series."), F.lit(8), cols))
    return union_all([say, unit, cps])


def insights(df, key, types=None, roles=None):
    """All findings, most important first; ``types`` keeps some kinds only. ``roles`` are those of the table, if known already."""
    roles = infer_roles(df) if roles is None else roles
    by = columns_by_role(roles)
    num, dates = by.get("numeric", []), [c for c in by.get("datetime", []) if c in datetime_columns(df)]
    parts = {"summary": [lambda: summary_insight(df, roles)]}
    add = lambda kind, fn, *cols: parts.setdefault(kind, []).append(fn) if all(cols) else None
    add("distribution", lambda: distribution_insights(df, num), num)
    add("correlation", lambda: correlation_insights(df, num), num[1:])
    for ts in dates:
        add("trend", lambda ts=ts: trend_insights(df, ts, num, key), num)
    add("outlier", lambda: outlier_insights(df, num), num)
    for role, fn in (("categorical", pattern_insights), ("binary", binary_insights), ("likert", likert_insights), ("gender", gender_insights), ("range", range_insights), ("text", text_insights)):
        add("pattern", lambda fn=fn, role=role: fn(df, by[role]), by.get(role))
    out = union_all([fn() for kind, fns in parts.items() if types is None or kind in types for fn in fns])
    return out.orderBy(F.desc("importance"), "type", "title")


def column_facts(df, cols):
    """(column, text): one line of facts per column."""
    t = column_profile(df, cols)
    item = F.struct("metric", _text(F.col("metric"), "=", fixed(F.col("value"), 2)).alias("s"))
    g = t.filter(F.col("value").isNotNull()).groupBy("column").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return g.select("column", _text(F.col("column"), ": ", F.array_join(F.transform("l", lambda x: x["s"]), ", ")).alias("text"))


def dataset_facts(df):
    """One text of table facts, numeric summaries and strong correlations."""
    from .common import numeric_columns
    num = numeric_columns(df)
    lines = [f"{r['section']} {r['name']}: {r['value']}" for r in dataset_info(df).orderBy("section", "name").collect()]
    if num:
        lines += [f"{r['column']}: mean {r['mean']}, std {r['std']}, range {r['min']} to {r['max']}" for r in numeric_summary(df, num).orderBy("column").collect()]
    if len(num) > 1:
        lines += [f"{r['a']} ~ {r['b']}: {r['r']:.2f}" for r in st.pearson(df, num).filter("abs(r) >= 0.5").orderBy(F.desc(F.abs("r")), "a", "b").limit(10).collect()]
    return df.sparkSession.createDataFrame([("\n".join(lines),)], "text string")


CATEGORY_LIKE = ("categorical", "gender", "email", "phone", "address", "name", "url")


def analysis_recommendations(df, roles):
    """(position, text): analyses the table lends itself to."""
    by, n = columns_by_role(roles), df.count()
    num, dates = len(by.get("numeric", [])), by.get("datetime", [])
    cats = sum(len(by.get(r, [])) for r in CATEGORY_LIKE)
    rules = [
        (dates, f"Consider time series analysis using the datetime column(s): {', '.join(dates[:3])}"),
        (num >= 2, "Analyze correlation between numeric variables to identify important relationships"),
        (num > 0, "Create distribution plots (histograms, box plots) to better understand the data patterns"),
        (cats and num, "Perform group analysis to compare metrics across different categories"),
        (num >= 3 and n >= 100, "Consider predictive modeling with the available numeric features"),
        (num > 10, "Apply dimensionality reduction techniques like PCA for better visualization of high-dimensional data"),
        (n >= 1000 and num >= 3, "Perform advanced analytics like clustering to identify patterns in the data"),
    ]
    return df.sparkSession.createDataFrame([(i, t) for i, (c, t) in enumerate(rules, 1) if c], "position int, text string")


def advanced_recommendations(df, roles, importance=None):
    """(position, text): next steps from feature importance, size, time columns and gaps."""
    by, n = columns_by_role(roles), df.count()
    num, dates = len(by.get("numeric", [])), by.get("datetime", [])
    cats = sum(len(by.get(r, [])) for r in CATEGORY_LIKE)
    top = [r["column"] for r in importance.orderBy(F.desc("importance"), "column").limit(3).collect()] if importance is not None else []
    nulls = df.agg(*[F.max(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    rules = [
        (top, f"Focus on most important features for analysis: {', '.join(top)}"),
        (n > 10_000 and num > 10, "For faster processing, consider limiting analysis to important features only"),
        (num >= 3 and n >= 200, "Apply clustering to identify natural groupings in your data"),
        (dates and num, "Create lag features for time series analysis to capture temporal patterns"),
        (cats > 5, "Consider dimensionality reduction for categorical variables using techniques like target encoding"),
        (any(nulls), "Address missing values before advanced analysis to improve model quality"),
        (n < 1000 and num > 10, "The dataset size might be too small for the number of features. Consider collecting more data or reducing dimensionality."),
    ]
    return df.sparkSession.createDataFrame([(i, t) for i, (c, t) in enumerate(rules, 1) if c], "position int, text string")


def context_block(df, key, rows=3):
    """One text with the table's columns, roles and a few sample rows."""
    roles = infer_roles(df).orderBy("position").collect()
    types = dict(df.dtypes)
    lines = [f"{df.count()} rows, {len(df.columns)} columns"] + [f"- {r['column']} ({types[r['column']]}, {r['role']})" for r in roles]
    lines += [", ".join(f"{c}: {r[c]}" for c in df.columns) for r in df.orderBy(key).limit(rows).collect()]
    return df.sparkSession.createDataFrame([("\n".join(lines),)], "text string")
