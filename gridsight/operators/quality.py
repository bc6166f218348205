"""Data-quality metrics and the five-part score.

``quality_metrics`` returns one long table (dimension, column, metric, value); scores, issues and
recommendations are rules over that small table.
"""
from pyspark.sql import functions as F

from ..functions import vocab
from .common import as_double, col, datetime_columns, distinct_table, local, metric_table, numeric_columns, string_columns, union_all
from .profile import gap_summary, iqr_outliers

WEIGHTS = {"completeness": 0.3, "consistency": 0.2, "uniqueness": 0.2, "integrity": 0.2, "accuracy": 0.1}


def _named(cols, words):
    return [c for c in cols if any(w in c.lower() for w in words)]


def completeness(df):
    """Nulls and null percent per column; columns above 20% are problems."""
    t = metric_table(df, df.columns, {"nulls": lambda c: F.count_if(col(c).isNull()), "rows": lambda c: F.count(F.lit(1))})
    pct = F.when(F.col("rows") > 0, 100.0 * F.col("nulls") / F.col("rows")).otherwise(0.0)
    return t.select("column", "nulls", "rows", pct.alias("null_percent"), (pct > 20).alias("problem"))


def completeness_score(c):
    return c.agg((100.0 * (1 - F.sum("nulls") / F.sum("rows"))).alias("score"), F.sum("nulls").alias("missing_cells"),
                 (100.0 * F.sum("nulls") / F.sum("rows")).alias("missing_percent"))


def missing_values(df):
    return completeness(df).select("column", F.col("nulls").alias("missing_count"), F.col("null_percent").alias("missing_percent"))


def column_completeness(df):
    return completeness(df).select("column", (1 - F.col("null_percent") / 100).alias("completeness"))


def format_consistency(df):
    """(column, issue, n): invalid e-mails, unreadable dates, and phone lengths off the most common one."""
    from .dates import to_timestamp_smart
    text = string_columns(df)
    mails = _named(text, ["email"])
    dates = [c for c in _named(text, ["date", "time", "day", "month", "year"]) if c not in mails]
    phones = [c for c in _named(text, ["phone", "tel", "mobile"]) if c not in mails + dates]
    parts = []
    if mails:
        t = metric_table(df, mails, {"n": lambda c: F.count(col(c)), "ok": lambda c: F.count_if(col(c).rlike(vocab.EMAIL))})
        parts.append(t.select("column", F.lit("inconsistent_email_format").alias("issue"), F.when(F.col("ok") > 0, F.col("n") - F.col("ok")).otherwise(0).alias("n")))
    if dates:
        probe = df.select(*[col(c).alias(c) for c in dates], *[col(c).alias(f"{c}__raw") for c in dates])
        for c in dates:
            probe = to_timestamp_smart(probe, c)
        t = metric_table(probe, dates, {"n": lambda c: F.count(col(f"{c}__raw")), "ok": lambda c: F.count(col(c))})
        parts.append(t.select("column", F.lit("inconsistent_date_format").alias("issue"), F.when(F.col("ok") > 0, F.col("n") - F.col("ok")).otherwise(0).alias("n")))
    for c in phones:
        lengths = df.filter(col(c).isNotNull()).groupBy(F.length(F.regexp_replace(col(c), r"\D", "")).alias("len")).agg(F.count(F.lit(1)).alias("k"))
        parts.append(lengths.agg((F.sum("k") - F.max("k")).alias("n")).select(F.lit(c).alias("column"), F.lit("inconsistent_phone_format").alias("issue"), F.coalesce("n", F.lit(0)).alias("n")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, issue string, n long")
    return union_all(parts).filter(F.col("n") > 0)


def case_variants(df):
    """(column, issue, n): values that differ only by case."""
    text = string_columns(df)
    if not text:
        return df.sparkSession.createDataFrame([], "column string, issue string, n long")
    values = df.select(*[col(c) for c in text]).unpivot([], text, "column", "value").filter(F.col("value").isNotNull()).distinct()
    t = values.groupBy("column", F.lower("value").alias("v")).agg((F.count(F.lit(1)) - 1).alias("k")).groupBy("column").agg(F.sum("k").alias("n"))
    return t.select("column", F.lit("inconsistent_capitalization").alias("issue"), "n").filter(F.col("n") > 0)


def unit_spread(df):
    """(column, issue, n): positive values that span more than three decades."""
    num = numeric_columns(df)
    if not num:
        return df.sparkSession.createDataFrame([], "column string, issue string, n long")
    pos = lambda c: F.when(as_double(c) > 0, as_double(c))
    t = metric_table(df, num, {"k": lambda c: F.count(as_double(c)), "span": lambda c: F.log10(F.max(pos(c))) - F.log10(F.min(pos(c)))})
    return t.filter((F.col("k") > 10) & (F.col("span") > 3)).select("column", F.lit("potential_unit_inconsistency").alias("issue"), F.lit(1).cast("long").alias("n"))


def consistency(df):
    return union_all([format_consistency(df), case_variants(df), unit_spread(df)])


def consistency_score(issues, cells):
    return issues.agg((100.0 * (1 - F.least(F.lit(1.0), F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(max(cells, 1)))))).alias("score"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("inconsistency_count"))


def duplicate_rows(df):
    """Rows beyond the first of each set of equal rows (nulls equal), with their percent."""
    counts = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    t = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    return t.withColumn("percent", F.when(F.col("rows") > 0, 100.0 * F.col("duplicates") / F.col("rows")).otherwise(0.0))


def duplicates(df):
    return duplicate_rows(df).select(F.col("duplicates").alias("count"), F.col("percent").alias("percentage"))


def uniqueness(df, top=10):
    """Distinct percent of columns that are at least half full; identifiers are nearly all distinct and nearly full."""
    t = metric_table(df, df.columns, {"rows": lambda c: F.count(F.lit(1)), "non_null": lambda c: F.count(col(c))}).join(distinct_table(df, df.columns), "column")
    pct = 100.0 * F.col("distinct_values") / F.col("non_null")
    t = t.filter((F.col("non_null") > 0) & (F.col("non_null") >= F.col("rows") * 0.5)).withColumn("unique_percent", pct)
    out = t.select("column", "distinct_values", "unique_percent", ((F.col("unique_percent") >= 90) & (F.col("non_null") > F.col("rows") * 0.9)).alias("identifier"))
    return out.orderBy(F.desc("unique_percent"), "column").limit(top)


def uniqueness_score(df):
    """100 less the duplicate percent, times 0.8 when no column identifies rows."""
    dup = duplicate_rows(df).first()["percent"]
    has_id = not uniqueness(df, len(df.columns)).filter("identifier").isEmpty()
    return df.sparkSession.createDataFrame([((100.0 - dup) * (1.0 if has_id else 0.8), dup, has_id)], "score double, duplicate_percent double, has_identifier boolean")


def outlier_share(df, k=3):
    """Values beyond the k x IQR fences, for columns with at least 10 distinct values; above 5% is an issue."""
    num = numeric_columns(df)
    enough = [r["column"] for r in distinct_table(df, num).filter("distinct_values >= 10").collect()] if num else []
    if not enough:
        return df.sparkSession.createDataFrame([], "column string, outliers long, outlier_percent double, issue boolean")
    return iqr_outliers(df, enough, k).select("column", "outliers", F.col("percent").alias("outlier_percent"), (F.col("percent") > 5).alias("issue"))


def percent_range(df):
    """Percent-named columns with values outside 0 to 1 (when none exceeds 1) or 0 to 100."""
    cols = _named(numeric_columns(df), ["percent", "pct", "ratio", "rate"])
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, upper double, invalid long")
    most = {r["column"]: r["m"] for r in metric_table(df, cols, {"m": lambda c: F.max(as_double(c))}).collect()}
    top = {c: 1.0 if (most[c] is not None and most[c] <= 1) else 100.0 for c in cols}
    t = metric_table(df, cols, {"upper": lambda c: F.any_value(F.lit(top[c])), "invalid": lambda c: F.count_if((as_double(c) < 0) | (as_double(c) > top[c]))})
    return t


def date_bounds(df, as_of):
    """Dates after ``as_of`` and dates before 1900."""
    cols = datetime_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, future long, ancient long")
    return metric_table(df, cols, {
        "future": lambda c: F.count_if(col(c) > F.lit(as_of).cast("timestamp")), "ancient": lambda c: F.count_if(col(c) < F.lit("1900-01-01").cast("timestamp"))})


def irregular_intervals(df):
    """Regularity of the steps of each date column; below 0.5 is irregular."""
    cols = datetime_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, regularity double, irregular boolean")
    cv = F.col("gap_std_pop") / F.col("gap_mean")
    reg = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), cv / 3))
    return union_all([gap_summary(df, c) for c in cols]).select("column", reg.alias("regularity"), (reg < 0.5).alias("irregular"))


def accuracy(df):
    """(column, issue, share): JSON inside text, several values in a cell, invalid e-mails."""
    text = string_columns(df)
    if not text:
        return df.sparkSession.createDataFrame([], "column string, issue string, share double")
    has = lambda c, p: col(c).rlike(p)
    avg = lambda cond: F.avg(cond.cast("double"))
    t = metric_table(df, text, {
        "json": lambda c: avg(has(c, r"\{") & has(c, r"\}")), "many": lambda c: avg(has(c, "[,;]") & ~has(c, r"[\n\r]")), "mail": lambda c: avg(has(c, vocab.EMAIL))})
    is_mail = F.lower("column").contains("email")
    issue = lambda name, cond, value: F.when(cond, F.struct(F.lit(name).alias("issue"), F.col(value).alias("share")))
    found = F.array_compact(F.array(
        issue("potential_json_in_string", F.col("json") > 0, "json"), issue("multiple_values_in_cell", F.col("many") > 0.5, "many"),
        issue("invalid_emails", is_mail & (F.col("mail") > 0) & (F.col("mail") < 0.9), "mail")))
    return t.select("column", F.explode(found).alias("_i")).select("column", "_i.*")


def integrity_issues(df, as_of, outliers=None):
    """(column, issue, value) from outliers, percent ranges, date bounds and intervals."""
    outliers = outlier_share(df) if outliers is None else outliers
    parts = [
        outliers.filter("issue").select("column", F.lit("excessive_outliers").alias("issue"), F.col("outlier_percent").alias("value")),
        percent_range(df).filter("invalid > 0").select("column", F.lit("invalid_percentage").alias("issue"), F.col("invalid").cast("double").alias("value"))]
    b = date_bounds(df, as_of)
    parts += [b.filter(f"{c} > 0").select("column", F.lit(i).alias("issue"), F.col(c).cast("double").alias("value")) for c, i in (("future", "future_dates"), ("ancient", "very_old_dates"))]
    parts.append(irregular_intervals(df).filter("irregular").select("column", F.lit("irregular_intervals").alias("issue"), F.col("regularity").alias("value")))
    return union_all(parts)


def integrity_score(df, as_of):
    """100 - min(50, 5 x issues + half the summed outlier percents)."""
    outliers = local(outlier_share(df))
    n = integrity_issues(df, as_of, outliers).count()
    o = outliers.agg(F.coalesce(F.sum("outlier_percent"), F.lit(0.0))).first()[0]
    return df.sparkSession.createDataFrame([(100.0 - min(50.0, 5.0 * n + o / 2), n, float(o))], "score double, issues int, outlier_percent_sum double")


def accuracy_score(issues):
    return issues.agg((100.0 - F.least(F.lit(50.0), F.count(F.lit(1)) * 10.0)).alias("score"), F.count(F.lit(1)).alias("issues"))


def quality_metrics(df, as_of):
    """The long metric table: (dimension, column, metric, value); scores have an empty column name."""
    rows = []
    comp = local(completeness(df))
    for r in comp.collect():
        rows.append(("completeness", r["column"], "null_percent", float(r["null_percent"])))
    total = completeness_score(comp).first()
    rows += [("completeness", "", "score", float(total["score"] or 0.0)), ("completeness", "", "missing_percent", float(total["missing_percent"] or 0.0))]
    cells = sum(r["rows"] for r in comp.collect())
    issues = consistency(df).collect()
    rows += [("consistency", r["column"], r["issue"], float(r["n"])) for r in issues]
    rows.append(("consistency", "", "score", 100.0 * (1 - min(1.0, sum(r["n"] for r in issues) / max(cells, 1)))))
    ids = uniqueness(df, len(df.columns)).filter("identifier").collect()
    dup = duplicate_rows(df).first()["percent"]
    rows += [("uniqueness", "", "score", (100.0 - dup) * (1.0 if ids else 0.8)), ("uniqueness", "", "duplicate_percent", dup)]
    rows += [("uniqueness", r["column"], "identifier", r["unique_percent"]) for r in ids]
    wild = local(outlier_share(df))
    outliers = wild.collect()
    rows += [("integrity", r["column"], "outlier_percent", float(r["outlier_percent"])) for r in outliers]
    found = integrity_issues(df, as_of, wild).collect()
    rows += [("integrity", r["column"], r["issue"], float(r["value"])) for r in found]
    rows.append(("integrity", "", "score", 100.0 - min(50.0, 5.0 * len(found) + sum(r["outlier_percent"] for r in outliers) / 2)))
    acc = accuracy(df).collect()
    rows += [("accuracy", r["column"], r["issue"], float(r["share"])) for r in acc]
    rows.append(("accuracy", "", "score", 100.0 - min(50.0, 10.0 * len(acc))))
    return df.sparkSession.createDataFrame(rows, "dimension string, column string, metric string, value double")


def _score(dimension):
    return F.max(F.when((F.col("metric") == "score") & (F.col("dimension") == dimension), F.col("value")))


def overall_score(m):
    """The weighted score, at most 100, with its five parts."""
    parts = m.agg(*[_score(d).alias(d) for d in WEIGHTS])
    total = sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0))
    return parts.withColumn("overall", F.least(F.lit(100.0), total))


def _listed(m, cond, n):
    """Comma-separated names of the first n flagged columns, with how many more there are."""
    names = F.array_sort(F.collect_set(F.when(cond, F.col("column"))))
    more = F.size(names) - n
    text = F.array_join(F.slice(names, 1, n), ", ")
    return F.when(F.size(names) > 0, F.when(more > 0, F.concat(text, F.lit(" and "), more.cast("string"), F.lit(" others"))).otherwise(text))


def _flags(m):
    own = F.col("column") != ""
    at = lambda d, metric: F.max(F.when((F.col("dimension") == d) & (F.col("metric") == metric), F.col("value")))
    issue = lambda d: own & (F.col("dimension") == d) & ~F.col("metric").isin("score", "identifier", "null_percent", "outlier_percent")
    high = lambda metric, cut: own & (F.col("metric") == metric) & (F.col("value") > cut)
    kind = lambda *k: F.max(F.col("metric").isin(*k) & own)
    return m.agg(
        at("completeness", "missing_percent").alias("missing"), at("uniqueness", "duplicate_percent").alias("dup"),
        _listed(m, high("null_percent", 20), 5).alias("sparse"), _listed(m, high("outlier_percent", 10), 3).alias("wild"),
        _listed(m, issue("consistency"), 3).alias("mixed"), _listed(m, issue("accuracy"), 3).alias("suspect"),
        F.max(high("outlier_percent", 5)).alias("some_wild"), F.max(own & (F.col("metric") == "identifier")).alias("has_id"),
        kind("inconsistent_date_format").alias("date_issue"), kind("inconsistent_email_format", "inconsistent_phone_format").alias("contact_issue"),
        kind("inconsistent_capitalization").alias("case_issue"), F.max(own & F.col("column").contains(" ")).alias("spaces"),
        *[_score(d).alias(d) for d in WEIGHTS])


def _texts(flags, rules):
    entries = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(i).alias("position"), text.alias("text"))) for i, (cond, text) in enumerate(rules, 1)]))
    return flags.select(F.explode(entries).alias("_e")).select("_e.*")


def issues(m):
    """(position, text): the main problems."""
    say = lambda head, c: F.concat(F.lit(head), F.col(c))
    return _texts(_flags(m), [
        (F.col("missing") > 10, F.format_string("High level of missing data: %.1f%% of values are missing", "missing")),
        (F.col("sparse").isNotNull(), say("Columns with excessive missing values: ", "sparse")),
        (F.col("dup") > 5, F.format_string("High level of duplicate rows: %.1f%% of rows are duplicates", "dup")),
        (F.col("wild").isNotNull(), say("High percentage of outliers in columns: ", "wild")),
        (F.col("mixed").isNotNull(), say("Data consistency issues in columns: ", "mixed")),
        (F.col("suspect").isNotNull(), say("Potential data accuracy issues in columns: ", "suspect")),
    ])


def recommendations(m):
    """(position, text): what to do about them."""
    overall = sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0))
    return _texts(_flags(m), [
        (F.col("missing") > 5, F.lit("Consider imputing missing values or removing columns with excessive missing data")),
        (F.col("dup") > 1, F.lit("Remove duplicate rows to improve data quality")),
        (F.col("some_wild"), F.lit("Examine and potentially cap or remove outliers in numeric columns")),
        (F.col("date_issue"), F.lit("Standardize date formats across the dataset")),
        (F.col("contact_issue"), F.lit("Apply consistent formatting to contact information (emails, phone numbers)")),
        (F.col("case_issue"), F.lit("Standardize capitalization in text columns")),
        (F.col("spaces"), F.lit("Standardize column names by replacing spaces with underscores")),
        (~F.col("has_id"), F.lit("Consider adding a unique identifier column for better data tracking")),
        (F.lit(True), F.lit("Optimize memory usage by converting numeric columns to appropriate dtypes")),
        (overall < 70, F.lit("Conduct a comprehensive data quality audit to address the numerous issues found")),
    ])


def quality_summary(m):
    """Scores, the first 5 issues and the first 3 recommendations as (kind, position, text, value)."""
    scores = overall_score(m).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(d).alias("text"), F.round(F.col(d), 2).alias("value")) for i, d in enumerate(["overall", *WEIGHTS])])).alias("_s")).select(F.lit("score").alias("kind"), "_s.*")
    pick = lambda t, k, n: t.orderBy("position").limit(n).select(F.lit(k).alias("kind"), "position", "text", F.lit(None).cast("double").alias("value"))
    return union_all([scores, pick(issues(m), "issue", 5), pick(recommendations(m), "recommendation", 3)])


def column_quality(m, facts=None):
    """Quality of each column from 0 to 1. ``facts`` may add (column, mean_length, polarization)."""
    at = lambda metric: F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0.0))
    t = m.filter(F.col("column") != "").groupBy("column").agg(
        at("null_percent").alias("nulls"), at("outlier_percent").alias("outliers"), F.max(F.col("dimension") == "consistency").alias("mixed"))
    if facts is not None:
        t = t.join(F.broadcast(facts), "column", "left")
    else:
        t = t.withColumns({"mean_length": F.lit(None).cast("double"), "polarization": F.lit(None).cast("double")})
    off = lambda cond, w: F.when(cond, w).otherwise(0.0)
    q = 1 - off(F.col("nulls") > 0, 0.2) - F.col("outliers") / 100 * 0.3 - off(F.col("mixed"), 0.2) - off(F.col("mean_length") < 5, 0.1) - off(F.col("polarization") > 0.7, 0.1)
    return t.select("column", F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)).alias("quality"))
