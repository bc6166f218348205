"""Whole-table analyses composed from the operators."""
from pyspark.sql import functions as F

from ..operators import charts, insights as ins, learn, quality, statistics as st, text
from ..operators.clean import clean
from ..operators.common import datetime_columns, spread
from ..operators.profile import binary_summary, categorical_summary, datetime_summary, group_statistics, likert_summary, numeric_summary, range_summary, text_summary, top_values
from ..operators.relational import filter_pairs
from ..operators.roles import columns_by_role, infer_roles
from ..operators.series import analyze_all_series
from ..operators.text import tag_intent
from ..session import pin

#: Rows of a task that reads the cleaned table.
TABLE_ROWS = 100_000

KINDS = ("quality", "statistics", "insights", "visualizations", "advanced", "time_series")


def statistics_report(df, by):
    """{name: table}: the summaries that suit each role."""
    out, num, cats = {}, by.get("numeric", []), by.get("categorical", [])
    for role, fn in (("numeric", numeric_summary), ("categorical", categorical_summary), ("binary", binary_summary), ("likert", likert_summary), ("range", range_summary), ("text", text_summary)):
        if by.get(role):
            out[f"{role}_summary"] = fn(df, by[role])
    dates = [c for c in by.get("datetime", []) if c in datetime_columns(df)]
    if dates:
        out["datetime_summary"] = datetime_summary(df, dates)
    labels = cats + by.get("text", [])
    if labels:
        out["top_values"] = top_values(df, labels)
    if len(num) > 1:
        out["correlations"] = st.correlation_pairs(df, num)
    for c in cats:
        for n in num:
            out[f"group:{c}:{n}"] = group_statistics(df, c, n)
            out[f"anova:{c}:{n}"] = st.anova(df, c, n)
    return out


def advanced_analysis(df, roles, key=None):
    """{name: table}: projection, importance, clusters, and the deeper look at scales, pairs and text."""
    by, out = columns_by_role(roles), {}
    num, likert, binary = by.get("numeric", []), by.get("likert", []), by.get("binary", [])
    if len(num) >= 3:
        out["pca"] = learn.pca(df, num)[1]
        out["pca_importance"] = learn.pca_importance(out["pca"])
        out["forest_importance"] = learn.forest_importance(df, num[0], num[1:])
    if len(num) >= 2:
        labels, out["clusters"] = learn.kmeans_auto(df, num)
        if key:
            out["cluster_projection"] = learn.cluster_projection(labels, num, key=key)
    if likert:
        out["likert_consensus"] = st.likert_consensus(df, likert)
    if len(likert) > 1:
        out["likert_pairs"] = st.likert_pairs(df, likert)
    if binary:
        out["binary_bias"] = st.binary_bias(df, binary)
    for a, b in st.column_pairs(binary):
        out[f"chi_square:{a}:{b}"] = st.chi_square(df, a, b)
    for role, fn in (("gender", text.gender_shares), ("range", text.range_widths), ("text", text.word_counts)):
        for c in by.get(role, []):
            out[f"{role}:{c}"] = fn(df, c)
    if by.get("text"):
        out["text_lengths"] = text.length_stats(df, by["text"])
    return out


def analyze(df, key, kinds=("full",), as_of="2100-01-01"):
    """{name: table} for the wanted kinds (``full`` is all of them).

    Quality is measured on the raw table; everything else looks at the cleaned one, which is computed once and
    checkpointed to the shared folder, in even parts however few splits the table's files have. Its roles are inferred once.
    """
    kinds = set(KINDS if "full" in kinds else kinds)
    out = {}
    if "quality" in kinds:
        m = quality.quality_metrics(df, as_of)
        out.update(quality_metrics=m, quality_score=quality.overall_score(m), quality_issues=quality.issues(m), quality_recommendations=quality.recommendations(m))
    if kinds == {"quality"}:
        return out
    table = pin(spread(clean(df, key), TABLE_ROWS))
    roles = infer_roles(table)
    by = columns_by_role(roles)
    out["roles"] = roles
    if "statistics" in kinds:
        out.update(statistics_report(table, by))
    if "insights" in kinds:
        out["insights"] = ins.insights(table, key, roles=roles)
    if "visualizations" in kinds:
        out.update({f"chart:{k}": v for k, v in charts.automatic_charts(table, key, roles=roles).items()})
    if "advanced" in kinds:
        out.update(advanced_analysis(table, roles, key))
    if "time_series" in kinds and by.get("datetime") and by.get("numeric"):
        out["time_series"] = analyze_all_series(table, roles)
    return out


# The analysis each intent leads to.
GUIDES = {"visualization": ("visualizations",), "analysis": ("statistics",), "insight": ("insights",), "prediction": ("advanced",), "question": ("statistics",)}


def guided_analysis(df, question, key):
    """Analyse the columns a question mentions in the way its wording asks for."""
    asked = df.sparkSession.createDataFrame([(question,)], "question string")
    intent = tag_intent(asked, "question").first()["intent"]
    named = [c for c in df.columns if c.lower() in question.lower()]
    cols = list(dict.fromkeys([key, *named])) if named else df.columns
    return analyze(df.select(*cols), key, GUIDES[intent])


def top_insights(df, key, n=10):
    """The n most important findings, those over time included."""
    roles = infer_roles(df)
    by = columns_by_role(roles)
    found = ins.insights(df, key, roles=roles)
    dates = [c for c in by.get("datetime", []) if c in datetime_columns(df)]
    for ts in dates:
        for value in by.get("numeric", []):
            found = found.unionByName(ins.series_insights(df, ts, value))
    return found.orderBy(F.desc("importance"), "type", "title").limit(n)


def correlation_table(df, cols, threshold=0.3):
    """The ranked pairs of all columns whose |r| reaches the threshold."""
    return filter_pairs(st.correlation_pairs(df, cols, len(cols) * (len(cols) - 1) // 2), threshold)


def report_sizes(report):
    """(name, rows) of a report's tables."""
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, t in report.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
