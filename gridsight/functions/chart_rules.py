"""Chart recommendation rules.

Each rule is (chart type, category, subcategory, complexity, condition, score); conditions and scores are SQL
over the evidence columns named beside each group.
"""

# rows, skew, outlier_percent, distinct_ratio, null_percent
NUMERIC = [
    ("histogram", "distribution", "", "low", "true", "CASE WHEN abs(skew) > 1 THEN 1.0 ELSE 0.9 END - CASE WHEN null_percent > 5 THEN 0.05 ELSE 0.0 END"),
    ("box", "distribution", "", "medium", "true", "CASE WHEN outlier_percent > 5 THEN 0.95 ELSE 0.8 END + CASE WHEN outlier_percent > 10 THEN 0.1 ELSE 0.0 END - CASE WHEN null_percent > 5 THEN 0.05 ELSE 0.0 END"),
    ("violin", "distribution", "", "high", "true", "0.7 - CASE WHEN null_percent > 5 THEN 0.05 ELSE 0.0 END"),
    ("line", "distribution", "cumulative", "medium", "distinct_ratio > 0.3", "0.75 - CASE WHEN null_percent > 5 THEN 0.05 ELSE 0.0 END"),
]
# k, top_share
CATEGORICAL = [
    ("bar", "categorical", "", "low", "true", "CASE WHEN k > 15 THEN 0.7 ELSE 0.9 END"),
    ("pie", "categorical", "", "low", "k <= 8", "CASE WHEN k <= 5 THEN 0.85 ELSE 0.7 END"),
    ("treemap", "categorical", "", "medium", "k > 8 AND k <= 20", "0.65"),
]
# range_days, month_cv
DATETIME = [
    ("histogram", "temporal", "", "low", "true", "0.9"),
    ("line", "temporal", "", "medium", "true", "CASE WHEN range_days <= 1 THEN 0.85 ELSE 0.7 END"),
    ("heatmap", "temporal", "calendar", "high", "true", "CASE WHEN range_days <= 1 THEN 0.4 WHEN range_days <= 30 THEN 0.75 WHEN range_days <= 365 THEN 0.8 ELSE 0.6 END"),
    ("line", "temporal", "seasonality", "high", "month_cv > 0.3 AND range_days > 365", "0.85"),
]
# points
LIKERT = [
    ("likert", "specialized", "likert", "medium", "true", "0.95"),
    ("bar", "categorical", "", "low", "true", "0.8"),
    ("histogram", "distribution", "", "low", "points >= 5", "0.7"),
]
# top_share
BALANCE = " + CASE WHEN top_share > 0.9 THEN -0.1 WHEN top_share BETWEEN 0.4 AND 0.6 THEN 0.05 ELSE 0.0 END"
BINARY = [
    ("pie", "specialized", "binary", "low", "true", "0.9" + BALANCE),
    ("bar", "specialized", "binary", "low", "true", "0.8" + BALANCE),
    ("donut", "specialized", "binary", "low", "true", "0.7" + BALANCE),
]
# mean_length
TEXT = [
    ("word_cloud", "specialized", "text", "high", "true", "CASE WHEN mean_length < 20 THEN 0.7 WHEN mean_length > 1000 THEN 0.95 ELSE 0.9 END"),
    ("histogram", "specialized", "text", "medium", "true", "0.8"),
]
# k
RANGE = [
    ("bar", "specialized", "range", "medium", "true", "0.9"),
    ("pie", "specialized", "range", "medium", "true", "0.7"),
    ("range", "specialized", "range", "medium", "true", "CASE WHEN k >= 3 THEN 0.95 ELSE 0.85 END"),
]
# rows, r
NUMERIC_NUMERIC = [
    ("scatter", "relationship", "numeric", "medium", "true", "CASE WHEN rows > 5000 THEN 0.85 WHEN abs(r) > 0.7 THEN 1.0 WHEN abs(r) > 0.3 THEN 0.95 ELSE 0.9 END"),
    ("line", "relationship", "numeric", "medium", "true", "0.7"),
    ("heatmap", "relationship", "density", "high", "rows > 1000", "CASE WHEN rows > 5000 THEN 0.9 ELSE 0.7 END"),
    ("hexbin", "relationship", "density", "high", "rows > 5000", "0.95"),
    ("line", "relationship", "regression", "high", "abs(r) > 0.3", "CASE WHEN abs(r) > 0.7 THEN 0.85 ELSE 0.65 END"),
]
# k, cv, significant (three or more groups of at least 5 rows that differ)
CATEGORICAL_NUMERIC = [
    ("bar", "comparison", "categories", "medium", "true", "CASE WHEN k > 10 THEN 0.7 WHEN k <= 5 THEN 1.0 ELSE 0.9 END + CASE WHEN cv > 0.2 THEN 0.05 ELSE 0.0 END"),
    ("box", "comparison", "distributions", "medium", "true", "CASE WHEN k > 10 THEN 0.85 ELSE 0.8 END"),
    ("violin", "comparison", "distributions", "high", "k <= 8", "CASE WHEN k <= 5 THEN 0.85 ELSE 0.75 END"),
    ("grouped_histogram", "comparison", "distributions", "high", "k <= 5", "0.85"),
    ("heatmap", "statistical", "significance", "high", "significant", "0.85"),
]
# rows, range_days, change_percent
DATETIME_NUMERIC = [
    ("line", "temporal", "trends", "medium", "true", "CASE WHEN rows >= 10 AND abs(change_percent) > 20 THEN 1.0 ELSE 0.9 END"),
    ("area", "temporal", "trends", "medium", "true", "CASE WHEN rows > 100 AND range_days > 30 THEN 0.8 ELSE 0.7 END"),
    ("scatter", "temporal", "distribution", "medium", "true", "0.65"),
    ("line", "temporal", "analysis", "high", "true", "CASE WHEN rows >= 10 AND abs(change_percent) > 20 THEN 1.0 ELSE 0.95 END"),
    ("bar", "temporal", "comparison", "medium", "range_days > 90", "0.75"),
    ("line", "temporal", "seasonality", "high", "range_days > 365", "0.85"),
    ("line", "temporal", "trend", "high", "rows >= 10 AND abs(change_percent) > 20", "0.9"),
]
# k1, k2, p
CATEGORICAL_CATEGORICAL = [
    ("heatmap", "relationship", "categorical", "medium", "true", "CASE WHEN greatest(k1, k2) > 10 THEN 0.7 ELSE 0.9 END + CASE WHEN p < 0.05 THEN 0.05 ELSE 0.0 END"),
    ("bar", "relationship", "composition", "medium", "true", "CASE WHEN k1 <= 10 AND k2 > 10 THEN 0.85 ELSE 0.8 END"),
    ("bar_grouped", "relationship", "comparison", "medium", "true", "CASE WHEN greatest(k1, k2) > 10 THEN 0.6 WHEN greatest(k1, k2) <= 5 THEN 0.85 ELSE 0.75 END"),
    ("sankey", "relationship", "flow", "high", "greatest(k1, k2) <= 10", "CASE WHEN greatest(k1, k2) <= 5 THEN 0.9 ELSE 0.7 END"),
    ("chord", "relationship", "network", "high", "greatest(k1, k2) <= 10", "0.65"),
    ("mosaic", "statistical", "association", "high", "p < 0.05", "0.85"),
]
# consistent
DATETIME_DATETIME = [
    ("scatter", "temporal", "comparison", "medium", "true", "0.85"),
    ("line", "temporal", "comparison", "medium", "true", "0.8"),
    ("histogram", "temporal", "intervals", "medium", "true", "CASE WHEN consistent THEN 1.0 ELSE 0.9 END"),
    ("gantt", "temporal", "intervals", "high", "consistent", "0.9"),
]
# k, p
DATETIME_CATEGORICAL = [
    ("line", "temporal", "categorical", "medium", "true", "CASE WHEN k <= 5 THEN 0.95 ELSE 0.85 END"),
    ("area", "temporal", "composition", "medium", "true", "CASE WHEN k > 10 THEN 0.6 WHEN k <= 5 THEN 0.9 ELSE 0.8 END"),
    ("heatmap", "temporal", "distribution", "high", "true", "CASE WHEN p < 0.05 THEN 0.9 ELSE 0.75 END"),
    ("bar", "temporal", "patterns", "high", "p < 0.05", "0.85"),
]
# smallest, p
BINARY_NUMERIC = [
    ("box", "comparison", "binary", "medium", "true", "0.95"),
    ("bar", "comparison", "binary", "low", "true", "0.85"),
    ("violin", "comparison", "distributions", "high", "true", "0.8"),
    ("grouped_histogram", "comparison", "distributions", "medium", "true", "0.9"),
    ("bar", "statistical", "comparison", "high", "smallest >= 8 AND p < 0.05", "0.9"),
]
# r
LIKERT_LIKERT = [
    ("heatmap", "specialized", "likert_correlation", "high", "true", "0.95"),
    ("scatter", "relationship", "likert", "medium", "true", "0.85"),
    ("bar_grouped", "comparison", "likert", "medium", "true", "0.8"),
    ("line", "statistical", "correlation", "high", "abs(r) > 0.7", "0.9"),
]
# k, diverging
NUMERIC_DATETIME_CATEGORICAL = [
    ("line", "temporal", "multi_series", "high", "true", "CASE WHEN diverging OR k <= 5 THEN 1.0 WHEN k > 10 THEN 0.7 ELSE 0.9 END"),
    ("scatter_3d", "relationship", "3d", "high", "true", "0.8"),
    ("scatter", "relationship", "colored", "medium", "true", "0.85"),
    ("facet", "temporal", "facet", "high", "true", "CASE WHEN k > 10 THEN 0.85 ELSE 0.75 END"),
    ("animation", "temporal", "animation", "high", "k <= 5", "0.9"),
    ("diverging", "specialized", "diverging", "high", "diverging", "0.95"),
]
# k, span (of the correlation between categories)
TWO_NUMERIC_CATEGORICAL = [
    ("scatter", "relationship", "colored", "medium", "true", "CASE WHEN k <= 5 THEN 1.0 ELSE 0.95 END"),
    ("bubble", "relationship", "bubble", "high", "true", "CASE WHEN k > 10 THEN 0.7 ELSE 0.85 END"),
    ("facet", "relationship", "facet", "high", "true", "CASE WHEN k > 10 THEN 0.9 ELSE 0.75 END + CASE WHEN span > 0.3 THEN 0.1 ELSE 0.0 END"),
    ("bar", "statistical", "correlation_comparison", "high", "span > 0.3", "0.8"),
]
# strong (largest |r| above 0.7)
THREE_NUMERIC = [
    ("scatter_3d", "relationship", "3d", "high", "true", "0.9"),
    ("bubble", "relationship", "bubble", "high", "true", "0.85"),
    ("matrix", "relationship", "matrix", "medium", "true", "CASE WHEN strong THEN 0.9 ELSE 0.8 END"),
    ("heatmap", "relationship", "correlation", "medium", "true", "CASE WHEN strong THEN 0.85 ELSE 0.75 END"),
    ("regression", "statistical", "regression", "high", "strong", "0.85"),
    ("scatter", "statistical", "dimensionality_reduction", "high", "true", "0.85"),
]
# strong_pairs, grouped
CORRELATION = [
    ("heatmap", "statistical", "correlation", "medium", "true", "0.95"),
    ("matrix", "relationship", "matrix", "high", "true", "0.85"),
    ("network", "statistical", "correlation_network", "high", "true", "CASE WHEN strong_pairs > 0 THEN 0.9 ELSE 0.8 END"),
    ("scatter", "statistical", "dimensionality_reduction", "high", "true", "CASE WHEN strong_pairs > 3 AND grouped THEN 0.9 ELSE 0.75 END"),
    ("heatmap", "statistical", "factor_analysis", "high", "strong_pairs > 3 AND grouped", "0.85"),
]
# range_days, seasonal_ratio
SERIES = [
    ("line", "temporal", "multi_series", "medium", "true", "0.95"),
    ("area", "temporal", "composition", "medium", "true", "0.85"),
    ("heatmap", "temporal", "calendar", "high", "true", "0.8"),
    ("line", "temporal", "decomposition", "high", "true", "CASE WHEN seasonal_ratio > 0.5 THEN 1.0 WHEN range_days > 365 THEN 0.95 ELSE 0.9 END"),
    ("line", "temporal", "seasonality", "high", "range_days > 365", "0.9"),
    ("line", "temporal", "comparison", "high", "range_days > 365", "0.85"),
    ("bar", "temporal", "comparison", "medium", "range_days > 30 AND range_days <= 365", "0.85"),
    ("line", "temporal", "seasonality", "high", "seasonal_ratio > 0.5", "0.95"),
]
