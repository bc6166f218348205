"""A spread of registered queries against their SQL; ``tools/check.py`` runs all of them."""
import pytest
from check import compare, connect

import __spark_entry__ as driver
from gridsight import catalog

SPREAD = """segment_value_report a3_categorical_summary a20_crosstab_wide infer_roles q2_format_consistency q13_accuracy s4_parse_json_documents s9_save_report p2_select_where p6_duplicate_columns
j1_with_children j6_fk_candidates j8_nearest_on_grid l5_sample_stratified u3_top_with_others d2_detect_date_format d6_to_timestamp_smart x3_common_words n1_tag_intent n8_extract_commands
n10_vector_search_many t4_impute_knn t13_one_hot c6_anova c8_chi_square_yates c21_dbscan v9_grouped_histogram v21_sankey_links m6_decompose m8_acf k9_recommend_pair_numeric i9_likert_insights
w1_window_metrics_streamed w2_rate_limit_streamed""".split()


@pytest.mark.parametrize("name", SPREAD)
def test_query_matches_sql(spark, sf, name):
    queries, sql = catalog.load()
    problem = compare(queries[name](spark, sf).toPandas(), connect(sf).execute(sql[name]).df())
    assert problem is None, problem


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
