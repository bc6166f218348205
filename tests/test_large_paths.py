"""Queries whose operators choose a path by size, run on the path for large tables and compared with their SQL."""
import pytest
from check import compare, connect

from gridsight import catalog

ORDERED = """a1_numeric_summary a9_datetime_summary a10_group_statistics a24_common_gaps d12_lag_features d14_gap_stats d15_frequency_name j3_asof_join j3_asof_join_forward
l4_sample_systematic l6_sample_over_time l8_every_kth o1_rolling_mean o1_rolling_std_unkeyed o1_rolling_median o2_ewma o3_half_trend o4_quarter_change o5_gaps
o6_group_quarter_change o7_waterfall o8_ecdf o9_average_ranks o10_quartile_means o11_interpolate with_row_index c2_spearman c2_spearman_with_nulls c11_ks_uniform
t2_impute_median t8_clip_iqr t14_label_encode t19_moving_average v8_box_plot w3_moving_mean""".split()


@pytest.mark.parametrize("name", ORDERED)
def test_large_path_matches_sql(spark, sf, tiny_limits, name):
    queries, sql = catalog.load()
    problem = compare(queries[name](spark, sf).toPandas(), connect(sf).execute(sql[name]).df())
    assert problem is None, problem
