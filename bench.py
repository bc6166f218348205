"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridsight import catalog  # noqa: E402
from gridsight.session import local_session  # noqa: E402

HEADLINE = """segment_value_report a1_numeric_summary a2_auto_histogram a3_categorical_summary a9_datetime_summary a10_group_statistics a12_profile
infer_roles q6_duplicate_rows q14_overall_score j3_asof_join l5_sample_stratified d2_detect_date_format x1_word_counts x4_length_stats o1_rolling_mean o5_gaps o8_ecdf o12_resample
c1_pearson c2_spearman c6_anova c8_chi_square c11_ks_uniform v1_histogram v8_box_plot v19_hexbin m6_decompose m8_acf m15_forecast_arima t2_impute_median t8_clip_iqr
n10_vector_search k10_recommend_pair_categorical_numeric w1_window_metrics
clean_table k1_recommend_charts c20_kmeans_summary c21_dbscan t4_impute_knn t9_isolation_forest t19_moving_average t21_wavelet_denoise j8_nearest_on_grid w2_rate_limit_streamed""".split()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    # The JVM and the Python workers start before the clock does.
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
