"""Hand-computed tables, planted truths and invariants."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsight.functions import special
from gridsight.operators import charts, forecast, learn, neighbours, quality, relational, roles, series, statistics
from gridsight.operators import clean as cleaning
from gridsight.operators import ordered
from gridsight.operators import profile as p
from gridsight.operators.quantiles import quantile_table
from gridsight.sources import io


def test_tail_probabilities():
    assert special.f_tail(4.0, 2, 10) == pytest.approx(0.0529, abs=2e-4)
    assert special.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_tail(18.307038053, 10) == pytest.approx(0.05, abs=1e-6)


def test_missing_values_and_duplicates(spark):
    t = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "c")], "col1 double, col2 string")
    assert {r["column"]: r["missing_count"] for r in quality.missing_values(t).collect()} == {"col1": 1, "col2": 1}
    d = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "col1 long, col2 string")
    row = quality.duplicates(d).first()
    assert row["count"] == 1 and row["percentage"] == pytest.approx(33.33, abs=0.01)


def test_conformance(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    got = {r["column"]: r["ok"] for r in relational.conformance(t, {"a": "numeric", "b": "numeric", "c": "datetime"}).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_category_charts(spark):
    t = spark.createDataFrame([(v,) for v in "ABACB"], "c string")
    assert charts.category_bars(t, "c").count() == 3 and charts.pie(t, "c").count() == 3


def test_quantiles_by_bracket_match_direct(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["hot"] * 4000 + ["b"] * 30 + ["c"] * 1, "v": np.concatenate([np.round(rng.exponential(5, 4031), 1)])})
    t = spark.createDataFrame(pdf)
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    for by in ([], ["g"]):
        a = {tuple(r[b] for b in by): r["q"] for r in quantile_table(t, ["v"], probs, by).collect()}
        b = {tuple(r[x] for x in by): r["q"] for r in quantile_table(t, ["v"], probs, by, exact_rows=100, accuracy=100).collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k])


def test_quantiles_of_few_large_groups_do_not_move_rows_by_group(spark):
    """Three groups stay spread over the tasks that read them: their rows meet the sketches by broadcast."""
    t = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quantile_table(t, ["v"], [0.5], ["g"], exact_rows=100, accuracy=100)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {r["g"]: r["q"][0] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    # The one join left to Spark is that of the wanted ranks with the counted values inside the brackets.
    assert plan.count("SortMergeJoin") <= 1 and plan.count("BroadcastHashJoin") >= 3
    assert rows == {0: 1498.5, 1: 1499.5, 2: 1500.5}


def test_rows_of_few_groups_do_not_move_by_group(spark, tiny_limits):
    """Group starts and the state that enters a block meet the rows by broadcast, and sorted rows have a task per ``SORT_ROWS``."""
    t = spark.range(2000).select((F.col("id") % 3).alias("g"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        indexed = ordered.with_row_index(t, ["id"], ["g"])
        filled = ordered.fill_forward(indexed, ["v"], ["g"])
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (indexed, filled)]
        rows = {r["id"]: r["v"] for r in filled.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert not any("SortMergeJoin" in p for p in plans)
    want, last = {}, {}
    for i in range(2000):
        last[i % 3] = i if i % 5 == 0 else last.get(i % 3)
        want[i] = last[i % 3]
    assert rows == want


def test_as_of_join_orders_one_row_of_equal_times(spark, tiny_limits, monkeypatch):
    left = spark.createDataFrame([("a", 0), ("a", 5), ("a", 9), ("b", 5)], "g string, t int")
    right = spark.createDataFrame([("a", 5, v) for v in (2, None, 9, 7)] * 50 + [("a", 7, None), ("b", 6, 1)], "g string, t int, v int")
    ordered_rows = []
    plain = relational.with_row_index
    monkeypatch.setattr(relational, "with_row_index", lambda df, *a, **k: ordered_rows.append(df.count()) or plain(df, *a, **k))
    back, ahead = ({(r["g"], r["t"]): r["v"] for r in relational.asof_join(left, right, "t", ["g"], d, "v").collect()} for d in ("backward", "forward"))
    # A null key comes first among equal times.
    assert back == {("a", 0): None, ("a", 5): 9, ("a", 9): None, ("b", 5): None}
    assert ahead == {("a", 0): None, ("a", 5): None, ("a", 9): None, ("b", 5): 1}
    assert ordered_rows == [7, 7]


@pytest.mark.parametrize("hashed", [1000, 10])
def test_ranks_of_many_values(spark, tiny_limits, monkeypatch, hashed):
    """A proven number of values is hashed, so the rows are not sorted to meet their ranks; more are left to Spark."""
    monkeypatch.setattr(statistics, "BROADCAST_VALUES", 10, raising=False)
    monkeypatch.setattr(statistics, "HASHED_VALUES", hashed, raising=False)
    t = spark.range(600).select("id", (F.col("id") * 7 % 200).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 4).cast("double").alias("b"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = statistics.average_ranks(t, ["a", "b"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.toPandas().set_index("id").sort_index()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert [plan.count(j) for j in ("ShuffledHashJoin", "SortMergeJoin", "BroadcastHashJoin")] == ([1, 0, 1] if hashed > 200 else [0, 1, 1])
    for c in "ab":
        assert got[f"{c}_rank"].equals(got[c].rank())


def test_row_index_is_a_permutation_under_a_hot_key(spark, tiny_limits):
    t = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).withColumn("v", F.lit(1))
    got = ordered.with_row_index(t, ["v", "id"], ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.max("row_index").alias("m"), F.count_distinct("row_index").alias("d"))
    assert got.filter("n <> m + 1 OR n <> d").count() == 0


def test_clean_is_idempotent_and_full(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"))
    once = cleaning.clean(t, "o_orderkey")
    twice = cleaning.clean(once, "o_orderkey")
    assert once.count() == t.count()
    assert quality.missing_values(once).filter("missing_count > 0").isEmpty()
    assert once.exceptAll(twice.select(*[F.col(c).cast(dict(once.dtypes)[c]).alias(c) for c in once.columns])).isEmpty()


def test_profiles_merge(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet").withColumn("half", F.col("o_orderkey") % 2)
    merged = p.merge_numeric(p.partial_profile(t, "half", ["o_totalprice"], ["o_orderstatus"])).first()
    whole = t.agg(F.avg("o_totalprice"), F.stddev_pop("o_totalprice")).first()
    assert merged["mean"] == pytest.approx(whole[0]) and merged["std"] == pytest.approx(whole[1])


def brute_knn(q, d, k):
    out = {}
    for i, x in enumerate(q):
        dist = np.sqrt(((d - x) ** 2).sum(axis=1))
        out[i] = list(np.lexsort((np.arange(len(d)), dist))[:k])
    return out


def test_nearest_on_grid_is_exact(spark):
    rng = np.random.default_rng(7)
    d = np.concatenate([np.zeros((200, 2)), rng.normal(0, 1, (200, 2)), rng.normal(20, 0.1, (100, 2))])
    q = np.concatenate([rng.normal(0, 2, (60, 2)), [[1000.0, -1000.0]]])
    frame = lambda a, key: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], f"{key} int, x double, y double")
    got = neighbours.nearest(frame(q, "q"), frame(d, "d"), ["x", "y"], 4, "q", "d", cell_rows=16, slice_rows=7).orderBy("q", "rank").collect()
    want = brute_knn(q, d, 4)
    assert {i: [r["d"] for r in got if r["q"] == i] for i in want} == want


def brute_dbscan(x, eps, need):
    near = [np.flatnonzero(np.sqrt(((x - p) ** 2).sum(axis=1)) <= eps) for p in x]
    core = {i for i, n in enumerate(near) if len(n) >= need}
    label = {}
    for i in sorted(core):
        if i not in label:
            stack = [i]
            while stack:
                a = stack.pop()
                if a not in label:
                    label[a] = i
                    stack += [b for b in near[a] if b in core]
    return [label.get(i, min((label[b] for b in near[i] if b in core), default=-1)) for i in range(len(x))]


def test_dbscan_is_exact_in_two_dimensions(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 4), (0, 5))] + [rng.uniform(-3, 8, (40, 2))])
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k int, a double, b double")
    got = {r["k"]: int(r["cluster"]) for r in learn.dbscan(t, "k", ["a", "b"], 0.5, 5, scale=False).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, 0.5, 5)


def monthly(spark, values, name="s"):
    at = pd.date_range("2015-01-01", periods=len(values), freq="MS")
    return spark.createDataFrame(pd.DataFrame({"series_id": name, "ts": at, "value": values.astype(float)}))


def test_season_trend_and_step_are_found(spark):
    rng = np.random.default_rng(5)
    t = np.arange(120)
    s = monthly(spark, 10 * np.sin(2 * np.pi * t / 12) + 0.3 * t + rng.normal(0, 0.5, 120))
    d = series.decomposition_summary(series.decompose(s, 12)).first()
    assert d["has_seasonality"] and d["has_trend"] and d["trend_direction"] == "increasing"
    assert series.periodicity(s).filter("rank = 1").first()["period"] == pytest.approx(12, abs=0.2)
    step = monthly(spark, np.where(t < 60, 0, 20) + rng.normal(0, 0.5, 120))
    assert series.change_points(step).orderBy(F.desc("magnitude")).first()["pos"] == 60


def test_unit_root_and_ar_forecast(spark):
    rng = np.random.default_rng(11)
    e = rng.normal(0, 1, 400)
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.6 * ar[i - 1] + e[i]
    both = monthly(spark, ar, "ar").unionByName(monthly(spark, np.cumsum(e), "walk"))
    found = {r["series_id"]: r["stationary"] for r in forecast.adf(both).collect()}
    assert found == {"ar": True, "walk": False}
    fit = forecast.fit_arima(ar, 1, 0, 0, 0)
    assert fit.coefficients(fit.theta)[0][0] == pytest.approx(0.6, abs=0.1)
    f = forecast.forecast_arima(monthly(spark, ar, "ar"), spark.createDataFrame([("ar", 1, 0, 0, 0)], "series_id string, p int, d int, q int, season int"), 5).orderBy("step").collect()
    assert len(f) == 5 and all(r["lower"] < r["forecast"] < r["upper"] for r in f)


def test_wavelet_without_shrinkage_returns_the_signal(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(v)) for k, n in (("a", 101), ("b", 64), ("c", 5)) for i, v in enumerate(rng.normal(0, 1, n))]
    t = spark.createDataFrame(rows, "k string, i int, v double")
    got = cleaning.wavelet_denoise(t, "v", ["i"], ["k"], shrink=0.0)
    assert got.count() == len(rows) and got.filter("abs(v - v_denoised) > 1e-9 OR v_denoised IS NULL").isEmpty()


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (1000, 3))
    x[:20] += 12
    t = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k int, a double, b double, c double")
    got = learn.isolation_forest(t, ["a", "b", "c"], "k")
    assert got.filter("is_outlier").count() == pytest.approx(50, abs=2)
    assert got.filter("is_outlier AND k < 20").count() == 20


def test_json_array_document_and_delimiters(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert io.read_json(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "a.csv").write_bytes("name|n\ncafé|1\nêtre|2\n".encode("latin-1"))
    got = io.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["name", "n"] and {r["name"] for r in got.collect()} == {"café", "être"}


def test_sample_sizes_are_exact(spark):
    t = spark.range(5000).withColumn("s", F.when(F.col("id") < 3000, "hot").otherwise((F.col("id") % 7).cast("string")))
    assert relational.sample_n(t, 321, "id").count() == 321
    got = {r["s"]: r["count"] for r in relational.sample_stratified(t, 500, "s", "id").groupBy("s").count().collect()}
    assert got["hot"] == 300


def test_roles_of_fixture(spark):
    pdf = pd.DataFrame({"numeric_col": range(1, 11), "category_col": list("ABACBACBAB"), "date_col": pd.date_range("2023-01-01", periods=10)})
    got = {r["column"]: r["role"] for r in roles.infer_roles(spark.createDataFrame(pdf)).collect()}
    assert got["date_col"] == "datetime" and got["numeric_col"] == "id"


@pytest.mark.parametrize("cell_rows", [1, 1000])
def test_nearest_with_fewer_donors_than_wanted(spark, cell_rows):
    """Two donors and five wanted: every query gets both, by either plan."""
    prices = [(i, float(i * i % 37), 0.0) for i in range(40)]
    donors = [(1, 5.0, 0.0), (2, 30.0, 0.0)]
    q = spark.createDataFrame(prices, "q long, price double, one double")
    d = spark.createDataFrame(donors, "d long, price double, one double")
    got = neighbours.nearest(q, d, ["price", "one"], 5, "q", "d", cell_rows=cell_rows).collect()
    want = []
    for i, price, _ in prices:
        near = sorted((abs(price - x), k) for k, x, _ in donors)
        want += [(i, k, distance, rank) for rank, (distance, k) in enumerate(near, 1)]
    assert sorted((r["q"], r["d"], r["distance"], r["rank"]) for r in got) == sorted(want)


def sparse_distance(a, b):
    shared = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    return math.sqrt(len(a) / len(shared) * sum((x - y) ** 2 for x, y in shared)) if shared else None


@pytest.mark.parametrize("cell_rows, slice_rows", [(8192, 32768), (10, 25)])
def test_nearest_with_nulls_on_three_axes(spark, cell_rows, slice_rows):
    """All patterns of nulls, a hot cell, repeated points, rows without any axis and a donor pattern that hardly anyone has."""
    rng = np.random.default_rng(5)

    def points(n, odds):
        x = rng.normal(0, 3, (n, 3)).round(1)
        x[: n // 3] = [1.0, 2.0, 3.0]
        return [(i, *[None if rng.random() < odds else float(v) for v in row]) for i, row in enumerate(x)]

    q = [*points(200, 0.3), (900, None, None, None)]
    d = [*points(300, 0.3), (901, None, None, None), (902, 1.0, 2.0, 3.0)]
    fields = "long, a double, b double, c double"
    got = neighbours.nearest(spark.createDataFrame(q, f"q {fields}"), spark.createDataFrame(d, f"d {fields}"), ["a", "b", "c"], 4, "q", "d", cell_rows, slice_rows).collect()
    want = {}
    for i, *x in q:
        near = sorted((dist, j) for j, *y in d if (dist := sparse_distance(x, y)) is not None)
        want[i] = near[:4]
    for i, near in want.items():
        mine = sorted((r["rank"], r["d"], r["distance"]) for r in got if r["q"] == i)
        assert [r[0] for r in mine] == list(range(1, len(near) + 1))
        assert [r[2] for r in mine] == pytest.approx([n[0] for n in near])
        assert {r[1] for r in mine if r[2] < near[-1][0] - 1e-9} == {j for dist, j in near if dist < near[-1][0] - 1e-9}


def test_neighbours_that_share_no_axis(spark):
    fields = "long, a double, b double"
    q = spark.createDataFrame([(1, 1.0, None), (2, None, 1.0)], f"q {fields}")
    d = spark.createDataFrame([(i, float(i), None) for i in range(9)] + [(50, None, 4.0)], f"d {fields}")
    got = sorted((r["q"], r["d"]) for r in neighbours.nearest(q, d, ["a", "b"], 2, "q", "d").collect())
    assert got == [(1, 0), (1, 1), (2, 50)]
    assert neighbours.nearest(q, d.limit(0), ["a", "b"], 2, "q", "d").count() == 0 and neighbours.nearest(q.limit(0), d, ["a", "b"], 2, "q", "d").count() == 0


def test_imputation_falls_back_to_the_mean(spark):
    t = spark.createDataFrame([(i, float(i % 5), float(i), "own") for i in range(60)] + [(100, 2.0, None, "own"), (101, None, None, "own")], "key long, h double, v double, fill string")
    got = {r["key"]: r for r in neighbours.impute_knn(t, "v", ["h"], "key").collect()}
    assert got[100]["v"] == pytest.approx((2 + 7 + 12) / 3) and got[101]["v"] == pytest.approx(29.5) and got[5]["v"] == 5 and {r["fill"] for r in got.values()} == {"own"}


def test_registered_neighbour_queries_search_whole_tables():
    from gridsight import catalog
    names, sql = catalog.load()
    assert {n for n in names if n.startswith("j8_")} == {"j8_nearest", "j8_nearest_on_grid"}
    assert not any("LIMIT" in sql[n].upper() for n in names if n.startswith("j8_"))


def test_home_cells_of_many_boxes_in_bounded_memory():
    """10,000 points against 4,000 boxes: one matrix of all distances would be 320 MB."""
    import tracemalloc
    rng = np.random.default_rng(1)
    x, lo = rng.uniform(0, 100, (10_000, 2)), rng.uniform(0, 100, (4_000, 2))
    tracemalloc.start()
    best, reach = neighbours.home_cells(x, lo, lo + 1)
    pairs = sum(len(row) for row, _ in neighbours.cells_within(x, np.full(len(x), 0.5), lo, lo + 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bound = neighbours.shared_distance(x[:200], None, (lo, lo + 1))
    assert reach.all() and (best[:200] == bound.argmin(axis=1)).all()
    assert pairs > len(x) and peak < 200 * 2 ** 20


def test_narrow_types_never_below_the_values(spark):
    """Keys beyond 16 bits stay whole although at least 16 bits are asked for; small ones are widened to that."""
    t = spark.sql("SELECT id, id % 9 AS few FROM range(40000)")
    out = relational.narrow_types(t, {"id": "smallint", "few": "smallint"})
    assert dict(out.dtypes) == {"id": "int", "few": "smallint"} and out.agg({"id": "max"}).first()[0] == 39_999


def test_narrow_types_query_of_many_suppliers(spark, tmp_path):
    from gridsight import catalog
    spark.sql("SELECT id AS l_orderkey, id * 10 AS l_suppkey, 1 AS l_linenumber, 1.0D AS l_quantity FROM range(5000)").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.load()[0]["p11_narrow_types"](spark, str(tmp_path))
    assert out.agg({"l_suppkey": "max"}).first()[0] == 49_990


def test_text_evidence_is_dealt_to_tasks(spark, monkeypatch):
    """A table of one partition is divided by its rows before the patterns run; the evidence stays the same."""
    from gridsight.operators import common
    t = spark.range(100, numPartitions=1).selectExpr("concat(id, ' - ', id + 5) AS bracket")
    whole = roles.text_evidence(t, ["bracket"]).collect()
    monkeypatch.setattr(common, "PATTERN_ROWS", 10)
    assert common.spread(t, 10).rdd.getNumPartitions() == 10 and common.spread(t, 100).rdd.getNumPartitions() == 1
    assert "RoundRobinPartitioning(10)" in roles.text_evidence(t, ["bracket"])._jdf.queryExecution().toString()
    assert roles.text_evidence(t, ["bracket"]).collect() == whole


def test_forests_train_on_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(learn, "FOREST_ROWS", 20)
    seen, fit = [], learn.RandomForestRegressor.fit
    monkeypatch.setattr(learn.RandomForestRegressor, "fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or fit(self, data))
    t = spark.range(100, numPartitions=1).selectExpr("id", "double(id) AS x", "2.0D * id AS y", "1.0D AS flat")
    assert {r["column"]: r["importance"] for r in learn.forest_importance(t, "y", ["x", "flat"]).collect()} == {"x": 1.0, "flat": 0.0}
    learn.predict(t, "id", "y", ["x"], "regression")
    assert seen == [5, 5]
