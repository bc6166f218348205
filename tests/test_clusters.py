"""Components in few rounds, density clusters beside plain versions, and k-means on cluster features."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsight.operators import components as linked
from gridsight.operators import learn, ordered
from gridsight.operators.components import components


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(999)] + [(5000, 5001), (7, 7)], "a long, b long")
    roots, rounds = components(chain)
    assert {r["node"]: r["root"] for r in roots.collect()} == {**{i: 0 for i in range(1000)}, 5000: 5000, 5001: 5000} and rounds <= 12
    assert components(chain.limit(0))[0].count() == 0


def test_components_of_shuffled_text_keys(spark):
    order = np.random.default_rng(1).permutation(300)
    chain = spark.createDataFrame([(f"k{a:03d}", f"k{b:03d}") for a, b in zip(order, order[1:])], "a string, b string")
    assert {r["root"] for r in components(chain)[0].collect()} == {"k000"}


@pytest.mark.parametrize("axes", [2, 3])
def test_dense_neighbouring_cells(spark, axes):
    """Two dense clouds whose only close pair lies in one corner, and a third just too far away."""
    rng = np.random.default_rng(axes)
    x = np.concatenate([rng.uniform(0, 0.3, (300, axes)), rng.uniform(0.9, 1.2, (300, axes)), rng.uniform(4, 4.3, (100, axes)), [[0.3] * axes, [0.9 - 0.001] * axes]])
    eps = float(np.sqrt(axes) * 0.6)
    names = [f"c{i}" for i in range(axes)]
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "k int, " + ", ".join(f"{n} double" for n in names))
    got = {r["k"]: int(r["cluster"]) for r in learn.dbscan(t, "k", names, eps, 5, scale=False).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= 5
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert [got[i] for i in range(len(x))] == [int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]


@pytest.fixture()
def plans(monkeypatch):
    """Density clusters as of large tables: nothing may be broadcast by its count; the plans that are run are kept."""
    plan, seen = lambda df: df._jdf.queryExecution().sparkPlan().toString(), []
    for module in (ordered, linked):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0, raising=False)
    for module in (learn, linked):
        monkeypatch.setattr(module, "pin", lambda df, pin=module.pin: seen.append(plan(df)) or pin(df))
    dbscan = learn.dbscan
    monkeypatch.setattr(learn, "dbscan", lambda *a, **b: (out := dbscan(*a, **b), seen.append(plan(out)))[0])
    return seen


def test_many_rows_are_not_broadcast(spark, plans):
    t = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 0.9 + F.floor(F.col("id") / 1000) * 50).alias("x"))
    got = {r["k"]: int(r["cluster"]) for r in learn.dbscan(t, "k", ["x"], 1.0, 2, scale=False).collect()}
    assert got == {i: i // 1000 * 1000 for i in range(2500)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("axes", [2, 3])
def test_cells_of_many_points_among_many_cells(spark, plans, monkeypatch, axes):
    """Cells of more points than a task should sort meet their facts apart from the others."""
    monkeypatch.setattr(learn, "SORT_ROWS", 20, raising=False)
    test_dense_neighbouring_cells(spark, axes)
    assert any("SortMergeJoin" in p and "BroadcastHashJoin" in p for p in plans)


def test_means_of_planted_centres_whatever_the_scale(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [50, 0], [0, 900], [50, 900]])
    x = np.concatenate([c + rng.normal(0, 1, (n, 2)) * [1, 20] for c, n in zip(centres, (400, 300, 200, 100))])
    t = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k int, a double, b double")
    labels, summary = learn.kmeans_auto(t, ["a", "b"])
    got = np.array([r["cluster"] for r in labels.orderBy("k").collect()])
    assert got.tolist() == [0] * 400 + [1] * 300 + [2] * 200 + [3] * 100
    facts = {(r["cluster"], r["column"]): r for r in summary.collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert len(facts) == 8 and facts[0, "a"]["centre"] == pytest.approx(z[:400, 0].mean()) and facts[2, "b"]["size"] == 200
    # The silhouette of squared distances over all rows, compared with the one from the summary.
    away = np.stack([((z[:, None] - z[got == c][None]) ** 2).sum(axis=2).sum(axis=1) for c in range(4)], axis=1)
    size = np.bincount(got)
    own = away[np.arange(len(x)), got] / (size[got] - 1)
    mean = away / size
    mean[np.arange(len(x)), got] = np.inf
    exact = ((mean.min(axis=1) - own) / np.maximum(mean.min(axis=1), own)).mean()
    assert facts[0, "a"]["silhouette"] == pytest.approx(exact, abs=0.01)


@pytest.mark.parametrize("rows", [[], [(1, 2.0, 3.0)], [(i, 5.0, None) for i in range(20)], [(1, 0.0, 0.0), (2, 1.0, 1.0)]])
def test_constant_few_and_no_rows(spark, rows):
    labels, summary = learn.kmeans_auto(spark.createDataFrame(rows, "k int, a double, b double"), ["a", "b"])
    assert labels.count() == len(rows) and labels.filter("cluster is null").isEmpty()
    assert summary.count() == 2 * len({r[1:] for r in rows})


def test_confusion_matrix_is_square(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c"), ("a", "a"), (None, "a")], "actual string, predicted string")
    got = {(r["actual"], r["predicted"]): r["n"] for r in learn.confusion_matrix(pred).collect()}
    assert len(got) == 16 and got["a", "a"] == 2 and got[None, "a"] == 1 and got["c", "a"] == 0
