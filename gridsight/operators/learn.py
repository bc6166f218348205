"""Isolation forest, projection, clustering and prediction."""
import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import pin
from .common import as_double, col, join_on, numeric_columns, spread
from .components import components
from .ordered import SORT_ROWS, hash_rank, meet, sort_tasks
from .quantiles import quantile_values

def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))


# ---- isolation forest


def _path_constant(n):
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x, rng, limit):
    """One isolation tree as parallel lists: split column (-1 for a leaf), cut, left, right, leaf depth."""
    tree = {"f": [], "t": [], "l": [], "r": [], "h": []}

    def node(rows, depth):
        at = len(tree["f"])
        for name, v in (("f", -1), ("t", 0.0), ("l", -1), ("r", -1), ("h", depth + _path_constant(len(rows)))):
            tree[name].append(v)
        live = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 and depth < limit else []
        if len(live):
            f = int(rng.choice(live))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            below = rows[:, f] < cut
            tree["f"][at], tree["t"][at] = f, cut
            tree["l"][at] = node(rows[below], depth + 1)
            tree["r"][at] = node(rows[~below], depth + 1)
        return at

    node(x, 0)
    return tree


def isolation_forest(df, cols, key, contamination=0.05, seed=42, trees=100, sample=256):
    """Add ``anomaly_score`` (0 to 1) and ``is_outlier`` for the ``contamination`` share with the highest scores.

    Trees are grown in parallel from hash-chosen samples of fixed size; the fitted forest is bounded by
    trees x sample and scores the rows in one pass.
    """
    mid = quantile_values(df, cols, [0.5])
    point = F.array(*[F.coalesce(as_double(c), F.lit(mid[c][0])) for c in cols])
    rows = df.count()
    size = max(1, min(sample, rows))
    # Each tree takes ``size`` neighbours in hash order; a small table is gone through several times.
    ranked = df.select(point.alias("x"), hash_rank(col(key), seed).alias("h")).orderBy("h").limit(trees * size)
    again = F.sequence(F.lit(0), F.lit(max(0, -(-trees * size // max(rows, 1)) - 1)))
    slots = ranked.withColumn("i", F.row_number().over(Window.orderBy("h")) - 1).withColumn("turn", F.explode(again)).withColumn("slot", F.col("i") + rows * F.col("turn"))
    spots = slots.filter(F.col("slot") < trees * size).withColumn("tree", F.floor(F.col("slot") / size).cast("int"))
    limit = math.ceil(math.log2(max(2, size)))

    def fit(pdf):
        t = int(pdf["tree"].iloc[0])
        tree = _grow(np.stack(pdf.sort_values("h")["x"].to_numpy()), np.random.default_rng(seed + t), limit)
        return pd.DataFrame({"tree": [t], **{k: [v] for k, v in tree.items()}})

    forest = [{k: np.array(r[k]) for k in "ftlrh"} for r in spots.groupBy("tree").applyInPandas(
        fit, "tree int, f array<int>, t array<double>, l array<int>, r array<int>, h array<double>").orderBy("tree").collect()]
    scale = max(_path_constant(size), 1e-9)

    @F.pandas_udf("double")
    def score(points: pd.Series) -> pd.Series:
        x = np.stack(points.to_numpy())
        total = np.zeros(len(x))
        for tree in forest:
            at = np.zeros(len(x), dtype=int)
            for _ in range(limit):
                f = tree["f"][at]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[np.arange(len(x)), np.maximum(f, 0)] < tree["t"][at]
                at = np.where(inner, np.where(below, tree["l"][at], tree["r"][at]), at)
            total += tree["h"][at]
        return pd.Series(2.0 ** (-(total / len(forest)) / scale))

    scored = pin(df.withColumn("anomaly_score", score(point)))
    cut = quantile_values(scored, ["anomaly_score"], [1.0 - contamination])["anomaly_score"][0]
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(cut))


def replace_outliers(df, cols, key, contamination=0.05):
    """Set the numeric cells of outlier rows to the column medians."""
    mid = quantile_values(df, cols, [0.5])
    marked = isolation_forest(df, cols, key, contamination)
    return marked.withColumns({c: F.when(F.col("is_outlier"), F.lit(mid[c][0])).otherwise(as_double(c)) for c in cols}).drop("anomaly_score", "is_outlier")


# ---- projection and importance


def _standardised(df, cols):
    """All rows with standardised columns _z0, _z1, ...; a null counts as its column's mean."""
    from .clean import standardize
    names = [f"_z{i}" for i in range(len(cols))]
    scaled = standardize(df.withColumns({n: as_double(c) for n, c in zip(names, cols)}), names)
    return scaled.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def _assembled(df, cols):
    """All rows with standardised features as one vector."""
    names = [f"_z{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(_standardised(df, cols)).drop(*names)


def pca(df, cols, variance=0.95, k=None):
    """(scores, loadings): components that reach the wanted share of variance, each signed by its largest loading."""
    data = _assembled(df, cols)
    model = PCA(k=len(cols), inputCol="_features", outputCol="_pc").fit(data)
    weights, share = model.pc.toArray(), model.explainedVariance.toArray()
    keep = k or int(np.searchsorted(np.cumsum(share), min(variance, float(share.sum()) - 1e-12)) + 1)
    signs = np.array([1.0 if weights[np.argmax(np.abs(weights[:, j])), j] >= 0 else -1.0 for j in range(keep)])
    rows = [(j + 1, c, float(weights[i, j] * signs[j]), float(share[j])) for j in range(keep) for i, c in enumerate(cols)]
    loadings = df.sparkSession.createDataFrame(rows, "component int, column string, loading double, explained_variance double")
    pc = vector_to_array("_pc")
    scores = model.transform(data).withColumns({f"pc{j + 1}": F.get(pc, F.lit(j)) * F.lit(float(signs[j])) for j in range(keep)}).drop("_features", "_pc")
    return scores, loadings


def pca_importance(loadings):
    """Importance of each column: squared loadings weighted by explained variance, as a share."""
    g = loadings.groupBy("column").agg(F.sum(F.col("loading") * F.col("loading") * F.col("explained_variance")).alias("_w"))
    return g.select("column", (F.col("_w") / F.sum("_w").over(Window.partitionBy())).alias("importance"))


def _mean_filled(df, cols):
    """Numeric columns as DOUBLE with nulls set to the column's mean (0 if there is none)."""
    if not cols:
        return df
    mean = df.agg(*[F.coalesce(F.avg(as_double(c)), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return df.withColumns({c: F.coalesce(as_double(c), F.lit(mean[i])) for i, c in enumerate(cols)})


#: Rows of a task that trains a forest: Spark ML keeps them with their weights in all trees and reads them at every level.
FOREST_ROWS = 200_000


def forest_importance(df, target, cols, seed=42):
    """Feature importance of a 50-tree random forest for a numeric target."""
    data = spread(_mean_filled(df.dropna(subset=[target]), cols).select(as_double(target).alias("label"), *[col(c) for c in cols]), FOREST_ROWS)
    model = RandomForestRegressor(numTrees=50, seed=seed, featuresCol="_features").fit(VectorAssembler(inputCols=cols, outputCol="_features").transform(data))
    return df.sparkSession.createDataFrame(list(zip(cols, map(float, model.featureImportances.toArray()))), "column string, importance double").orderBy(F.desc("importance"), "column")


# ---- clustering


LEAVES = 4096
TRIES = 5


def cluster_features(rows, names, most=LEAVES):
    """(n ARRAY, means, mean squared lengths) of the rows' cells in the finest grid that has about ``most`` cells at most.

    The widths are powers of two, so a cell of one grid lies in one of the next coarser: one pass counts the cells of all
    widths by sketches, a second sums up the cells of the chosen width, each task its own first."""
    widths = [2.0 ** -i for i in range(-6, 9)]
    cell = lambda w: [F.floor(F.col(c) / w) for c in names]
    counts = rows.agg(*[F.approx_count_distinct(F.xxhash64(*cell(w))).alias(f"w{i}") for i, w in enumerate(widths)]).first()
    width = next((w for i, w in reversed(list(enumerate(widths))) if counts[i] <= most), widths[0])
    sums = rows.groupBy(*cell(width)).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], F.sum(sum(F.col(c) * F.col(c) for c in names)).alias("q"))
    held = sums.select("n", *[f"s{i}" for i in range(len(names))], "q").toPandas()
    # Spark gives cells in any order; the search below must not depend on it.
    held = held.sort_values(list(held.columns)).to_numpy(dtype=float).reshape(-1, len(names) + 2)
    n = np.maximum(held[:, 0], 1.0)
    return held[:, 0], held[:, 1:-1] / n[:, None], held[:, -1] / n


def _weighted_means(n, x, k, rng, rounds=100):
    """The best of some runs of k-means on weighted points: (cost, centres, labels)."""
    best = None
    for _ in range(TRIES):
        centres = x[[rng.choice(len(x), p=n / n.sum())]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * n
            if d.sum() <= 0:
                break
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())]])
        label = None
        for _ in range(rounds):
            d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
            now = d.argmin(axis=1)
            if label is not None and (now == label).all():
                break
            label = now
            for c in np.unique(label):
                centres[c] = np.average(x[label == c], axis=0, weights=n[label == c])
        cost = float((d.min(axis=1) * n).sum())
        if best is None or cost < best[0] - 1e-12:
            best = cost, centres, label
    return best


def _silhouette(n, x, squares, label):
    """Of squared distances, from sums per cluster: what single points would give, but for the spread inside a cell."""
    used, label = np.unique(label, return_inverse=True)
    size = np.bincount(label, weights=n)
    total = np.stack([np.bincount(label, weights=n * x[:, i]) for i in range(x.shape[1])], axis=1)
    length = np.bincount(label, weights=n * squares)
    away = squares[:, None] + (length / size)[None] - 2 * x @ (total / size[:, None]).T
    own = away[np.arange(len(x)), label] * size[label] / np.maximum(size[label] - 1, 1)
    away[np.arange(len(x)), label] = np.inf
    other = away.min(axis=1)
    top = np.maximum(own, other)
    s = np.where((size[label] > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1.0), 0.0)
    return float((s * n).sum() / n.sum())


def kmeans_auto(df, cols, max_k=10, seed=42):
    """(labels, summary): k-means on standardised columns with the k of the best silhouette; clusters numbered by size.

    All k are fitted and judged on cluster features, a bounded summary of the rows; then each row gets its nearest
    centre. k is at most the number of distinct cells; rows that are all equal are one cluster without a silhouette.
    """
    names = [f"_z{i}" for i in range(len(cols))]
    data = pin(_standardised(df, cols))
    n, x, squares = cluster_features(data, names)
    score, centres = None, np.zeros((1, len(cols)))
    for k in range(2, min(max_k, len(n)) + 1):
        _, found, label = _weighted_means(n, x, k, np.random.default_rng(seed))
        if len(np.unique(label)) > 1:
            here = _silhouette(n, x, squares, label)
            if score is None or here > score:
                score, centres = here, found[np.unique(label)]
    away = [sum((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(names, centre)) for centre in centres]
    nearest = F.array_position(F.array(*away), F.array_min(F.array(*away))).cast("int") - 1
    labelled = pin(data.withColumn("_c", nearest))
    means = labelled.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names]).collect()
    order = {r["_c"]: i for i, r in enumerate(sorted(means, key=lambda r: (-r["n"], *[r[c] for c in names])))}
    number = F.get(F.array(*[F.lit(order.get(c, -1)) for c in range(len(centres))]), F.col("_c"))
    labels = labelled.withColumn("cluster", number).drop(*names, "_c")
    rows = [(order[r["_c"]], r["n"], score, name, float(r[z])) for r in means for name, z in zip(cols, names)]
    return labels, df.sparkSession.createDataFrame(rows, "cluster int, size long, silhouette double, column string, centre double")


def _linked_cells(core, links, rows, tasks, axes, side, eps):
    """The pairs of cells (a, b) of ``links`` that have core points within eps of each other.

    Each cell's points are summed up in sub-cells with exact envelopes. Two envelopes that lie wholly within eps settle a pair,
    two that lie apart say nothing; points are compared only between the others, and only for pairs that are open.
    """
    fine = side / (4 if axes <= 2 else 2)
    points = core.withColumn("s", F.transform("x", lambda v: F.floor(v / fine)))
    ends = lambda f: F.array(*[f(F.get("x", F.lit(i))) for i in range(axes)])
    subs = pin(points.groupBy("c", "s").agg(ends(F.min).alias("lo"), ends(F.max).alias("hi")))
    of = lambda c: subs.select(F.col("c").alias(c), F.col("s").alias(f"s{c}"), F.col("lo").alias(f"lo{c}"), F.col("hi").alias(f"hi{c}"))
    over = lambda u, v: F.zip_with(u, v, lambda x, y: x - y)
    length = lambda p, q, least: F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: F.greatest(x, y, F.lit(least))), F.lit(0.0), lambda t, v: t + v * v))
    near = meet(meet(links, of("a"), ["a"], rows, tasks), of("b"), ["b"], rows, tasks)
    near = near.withColumn("gap", length(over("lob", "hia"), over("loa", "hib"), 0.0)).withColumn("span", length(over("hib", "loa"), over("hia", "lob"), 0.0))
    near = pin(near.filter(F.col("gap") <= eps).select("a", "b", "sa", "sb", (F.col("span") <= eps).alias("sure")))
    pairs = near.count()
    sure = near.filter("sure").select("a", "b").distinct()
    left = meet(near, sure, ["a", "b"], pairs, tasks, "left_anti")
    left = meet(left, points.select(F.col("c").alias("a"), F.col("s").alias("sa"), "x"), ["a", "sa"], rows, tasks)
    open_ = meet(left, points.select(F.col("c").alias("b"), F.col("s").alias("sb"), F.col("x").alias("y")), ["b", "sb"], rows, tasks)
    open_ = open_.filter(_distance(F.col("x"), F.col("y")) <= eps)
    return sure.unionByName(open_.select("a", "b").distinct())


def _of_cells(points, facts, hot, rows, tasks):
    """The points with the facts of their cells ``c``; the few cells in ``hot`` have many points and meet them by broadcast."""
    if hot is None:
        return meet(points, facts, ["c"], rows, tasks)
    often = points.join(F.broadcast(facts.join(F.broadcast(hot), "c", "left_semi")), "c")
    return often.unionByName(meet(points.join(F.broadcast(hot), "c", "left_anti"), facts, ["c"], rows, tasks))


def dbscan(df, key, cols, eps=0.5, min_samples=None, scale=True):
    """(key, cluster): density clusters named by their smallest key, -1 for noise, null for rows with a null coordinate.

    Cells have a diagonal of eps, so all points of a cell with ``min_samples`` points are core and
    belong together, and clusters are components of cells. Pairs of points are compared only where cell
    geometry leaves the answer open. Tables of many rows meet in tasks of about ``SORT_ROWS``; only checked small ones are broadcast.
    """
    from .clean import standardize
    names = [f"_x{i}" for i in range(len(cols))]
    given = df.select(col(key).alias("k"), *[as_double(c).alias(n) for c, n in zip(cols, names)])
    rows = given.dropna(subset=names)
    rows = standardize(rows, names) if scale else rows
    n = rows.count()
    need = min_samples or max(2, n // 100)
    side = eps / math.sqrt(len(cols))
    at = F.array(*[F.floor(F.col(x) / side) for x in names])
    placed = pin(rows.select("k", F.array(*names).alias("x"), at.alias("at")))
    # Cells go by a number c; the places ``at`` are kept for their geometry.
    cells = pin(placed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.monotonically_increasing_id()))
    m, full = cells.agg(F.count(F.lit(1)), F.max("n")).first()
    hot = lambda c: cells.filter(F.col("n") > SORT_ROWS).select(c) if (full or 0) > SORT_ROWS else None
    by_place = lambda t: t.withColumnRenamed("at", "c")
    points = pin(_of_cells(by_place(placed), by_place(cells.withColumnRenamed("c", "id")), hot(F.col("at").alias("c")), m, sort_tasks(df.sparkSession, n))
                 .select("k", "x", F.col("id").alias("c"), "n"))
    reach = math.ceil(math.sqrt(len(cols)))
    # Pairs of occupied cells that may hold neighbours, found through a coarse cell of side eps on two axes.
    wide = lambda c: [F.floor(F.get(c, F.lit(i)) * side / eps).alias(f"w{i}") for i in range(min(2, len(cols)))]
    axes = min(2, len(cols))
    near = cells.select(F.col("c").alias("a"), F.col("at").alias("ca"), *wide(F.col("at")))
    for i in range(axes):
        near = near.withColumn("_s", F.explode(F.array(*[F.lit(s).cast("long") for s in (-2, -1, 0, 1, 2)]))).withColumn(f"w{i}", F.col(f"w{i}") + F.col("_s")).drop("_s")
    gap = F.aggregate(F.zip_with("ca", "cb", lambda u, v: F.greatest(F.abs(u - v) - 1, F.lit(0))), F.lit(0.0), lambda s, v: s + v * v)
    others = cells.select(F.col("c").alias("b"), F.col("at").alias("cb"), F.col("n").alias("nb"), *wide(F.col("at")))
    touching = pin(meet(near, others, [f"w{i}" for i in range(axes)], m, sort_tasks(df.sparkSession, m * 5 ** axes))
                   .filter(F.sqrt(gap) * side <= eps).filter(F.forall(F.zip_with("ca", "cb", lambda u, v: F.abs(u - v)), lambda v: v <= reach))
                   .select("a", "b", "nb", "cb"))
    links = touching.count()
    tasks = sort_tasks(df.sparkSession, max(n, links))
    corner = lambda c, far: F.zip_with(c, "x", lambda u, v: (F.greatest(F.abs(u * side - v), F.abs((u + 1) * side - v)) if far
                                                          else F.greatest(u * side - v, v - (u + 1) * side, F.lit(0.0))))
    length = lambda arr: F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, v: s + v * v))
    sparse = points.filter(F.col("n") < need).select("k", "x", F.col("c").alias("a"))
    against = meet(sparse, touching, ["a"], links, tasks)
    against = against.filter(length(corner("cb", False)) <= eps).withColumn("_inside", length(corner("cb", True)) <= eps).select("k", "x", "b", "nb", "_inside")
    sure = pin(against.groupBy("k").agg(F.sum(F.when(F.col("_inside"), F.col("nb")).otherwise(0)).alias("m"), F.sum("nb").alias("most")))
    open_ = sure.filter((F.col("m") < need) & (F.col("most") >= need)).select("k", "m")
    pairs = meet(meet(against.filter(~F.col("_inside")), open_, ["k"], n, tasks), points.select(F.col("x").alias("y"), F.col("c").alias("b")), ["b"], n, tasks)
    extra = pairs.filter(_distance(F.col("x"), F.col("y")) <= eps).groupBy("k").agg(F.count(F.lit(1)).alias("e"))
    some = meet(open_, extra, ["k"], n, tasks, "left").filter(F.col("m") + F.coalesce("e", F.lit(0)) >= need).select("k")
    core_keys = pin(sure.filter(F.col("m") >= need).select("k").unionByName(some))
    thin = points.filter(F.col("n") < need)
    core = pin(points.filter(F.col("n") >= need).unionByName(meet(thin, core_keys, ["k"], n, tasks, "left_semi")).select("k", "x", "c"))
    core_cells = pin(core.groupBy("c").agg(F.min("k").alias("label")))
    name = lambda c: core_cells.select(F.col("c").alias(c), F.col("label").alias(f"_{c}"))
    half = meet(meet(touching.filter(F.col("a") < F.col("b")).select("a", "b"), name("a"), ["a"], m, tasks), name("b"), ["b"], m, tasks)
    linked = _linked_cells(core, half.select("a", "b"), n, tasks, len(cols), side, eps)
    roots, _ = components(meet(half, linked, ["a", "b"], links, tasks, "left_semi").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    named = meet(core_cells.withColumnRenamed("label", "node"), roots, ["node"], m, tasks, "left")
    labels = named.select("c", F.coalesce("root", "node").alias("label"))
    core_labels = _of_cells(core, labels, hot("c"), m, tasks)
    loose = meet(thin, core_keys, ["k"], n, tasks, "left_anti").select("k", "x", F.col("c").alias("a"))
    border = meet(loose, touching.select("a", "b"), ["a"], links, tasks)
    border = meet(border, core_labels.select(F.col("x").alias("y"), F.col("c").alias("b"), "label"), ["b"], n, tasks).filter(
        _distance(F.col("x"), F.col("y")) <= eps).groupBy("k").agg(F.min("label").alias("label"))
    out = core_labels.select("k", "label").unionByName(meet(loose.select("k"), border, ["k"], n, tasks, "left"))
    named = out.select("k", F.coalesce(F.col("label").cast("string"), F.lit("-1")).alias("cluster"))
    blank = given.filter(F.greatest(*[F.col(n).isNull().cast("int") for n in names], F.lit(0)) == 1)
    return named.unionByName(blank.select("k", F.lit(None).cast("string").alias("cluster"))).withColumnRenamed("k", key)


def cluster_projection(labels, cols, n=1000, key=None):
    """(pc1, pc2, cluster): the first two components of labelled rows, for at most n hash-chosen rows."""
    scores, _ = pca(labels, cols, k=2)
    if key is not None:
        scores = scores.orderBy(hash_rank(col(key))).limit(n)
    return scores.select(*([key] if key else []), "pc1", "pc2", "cluster")


# ---- prediction


def predict(df, key, target, features, model_type, test_size=0.2, seed=42):
    """(predictions, metrics, importance) of a random forest; rows are split by a hash of the key."""
    from .relational import split
    num = set(numeric_columns(df))
    # Rows without a target cannot be learnt from or judged; all others take part, nulls as means or as a value of their own.
    rows = df.dropna(subset=[target]).select(*[col(c) for c in dict.fromkeys([key, target, *features])])
    data = spread(_mean_filled(rows, [f for f in features if f in num]), FOREST_ROWS)
    widest = 32
    for c in [f for f in features if f not in num]:
        index = StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep").fit(data)
        data, widest = index.transform(data), max(widest, len(index.labels) + 1)
    inputs = [c if c in num else f"_i_{c}" for c in features]
    data = VectorAssembler(inputCols=inputs, outputCol="_features").transform(data)
    classes = None
    if model_type == "classification":
        indexer = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(data)
        data, classes = indexer.transform(data), indexer.labels
        forest = RandomForestClassifier(featuresCol="_features", numTrees=50, seed=seed, maxBins=widest)
    else:
        data = data.withColumn("label", as_double(target))
        forest = RandomForestRegressor(featuresCol="_features", numTrees=50, seed=seed, maxBins=widest)
    train, test = split(data, key, 1.0 - test_size, seed)
    model = forest.fit(train)
    out = model.transform(test)
    if classes:
        names = F.array(*[F.lit(c) for c in classes])
        predictions = pin(out.select(key, col(target).cast("string").alias("actual"), F.get(names, F.col("prediction").cast("int")).alias("predicted")))
        metrics = classification_metrics(predictions)
    else:
        predictions = pin(out.select(key, F.col("label").alias("actual"), F.col("prediction").alias("predicted")).withColumn("error", F.col("actual") - F.col("predicted")))
        metrics = regression_metrics(predictions)
    importance = df.sparkSession.createDataFrame(list(zip(features, map(float, model.featureImportances.toArray()))), "column string, importance double")
    return predictions, metrics, importance


def regression_metrics(pred):
    e = F.col("actual") - F.col("predicted")
    return pred.agg((1 - F.sum(e * e) / (F.var_pop("actual") * F.count(F.lit(1)))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def classification_metrics(pred):
    """Accuracy and support-weighted F1."""
    cells = pred.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    a = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(right).alias("hit"))
    p = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    both = a.join(p, "label", "left")
    f1 = 2 * F.col("hit") / (F.col("support") + F.coalesce("said", F.lit(0)))
    return both.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def confusion_matrix(pred):
    """Counts of every (actual, predicted) pair of labels, zeros included: the square of the label table, which is small beside the rows."""
    cells = pred.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    labels = pin(cells.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct())
    grid = labels.withColumnRenamed("label", "actual").crossJoin(labels.withColumnRenamed("label", "predicted"))
    return join_on(grid, cells, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def actual_vs_predicted(pred, key):
    return pred.select(key, "actual", "predicted", (F.col("actual") - F.col("predicted")).alias("error"))
