"""Approximate nearest neighbours by cosine: a few stable projections, indexed by a kd-tree, with a chi-square stopping test.

Vectors are scaled to length 1 and projected on ``dims`` Gaussian directions. For two vectors at distance d, the squared projected
distance divided by d^2 follows a chi-square law with ``dims`` degrees of freedom. A query visits projected neighbours from near
to far and verifies each on the original vector. It stops where the law says that a neighbour nearer than the k-th found so far
would, with probability ``sure``, have been met already.

A kd-tree over a bounded sample (about ``fit_rows`` points, at most twice as many) cuts the projected space into cells; every row of the table is indexed in its
cell, one file per cell and part in the shared folder, where a kd-tree orders its rows into leaves. Query blocks are dealt to tasks;
a task reads one file at a time and skips files that the stopping test rules out for all of its queries.

Equal vectors are one point of the index with their ``k + 1`` smallest ids, so a vector that a third of the rows share is one point.
No id that could be returned is lost. Ties go to the smaller id. Vectors that are null, empty, zero, of another length than
``width`` or hold null or non-finite components take no part, nor do rows with a null id; rows that repeat an id and its vector
count once, and a query never returns its own id. Other columns are ignored. With fewer than k candidates all are returned.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.common import col
from .common import read_file, shared_folder, stored, write_file

DIMS = 8
SURE = 0.99
FIT_ROWS = 20_000
CELL_ROWS = 16_384
MOST_CELLS = 2048
LEAF_ROWS = 128
SEED = 7
FOUND = "query bigint, rank int, place bigint, score double"


def gamma_p(a, x):
    """Regularized lower incomplete gamma function of an array, by its power series."""
    x = np.asarray(x, dtype=np.float64)
    term = np.full(x.shape, 1.0 / a)
    total = term.copy()
    for n in range(1, 400):
        term = term * x / (a + n)
        total += term
        if (term <= total * 1e-15).all():
            break
    log_gamma = np.sum(np.log(np.arange(a - 1, 0, -1))) if a == int(a) else np.log(np.sqrt(np.pi)) + np.sum(np.log(np.arange(a - 1, 0, -1)))
    with np.errstate(divide="ignore"):
        return np.minimum(total * np.exp(a * np.log(x) - x - log_gamma), 1.0)


def chi_square_quantile(sure, dims):
    """The value below which a chi-square variable with ``dims`` degrees of freedom stays with probability ``sure``."""
    low, high = 0.0, 20.0 * dims + 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if gamma_p(dims / 2, middle / 2) > sure else (middle, high)
    return high


def directions(width, dims, seed=SEED):
    return np.random.default_rng(seed).standard_normal((width, dims))


def unit(vectors):
    vectors = np.asarray(vectors, dtype=np.float64)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def kd_split(points, most):
    """Cut points into boxes of at most ``most``: (order of the points, first position of each box)."""
    order, starts, open_ = np.arange(len(points)), [], [(0, len(points))]
    while open_:
        lo, hi = open_.pop()
        part = points[order[lo:hi]]
        if hi - lo <= most:
            starts.append(lo)
            continue
        axis = np.argmax(part.max(axis=0) - part.min(axis=0))
        middle = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], middle)]
        open_ += [(lo + middle, hi), (lo, lo + middle)]
    return order, np.array(sorted(starts))


def kd_cuts(points, depth):
    """Cut planes of a kd-tree of ``depth`` levels in heap order: (axis, value) of every inner node."""
    cuts, nodes = [], [points]
    for _ in range(depth):
        further = []
        for part in nodes:
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            cuts.append((axis, value))
            further += [part[part[:, axis] < value], part[part[:, axis] >= value]]
        nodes = further
    return cuts


def cell_of(points, cuts, depth):
    """The cell of each point: walk down the cut planes."""
    node = np.zeros(len(points), dtype=np.int64)
    axes, values = np.array([c[0] for c in cuts], dtype=np.int64), np.array([c[1] for c in cuts])
    for _ in range(depth):
        right = points[np.arange(len(points)), axes[node]] >= values[node]
        node = 2 * node + 1 + right
    return node - (2 ** depth - 1)


def box_distance(points, low, high):
    """Squared distance of each point (row) to each box (column)."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0.0)
    return np.einsum("ijk,ijk->ij", gap, gap)


class Cell:
    """The rows of one index file in kd-tree order."""

    def __init__(self, ids, vectors, planes, leaf_rows=LEAF_ROWS):
        points = unit(vectors) @ planes
        order, self.starts = kd_split(points, leaf_rows)
        self.ids, self.vectors, self.points = ids[order], vectors[order].astype(np.float64), points[order]
        self.length = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.low, self.high = np.minimum.reduceat(self.points, self.starts), np.maximum.reduceat(self.points, self.starts)
        self.ends = np.append(self.starts[1:], len(ids))


class Best:
    """The best ``k`` ids of each query so far, ties to the smaller id."""

    def __init__(self, queries, k):
        self.k, self.score, self.id = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def farthest(self, q):
        """Squared distance of unit vectors to the k-th found; infinite until there are k."""
        return 2.0 - 2.0 * self.score[q, -1]

    def offer(self, q, ids, scores):
        all_ids, all_scores = np.concatenate((self.id[q], ids)), np.concatenate((self.score[q], scores))
        top = np.lexsort((all_ids, -all_scores))[: self.k]
        self.id[q], self.score[q] = all_ids[top], all_scores[top]


def search_cell(cell, vectors, points, best, limit):
    """Let every query verify the neighbours in this cell until the stopping test holds. Returns the vectors verified."""
    verified = 0
    near = box_distance(points, cell.low, cell.high)
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    for q in range(len(vectors)):
        for leaf in np.argsort(near[q], kind="stable"):
            reach = limit * best.farthest(q)
            if near[q, leaf] > reach:
                break
            rows = slice(cell.starts[leaf], cell.ends[leaf])
            gap = cell.points[rows] - points[q]
            here = cell.starts[leaf] + np.nonzero(np.einsum("ij,ij->i", gap, gap) <= reach)[0]
            if len(here):
                scores = np.einsum("ij,j->i", cell.vectors[here], vectors[q]) / (cell.length[here] * length[q])
                best.offer(q, cell.ids[here], scores)
                verified += len(here)
    return verified


def usable(table, key, vector, width):
    """(id, vector as array<double>) of the rows that take part."""
    rows = table.select(col(key).cast("long").alias("id"), col(vector).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.filter(F.col("id").isNotNull() & (F.size("vector") == width) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0.0))


def distinct_vectors(rows, k):
    """(place, vector, ids): every distinct vector with its k + 1 smallest ids; place is the smallest."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("place", F.element_at("ids", 1))


def _stack(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def build_index(points, width, dims=DIMS, fit_rows=FIT_ROWS, cell_rows=CELL_ROWS):
    """Write the index; returns (paths, low and high corner of each file's box). At most ``MOST_CELLS`` cells, however many rows."""
    spark = points.sparkSession
    planes = directions(width, dims)
    count = points.count()
    depth = min(int(MOST_CELLS).bit_length() - 1, max(0, -(-count // cell_rows) - 1).bit_length())
    # A hash range that holds about ``fit_rows`` ids, with a hard bound.
    picked = F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / max(count, 1)))
    sample = points.select("vector").filter(picked).limit(2 * fit_rows) if depth else points.limit(0).select("vector")
    fitted = np.array(sample.toPandas()["vector"].tolist(), dtype=np.float64).reshape(-1, width)
    cuts = kd_cuts(unit(fitted) @ planes, depth) if depth else []
    folder = shared_folder(spark, "nearest-index")

    def place_rows(batches):
        for batch in batches:
            vectors = _stack(batch.column(1))
            cells = cell_of(unit(vectors) @ planes, cuts, depth) if len(vectors) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells)], names=["place", "vector", "cell"])

    def write(batches):
        held, kept = {}, 0

        def flush():
            for cell, parts in held.items():
                ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                out, path = write_file(folder, f"cell-{cell}")
                with out:
                    out.write(np.array([len(ids), width], dtype="<i8").tobytes() + ids.astype("<i8").tobytes() + vectors.astype("<f8").tobytes())
                box = unit(vectors) @ planes
                yield pa.RecordBatch.from_pydict({"path": [path], "low": [box.min(axis=0)], "high": [box.max(axis=0)]})

        for batch in batches:
            ids, vectors, cells = batch.column(0).to_numpy(), _stack(batch.column(1)), batch.column(2).to_numpy()
            for cell in np.unique(cells):
                held.setdefault(int(cell), []).append((ids[cells == cell], vectors[cells == cell]))
            kept += len(ids)
            if kept >= 4 * cell_rows:
                yield from flush()
                held, kept = {}, 0
        yield from flush()

    placed = points.select("place", "vector").mapInArrow(place_rows, "place long, vector array<double>, cell long")
    files = stored(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(write, "path string, low array<double>, high array<double>"), "nearest-files").toPandas()
    corners = lambda name: np.array(files[name].tolist(), dtype=np.float64).reshape(-1, dims)
    return files["path"].tolist(), corners("low"), corners("high")


def load_cell(path, planes):
    with read_file(path) as source:
        data = source.read()
    n, width = np.frombuffer(data, "<i8", 2)
    ids = np.frombuffer(data, "<i8", n, 16)
    return Cell(ids, np.frombuffer(data, "<f8", n * width, 16 + 8 * n).reshape(n, width), planes)


def search(table, is_query, k=5, key="vec_id", vector="embedding", width=None, dims=DIMS, sure=SURE, cell_rows=CELL_ROWS):
    """(query_id, rank, vec_id, score): the k nearest candidates found for each row that ``is_query`` (a condition on ``id``) picks."""
    spark = table.sparkSession
    if width is None:
        first = table.filter(F.size(col(vector)) > 0).select(F.size(col(vector)).alias("n")).groupBy().agg(F.mode("n").alias("n")).first()["n"]
        width = first or 1
    rows = usable(table, key, vector, width).distinct()
    points = stored(distinct_vectors(rows, k), "nearest-points")
    asked = stored(rows.filter(is_query).select("id", "vector"), "nearest-queries")
    queries = asked.groupBy("vector").agg(F.min("id").alias("query"))
    paths, low, high = build_index(points, width, dims, cell_rows=cell_rows)
    planes, limit = directions(width, dims), chi_square_quantile(sure, dims)
    boxes = spark.sparkContext.broadcast((paths, low, high))

    def run(batches):
        paths, low, high = boxes.value
        for batch in batches:
            if not batch.num_rows or not paths:
                continue
            vectors = _stack(batch.column(1))
            projected = unit(vectors) @ planes
            best = Best(len(vectors), k + 1)
            near = box_distance(projected, low, high)
            # The files nearest to some query come first, so bounds are tight early.
            for file in np.argsort(near.min(axis=0), kind="stable"):
                open_ = np.nonzero(near[:, file] <= limit * (2.0 - 2.0 * best.score[:, -1]))[0]
                if len(open_):
                    part = Best(len(open_), k + 1)
                    part.score, part.id = best.score[open_], best.id[open_]
                    search_cell(load_cell(paths[file], planes), vectors[open_], projected[open_], part, limit)
                    best.score[open_], best.id[open_] = part.score, part.id
            q, rank = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_numpy()[q]), pa.array((rank + 1).astype(np.int32)), pa.array(best.id[q, rank]), pa.array(best.score[q, rank])],
                names=["query", "rank", "place", "score"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = queries.select("query", "vector").repartition(tasks, "query").mapInArrow(run, FOUND)
    # From points back to rows: every id of a found point, every query that has the asked vector.
    hits = found.join(points.select("place", "ids"), "place").select("query", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("hits"))
    answers = asked.join(queries, "vector").select("id", "query").join(lists, "query")
    own = F.filter("hits", lambda h: h["id"] != F.col("id"))
    return answers.select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
