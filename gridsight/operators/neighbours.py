"""Exact nearest neighbours over all axes, with nulls: a kd-tree deals the donors into cells of about equal size.

The tree is fitted on a bounded hash sample of the donors (this decides sizes only); every donor is dealt, and the cells'
envelopes and sizes are exact. A query first visits the cell whose envelope is nearest and finds its k best there. Their
largest distance bounds the search: all other cells whose envelope is not farther are visited in a second round.
Cells that many queries visit are copied to several tasks, so a hot cell is no single task.

The distance runs over the axes that both points have, and is scaled up by the share of axes left out: sqrt(m / shared *
sum of squares). Donors with the same axes null form a tree of their own, whose envelopes bound that distance, too.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import pin
from .common import as_double, col

CELL_ROWS = 8192
SLICE_ROWS = 32768
MOST_CELLS = 1 << 14
SAMPLE_PER_CELL = 32
BLOCK = 1 << 21
#: Farther than any distance: marks a visit that no second round follows.
FAR = np.finfo(np.float64).max


class Cells:
    """kd-trees over points with NaN for missing axes, one tree per set of present axes."""

    def __init__(self, points, leaf):
        self.axis, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.roots, self.count = {}, 0
        pattern = self.patterns(points)
        for p in np.unique(pattern).tolist():
            self.roots[p] = self._grow(points[pattern == p], leaf)

    @staticmethod
    def patterns(points):
        """A number for the set of present axes of each point."""
        return ((~np.isnan(points)).astype(np.int64) << np.arange(points.shape[1])).sum(axis=1)

    def _grow(self, points, leaf):
        at = len(self.axis)
        for held, value in ((self.axis, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.leaf, -1)):
            held.append(value)
        if len(points) > leaf:
            with np.errstate(all="ignore"):
                spread = np.where(np.isnan(points[0]), 0.0, points.max(axis=0) - points.min(axis=0))
            axis = int(spread.argmax())
            if spread[axis] > 0:
                values = points[:, axis]
                cut = float(np.median(values))
                if not (values < cut).any():
                    cut = float(values[values > values.min()].min())
                below = values < cut
                self.axis[at], self.cut[at] = axis, cut
                self.left[at] = self._grow(points[below], leaf)
                self.right[at] = self._grow(points[~below], leaf)
                return at
        self.leaf[at] = self.count
        self.count += 1
        return at

    def of(self, points):
        """The cell of each point; sets of axes that no tree knows have a cell of their own below zero."""
        axis, cut, left, right, leaf = (np.array(x) for x in (self.axis, self.cut, self.left, self.right, self.leaf))
        pattern = self.patterns(points)
        node = np.array([self.roots.get(p, -1) for p in pattern.tolist()], dtype=np.int64)
        out = -1 - pattern
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            here = node[open_]
            inner = axis[here] >= 0
            out[open_[~inner]] = leaf[here[~inner]]
            open_, here = open_[inner], here[inner]
            node[open_] = np.where(points[open_, axis[here]] < cut[here], left[here], right[here])
        return out


def shared_distance(a, b, bounds=None):
    """Distances of all rows of ``a`` to all of ``b`` (infinite without a shared axis). With ``bounds`` = (lo, hi), to boxes."""
    total, shared = np.zeros((len(a), len(b if bounds is None else bounds[0]))), 0
    plain = bounds is None and not np.isnan(a).any() and not np.isnan(b).any()
    for i in range(a.shape[1]):
        x = a[:, i:i + 1]
        if bounds is None:
            gap = x - b[:, i]
        else:
            lo, hi = bounds[0][:, i], bounds[1][:, i]
            gap = np.maximum(np.maximum(lo - x, x - hi), 0.0)
        if plain:
            total += gap * gap
        else:
            seen = ~np.isnan(gap)
            shared = shared + seen
            total += np.where(seen, gap * gap, 0.0)
    if plain:
        return np.sqrt(total)
    with np.errstate(all="ignore"):
        return np.where(shared > 0, np.sqrt(total * (a.shape[1] / np.maximum(shared, 1))), np.inf)


def _matrix(table, names):
    """Columns of a table or batch as a matrix, null as NaN."""
    return np.column_stack([np.asarray(table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(n).to_numpy(), dtype=np.float64) for n in names]) if len(names) else np.zeros((table.num_rows, 0))


def k_best(x, y, k, far):
    """(row of x, row of y, distance) of the k best rows of ``y`` for each row of ``x`` within its ``far``; ties to the earlier row."""
    step = max(1, BLOCK // max(1, len(y)))
    found = []
    for start in range(0, len(x), step):
        dist = shared_distance(x[start:start + step], y)
        most = far[start:start + step, None]
        if dist.shape[1] > k:
            most = np.minimum(most, np.partition(dist, k - 1, axis=1)[:, k - 1:k])
        row, at = np.nonzero((dist <= most) & np.isfinite(dist))
        d = dist[row, at]
        order = np.lexsort((at, d, row))
        row, at, d = row[order], at[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, at, d = row[place < k], at[place < k], d[place < k]
        found.append((row + start, at, d))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def home_cells(x, lo, hi):
    """(cell, whether it shares an axis) of the nearest box (lo, hi) for each row of ``x``; a block of rows against all boxes at a time."""
    step = max(1, BLOCK // max(1, len(lo)))
    best, reach = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    for start in range(0, len(x), step):
        bound = shared_distance(x[start:start + step], None, (lo, hi))
        best[start:start + step], reach[start:start + step] = bound.argmin(axis=1), np.isfinite(bound).any(axis=1)
    return best, reach


def cells_within(x, far, lo, hi):
    """Blocks (row of x, box): the boxes not farther than ``far`` from each row."""
    step = max(1, BLOCK // max(1, len(lo)))
    for start in range(0, len(x), step):
        bound = shared_distance(x[start:start + step], None, (lo, hi))
        row, at = np.nonzero((bound <= far[start:start + step, None] * (1 + 1e-9)) & np.isfinite(bound))
        yield row + start, at


def _visit(asked, donors, names, k, slice_rows):
    """(q, xs, cell, far, d ARRAY, distance ARRAY): the k best donors of the asked cell for each row of ``asked`` (q, xs, cell, far)."""
    spark = asked.sparkSession
    kinds = dict(asked.dtypes)["q"], dict(donors.dtypes)["d"]
    slices = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    # At most a row per cell.
    slices = F.broadcast(spark.createDataFrame(slices.collect(), "cell long, slices int"))
    left = asked.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("q", *names), F.col("slices")).cast("int")).drop("slices")
    right = donors.join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def run(mine, theirs):
        theirs = theirs.take(pc.sort_indices(theirs, sort_keys=[("d", "ascending")], null_placement="at_end"))
        x, y = _matrix(mine, names), _matrix(theirs, names)
        row, at, dist = k_best(x, y, k, mine.column("far").to_numpy())
        ends = np.searchsorted(row, np.arange(mine.num_rows + 1)).astype(np.int32)
        ids = theirs.column("d").combine_chunks().take(pa.array(at, pa.int64()))
        out = mine.select(["q", *names, "cell", "far"])
        out = out.append_column("d", pa.ListArray.from_arrays(pa.array(ends), ids))
        return out.append_column("distance", pa.ListArray.from_arrays(pa.array(ends), pa.array(dist)))

    schema = f"q {kinds[0]}, {', '.join(f'{n} double' for n in names)}, cell long, far double, d array<{kinds[1]}>, distance array<double>"
    return left.groupBy("cell", "slice").cogroup(right.groupBy("cell", "slice")).applyInArrow(run, schema)


def nearest(queries, donors, cols, k, key, donor_key, cell_rows=CELL_ROWS, slice_rows=SLICE_ROWS):
    """(key, donor_key, distance, rank): the exact k nearest donors of each query, ties by key.

    Nulls (and NaN) are axes left out of the distance. Donors without any axis are nobody's neighbours, queries
    without any shared axis have none. Fewer donors than ``k`` are all returned.
    """
    spark = queries.sparkSession
    names = [f"x{i}" for i in range(len(cols))]
    point = [as_double(c).alias(n) for c, n in zip(cols, names)]
    q = pin(queries.select(col(key).alias("q"), *point))
    # At most k donors of each distinct point can ever be among the nearest.
    first = Window.partitionBy(*names).orderBy(F.asc_nulls_last("d"))
    d = donors.select(col(donor_key).alias("d"), *point).filter(F.coalesce(*names).isNotNull())
    d = pin(d.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r"))
    total = d.count()
    kinds = dict(q.dtypes)["q"], dict(d.dtypes)["d"]
    if not total:
        return spark.createDataFrame([], f"q {kinds[0]}, d {kinds[1]}, distance double, rank int").withColumnsRenamed({"q": key, "d": donor_key})
    wanted = min(MOST_CELLS, -(-total // cell_rows))
    share = min(1.0, wanted * SAMPLE_PER_CELL / total) if wanted > 1 else 0.0
    sample = d if share == 1.0 else d.filter(F.pmod(F.xxhash64(*names), F.lit(1_000_000)) < int(share * 1_000_000))
    held = sample.select(*names).toArrow()
    points = _matrix(held, names) if held.num_rows else np.zeros((0, len(names)))
    cells = Cells(points, max(1, -(-len(points) // wanted)))

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(_matrix(b, names)), pa.int64())], names=[*b.schema.names, "cell"])

    fields = ", ".join(f"{n} double" for n in names)
    d = pin(d.mapInArrow(deal, f"d {kinds[1]}, {fields}, cell long"))
    # One row per cell: at most MOST_CELLS, and one per set of axes.
    box = d.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{p}{n}") for n in names for p, f in (("lo", F.min), ("hi", F.max))]).toArrow()
    ids, sizes = box.column("cell").to_numpy(), box.column("n").to_numpy()
    lo, hi = (_matrix(box, [p + n for n in names]) for p in ("lo", "hi"))
    rich = np.flatnonzero(sizes >= min(k, sizes.max()))

    def home(batches):
        for b in batches:
            best, reach = home_cells(_matrix(b, names), lo[rich], hi[rich])
            # Those that share no axis with these cells look at all others.
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids[rich[best]], pa.int64()), pa.array(np.full(b.num_rows, np.inf))], names=[*b.schema.names, "cell", "far"]).filter(pa.array(reach))
            lost = b.filter(pa.array(~reach))
            for i in np.setdiff1d(np.arange(len(ids)), rich).tolist() if lost.num_rows else []:
                yield pa.RecordBatch.from_arrays([*lost.columns, pa.array(np.full(lost.num_rows, ids[i]), pa.int64()), pa.array(np.full(lost.num_rows, FAR))], names=[*b.schema.names, "cell", "far"])

    def others(batches):
        for b in batches:
            dist, have = b.column("distance"), np.diff(b.column("distance").offsets.to_numpy())
            ends = dist.offsets.to_numpy()
            flat = dist.values.to_numpy()
            far = np.where(have >= k, flat[np.minimum(np.maximum(ends[1:], 1) - 1, max(len(flat) - 1, 0))] if len(flat) else np.inf, np.inf)
            first = np.flatnonzero(np.isinf(b.column("far").to_numpy()))
            mine, points = b.column("cell").to_numpy(), b.select(["q", *names])
            for row, at in cells_within(_matrix(b, names)[first], far[first], lo, hi):
                row = first[row]
                new = ids[at] != mine[row]
                row, at = row[new], at[new]
                taken = points.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ids[at], pa.int64()), pa.array(far[row])], names=["q", *names, "cell", "far"])

    asked = f"q {kinds[0]}, {fields}, cell long, far double"
    near = pin(_visit(pin(q.mapInArrow(home, asked)), d, names, k, slice_rows))
    rest = pin(near.select("q", *names, "cell", "far", "distance").mapInArrow(others, asked))
    both = near.unionByName(_visit(rest, d, names, k, slice_rows))
    pairs = both.select("q", F.explode(F.arrays_zip("d", "distance")).alias("p")).select("q", "p.d", "p.distance").filter("distance is not null")
    order = Window.partitionBy("q").orderBy("distance", F.asc_nulls_last("d"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("q", "d", "distance", "rank").withColumnsRenamed({"q": key, "d": donor_key})


def impute_knn(df, c, helpers, key, k=5):
    """Fill nulls by the mean of the k nearest rows that have a value, over the helpers that both rows have; the mean of
    the column where no row shares a helper. ``key`` tells rows apart."""
    k = max(1, min(k, df.count() // 20))
    frame = df.select(col(key).alias("k"), as_double(c).alias("t"), *[as_double(h).alias(f"h{i}") for i, h in enumerate(helpers)])
    donors = frame.filter(F.col("t").isNotNull())
    near = nearest(frame.filter(F.col("t").isNull()), donors.withColumnRenamed("k", "donor"), [f"h{i}" for i in range(len(helpers))], k, "k", "donor")
    fill = near.join(donors.select(F.col("k").alias("donor"), "t"), "donor").groupBy("k").agg(F.avg("t").alias("fill"))
    mean = F.broadcast(donors.agg(F.avg("t").alias("mean")))
    rows = df.select(F.struct(*[col(x) for x in df.columns]).alias("row"), col(key).alias("row_key"), as_double(c).alias("own"))
    filled = rows.join(fill, F.col("row_key") == F.col("k"), "left").crossJoin(mean)
    value = F.coalesce("own", "fill", "mean")
    return filled.select(*[value.alias(x) if x == c else F.col("row").getField(x).alias(x) for x in df.columns])
