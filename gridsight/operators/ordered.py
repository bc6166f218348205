"""Ordered analytics that stay distributed.

Rows are range-partitioned on the full order (grouping keys, order, tie key), so a hot key
is spread over many tasks. Window functions then run in fixed-size blocks of row positions; rows near a
block edge are also sent to the neighbouring block, and running state is carried over a table with one
row per block.
"""
import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin
from .common import join_on, small

BLOCK = 65_536
WINDOW_ROWS = 1_000_000
#: Rows of a task that sorts. Sizes in bytes say little here: sorted and repeated values shrink a lot when they are shuffled.
SORT_ROWS = 500_000
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000


def sort_tasks(spark, rows):
    """How many tasks of about ``SORT_ROWS`` rows each sort ``rows`` rows; at least one per core."""
    return max(-(-rows // SORT_ROWS), spark.sparkContext.defaultParallelism)


def meet(left, right, on, right_rows, tasks, how="inner"):
    """Join with a side of at most ``right_rows`` rows: few are broadcast, else both sides are dealt to ``tasks`` tasks and sorted there.

    Without it Spark goes by the size of the file under a pinned table, which says little about its rows, and broadcasts many.
    """
    if right_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on, how)


def with_row_index(df, order, by=(), name="row_index"):
    """Add the 0-based position in ``order`` (within ``by``). ``order`` must end in a tie-breaking key.

    A table with at most ``WINDOW_ROWS`` rows takes one plain window; beyond that rows are range-partitioned,
    pinned, and numbered partition by partition.
    """
    keys, by = [*by, *order], list(by)
    rows = df.select(F.lit(1)).count()
    if rows <= WINDOW_ROWS:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
    placed = (
        df.repartitionByRange(sort_tasks(df.sparkSession, rows), *keys).sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    pinned = pin(placed)
    part, local = F.shiftright("_slot", 33), F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = pinned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    indexed = (
        pinned.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + local).drop("_part", "_start", "_slot")
    )
    return _within(indexed, list(by), name) if by else indexed


def _within(indexed, by, name):
    # Few groups are broadcast: joined by group, the rows of a hot one would meet in one task.
    first = small(pin(indexed.groupBy(*by).agg(F.min(name).alias("_first"))))
    return join_on(indexed, first, by).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def over_rows(indexed, exprs, by=(), before=0, after=0, index="row_index", block=None):
    """Evaluate bounded window expressions block by block.

    ``exprs`` maps a result name to a function of the ordered window; frames and lags may reach
    ``before`` rows back and ``after`` rows ahead.
    """
    block = max(block or BLOCK, before, after, 1)
    place = lambda shift: F.floor((F.col(index) + shift) / block)
    spread = indexed.withColumn("_home", place(0)).withColumn("_block", F.explode(
        F.array_distinct(F.array(place(-after), place(0), place(before)))))
    w = Window.partitionBy(*by, "_block").orderBy(index)
    return (
        spread.withColumns({k: fn(w) for k, fn in exprs.items()})
        .filter(F.col("_home") == F.col("_block")).drop("_home", "_block")
    )


def _with_carry(indexed, per_block, carry, by, index, block):
    """Join each block with the state that enters it; many rows are dealt by block to tasks of about ``SORT_ROWS`` rows."""
    block = block or BLOCK
    blocks = indexed.withColumn("_block", F.floor(F.col(index) / block))
    state = pin(blocks.groupBy(*by, "_block").agg(*per_block, F.count(F.lit(1)).alias("_rows")))
    rows = state.agg(F.sum("_rows")).first()[0] or 0
    entering = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    state = state.select(*by, "_block", *[fn(entering).alias(k) for k, fn in carry.items()])
    joined = join_on(blocks, small(state), [*by, "_block"])
    return joined.repartition(sort_tasks(indexed.sparkSession, rows), *by, "_block") if rows > WINDOW_ROWS else joined


def running_sum(indexed, value, by=(), name="running", index="row_index", block=None):
    """Cumulative sum in order, including the current row."""
    joined = _with_carry(
        indexed, [F.sum(value).alias("_s")],
        {"_carry": lambda w: F.coalesce(F.sum("_s").over(w), F.lit(0))}, by, index, block)
    w = Window.partitionBy(*by, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.sum(value).over(w) + F.col("_carry")).drop("_block", "_carry")


def fill_forward(indexed, cols, by=(), index="row_index", block=None, backward=False):
    """Last non-null value so far for each column, itself included (next one when ``backward``)."""
    at = -F.col(index) if backward else F.col(index)
    frame = indexed.withColumn("_at", at)
    per_block = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_last{i}") for i, c in enumerate(cols)]
    carry = {f"_c{i}": (lambda w, i=i: F.last(f"_last{i}", ignorenulls=True).over(w)) for i in range(len(cols))}
    joined = _with_carry(frame, per_block, carry, by, "_at", block)
    w = Window.partitionBy(*by, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_c{i}")) for i, c in enumerate(cols)}
    return joined.withColumns(filled).drop("_block", "_at", *carry)


def hash_rank(key, seed=42):
    """A repeatable pseudo-random LONG in [0, 2^60) from a row key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def take_smallest(df, by, rank_key, wanted, buckets=65_536):
    """Keep, per group, the ``wanted`` rows with the smallest ``rank_key`` (a ``hash_rank``).

    Hash ranges beyond the cut are dropped by count before any row is ranked, and rows are ranked within
    one range at a time, so a hot group is never sorted in one task.
    """
    span = (1 << 60) // buckets
    frame = df.withColumn("_rank", rank_key).withColumn("_bucket", F.floor(F.col("_rank") / F.lit(float(span))))
    counts = frame.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    counts = (
        counts.withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
        .withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
        .withColumn("_left", wanted(F.col("_total")) - F.col("_before"))
        .filter(F.col("_left") > 0)
        .select(*by, "_bucket", "_left")
    )
    kept = join_on(frame, counts, [*by, "_bucket"])
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_rank"))
    return kept.withColumn("_rn", place).filter(F.col("_rn") <= F.col("_left")).drop("_rank", "_bucket", "_left", "_rn")


def gaps(df, ts, by=()):
    """(by..., ts, gap_seconds): time since the previous row. Equal times give gaps of 0, in any order."""
    rows = (
        df.select(*by, ts).filter(F.col(ts).isNotNull())
        .withColumn("_tie", F.monotonically_increasing_id())
    )
    indexed = with_row_index(rows, [ts, "_tie"], by)
    micros = lambda c: F.unix_micros(c)
    stepped = over_rows(
        indexed, {"gap_seconds": lambda w: (micros(F.col(ts).cast("timestamp")) - F.lag(micros(F.col(ts).cast("timestamp"))).over(w)) / 1e6},
        by, before=1)
    return stepped.filter(F.col("row_index") > 0).select(*by, ts, "gap_seconds")


# ---- analytics in order


def rolling(df, cols, order, window, by=(), fn="mean", center=False):
    """Rolling mean, std or median over ``window`` rows; null until a trailing (or full centred) window is filled."""
    back, ahead = (window // 2, window - 1 - window // 2) if center else (window - 1, 0)
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}.get(fn)
    middle, low = window // 2, (window - 1) // 2

    def expr(c):
        def build(w):
            frame = w.rowsBetween(-back, ahead)
            if fn == "median":
                held = F.sort_array(F.collect_list(c).over(frame))
                value = (F.get(held, F.lit(low)) + F.get(held, F.lit(middle))) / 2.0
            else:
                value = agg(c).over(frame)
            return F.when(F.count(c).over(frame) == window, value)
        return build

    indexed = with_row_index(df, order, by)
    return over_rows(indexed, {f"{c}_rolling_{fn}": expr(c) for c in cols}, by, back, ahead)


def ewma(df, c, order, by=(), alpha=0.1, name=None, block=None):
    """y = alpha * x + (1 - alpha) * previous y, starting at the first value.

    Each block of rows is a linear map of the state that enters it, so blocks are summarised by one
    aggregate, chained over one row per block, and then filled in independently.
    """
    by, block, name = list(by), block or BLOCK, name or f"{c}_ewma"
    indexed = with_row_index(df.filter(F.col(c).isNotNull()), order, by)
    first = F.col("row_index") == 0
    step = indexed.withColumn("_block", F.floor(F.col("row_index") / block)).withColumn(
        "_in", F.when(first, F.col(c).cast("double")).otherwise(alpha * F.col(c)))
    last = F.max("row_index").over(Window.partitionBy(*by, "_block"))
    weight = F.pow(F.lit(1.0 - alpha), (last - F.col("row_index")).cast("double"))
    state = step.withColumn("_w", weight).groupBy(*by, "_block").agg(
        F.sum(F.col("_in") * F.col("_w")).alias("_add"), F.count(F.lit(1)).alias("_n"))
    # Weight of block j on the state entering block b: the decay over all rows in between.
    upto = Window.partitionBy(*by).orderBy("_block")
    state = state.withColumn("_rows", F.sum("_n").over(upto))
    pairs = F.collect_list(F.struct("_add", "_rows")).over(upto.rowsBetween(-carried_blocks(alpha, block), -1))
    entering = F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + s["_add"] * F.pow(F.lit(1.0 - alpha), (F.col("_rows") - F.col("_n") - s["_rows"]).cast("double")))
    state = state.select(*by, "_block", entering.alias("_start"))
    joined = join_on(step, state, [*by, "_block"])

    kept = [*df.columns, "row_index", name]

    def fill(pdf):
        pdf = pdf.sort_values("row_index")
        y, out = float(pdf["_start"].iloc[0]), np.empty(len(pdf))
        for i, v in enumerate(pdf["_in"].to_numpy()):
            y = v + (1.0 - alpha) * y
            out[i] = y
        pdf[name] = out
        return pdf[kept]

    schema = T.StructType([*df.schema.fields, T.StructField("row_index", T.LongType()), T.StructField(name, T.DoubleType())])
    return joined.groupBy(*by, "_block").applyInPandas(fill, schema)


def carried_blocks(alpha, block):
    """How many earlier blocks still matter at double precision."""
    return max(1, math.ceil(750.0 / max(1e-12, -math.log(1.0 - alpha)) / block)) if alpha < 1 else 1


def _halves(df, ts, c, key):
    indexed = with_row_index(df.select(ts, c, key).filter(F.col(c).isNotNull() & F.col(ts).isNotNull()), [ts, key])
    return indexed, indexed.count()


def half_trend(df, ts, c, key):
    """Mean of the first and second half in time order, percent change and direction (beyond 5%)."""
    indexed, n = _halves(df, ts, c, key)
    early = F.col("row_index") < n // 2
    t = indexed.agg(F.avg(F.when(early, F.col(c))).alias("first_mean"), F.avg(F.when(~early, F.col(c))).alias("second_mean"))
    change = F.when(F.col("first_mean") != 0, (F.col("second_mean") - F.col("first_mean")) / F.abs("first_mean") * 100).otherwise(0.0)
    return t.withColumn("change_percent", change).withColumn(
        "direction", F.when(F.col("change_percent") > 5, "increasing").when(F.col("change_percent") < -5, "decreasing").otherwise("stable"))


def quarter_change(df, ts, c, key):
    """Mean of the first and last quarter of the rows; a change of more than 20% is marked."""
    indexed, n = _halves(df, ts, c, key)
    i, k = F.col("row_index"), n // 4
    t = indexed.agg(F.avg(F.when(i < k, F.col(c))).alias("first_mean"), F.avg(F.when(i >= n - k, F.col(c))).alias("last_mean"))
    change = F.when(F.col("first_mean") != 0, (F.col("last_mean") - F.col("first_mean")) / F.abs("first_mean") * 100).otherwise(0.0)
    return t.withColumn("change_percent", change).withColumn("changed", F.abs("change_percent") > 20)


def group_quarter_change(df, ts, c, cat, key, min_rows=10):
    """Percent change from first to last quarter per category; diverging when some rise and some fall by over 20%."""
    indexed = with_row_index(df.select(ts, c, cat, key).dropna(), [ts, key], [cat])
    sizes = indexed.groupBy(cat).agg(F.count(F.lit(1)).alias("_n"))
    i, k = F.col("row_index"), F.floor(F.col("_n") / 4)
    g = join_on(indexed, sizes, [cat]).filter(F.col("_n") >= min_rows).groupBy(cat).agg(
        F.avg(F.when(i < k, F.col(c))).alias("first_mean"), F.avg(F.when(i >= F.col("_n") - k, F.col(c))).alias("last_mean"))
    g = g.withColumn("change_percent", F.when(F.col("first_mean") != 0, (F.col("last_mean") - F.col("first_mean")) / F.abs("first_mean") * 100).otherwise(0.0))
    s = g.agg(F.max("change_percent").alias("hi"), F.min("change_percent").alias("lo")).first()
    return g.withColumn("diverging", F.lit(bool(s["hi"] is not None and s["hi"] > 20 and s["lo"] < -20)))


def waterfall(df, name, value, pos):
    """Start and end of each step in order, with the Total as the last row."""
    indexed = with_row_index(df.select(name, value, pos), [pos])
    steps = running_sum(indexed, value, name="end").select(
        F.col("row_index").alias("position"), F.col(name).cast("string").alias("name"), (F.col("end") - F.col(value)).alias("start"), "end", F.col(value).cast("double").alias("value"))
    total = df.agg(F.count(F.lit(1)).alias("position"), F.sum(value).alias("end")).select(
        "position", F.lit("Total").alias("name"), F.lit(0.0).alias("start"), "end", F.col("end").cast("double").alias("value"))
    return steps.unionByName(total)


def ecdf(df, c):
    """Cumulative share at each distinct value."""
    from .statistics import value_ranks
    ranks = value_ranks(df, [c])
    total = df.filter(F.col(c).isNotNull()).count()
    return ranks.select("value", "n", (F.col("upto") / F.lit(float(max(total, 1)))).alias("share"))


def quartile_means(df, ts, c, key):
    """Means of four equal runs of rows in time order and their trend against the first (beyond 10%)."""
    indexed, n = _halves(df, ts, c, key)
    # The first n % 4 runs hold one row more, as ntile(4) does.
    small_size, extra = n // 4, n % 4
    i, cut = F.col("row_index"), (n // 4 + 1) * (n % 4)
    quarter = F.when(i < cut, F.floor(i / F.lit(small_size + 1))).otherwise(F.lit(extra) + F.floor((i - cut) / F.lit(max(small_size, 1))))
    g = indexed.groupBy((quarter + 1).cast("int").alias("quarter")).agg(F.avg(c).alias("mean"), F.count(F.lit(1)).alias("n"))
    prior = F.lag("mean").over(Window.orderBy("quarter"))
    change = (F.col("mean") - prior) / F.abs(prior) * 100
    return g.withColumn("change_percent", change).withColumn("direction", F.when(F.col("change_percent") > 10, "up").when(F.col("change_percent") < -10, "down").otherwise("flat"))


def interpolate(df, ts, c, by=()):
    """Fill gaps linearly by position between known neighbours on a regular grid; leading nulls stay, trailing ones repeat the last value."""
    by = list(by)
    indexed = with_row_index(df, [ts], by)
    known = F.when(F.col(c).isNotNull(), F.struct(F.col("row_index").alias("i"), F.col(c).cast("double").alias("v")))
    marked = indexed.withColumns({"_prev": known, "_next": known})
    filled = fill_forward(fill_forward(marked, ["_prev"], by), ["_next"], by, backward=True)
    a, b = F.col("_prev"), F.col("_next")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("row_index") - a["i"]) / (b["i"] - a["i"])
    value = F.coalesce(F.col(c).cast("double"), F.when(a.isNotNull() & b.isNotNull(), line), a["v"])
    return filled.withColumn(c, value).drop("_prev", "_next", "row_index")


FREQUENCIES = {"h": "hour", "d": "day", "w": "week", "m": "month", "q": "quarter", "y": "year"}


def resample(df, ts, c, freq, by=(), fill=False):
    """(by..., ts, value, n): mean per period, labelled by its start, with empty periods as nulls.

    The result has at most one row per period of the key's time span, however many rows the key has.
    """
    unit = FREQUENCIES[freq]
    by = list(by)
    means = df.filter(F.col(ts).isNotNull()).groupBy(*by, F.date_trunc(unit, F.col(ts)).cast("timestamp").alias("ts")).agg(
        F.avg(F.col(c).cast("double")).alias("value"), F.count(c).alias("n"))
    step = F.expr(f"INTERVAL {3 if unit == 'quarter' else 1} {'MONTH' if unit == 'quarter' else unit.upper()}")
    spans = means.groupBy(*by).agg(F.explode(F.sequence(F.min("ts"), F.max("ts"), step)).alias("ts"))
    out = join_on(spans, means, [*by, "ts"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _fill_grid(out, by) if fill else out


def _fill_grid(grid, by):
    """Linear filling of a resampled grid; plain windows do, since a grid has one row per period."""
    w = Window.partitionBy(*by).orderBy("ts")
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("_i"), F.col("value").alias("v")))
    placed = grid.withColumn("_i", F.row_number().over(w)).withColumn("_known", known)
    placed = placed.withColumns({
        "_a": F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_b": F.first("_known", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["_i"]) / (b["_i"] - a["_i"])
    return placed.withColumn("value", F.coalesce("value", F.when(a.isNotNull() & b.isNotNull(), line), a["v"])).drop("_i", "_known", "_a", "_b")


def choose_frequency(df, ts, by=()):
    """(by..., median_gap, freq): the resampling period that suits the median gap."""
    from .quantiles import median_table
    by = list(by)
    m = median_table(gaps(df, ts, by), ["gap_seconds"], by).select(*by, F.col("median").alias("median_gap"))
    gap, days = F.col("median_gap"), F.floor(F.col("median_gap") / 86400)
    freq = (F.when((days == 0) & (gap <= 3600), "h").when(days == 0, "d").when(days.between(1, 7), "w").when(days.between(28, 31), "m")
            .when(days.between(89, 92), "q").when(days >= 350, "y").otherwise("d"))
    return m.withColumn("freq", freq)


def display_granularity(df, ts):
    """hourly below a day of range, daily below 30 days, weekly below a year, else monthly."""
    t = df.agg(((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 86400e6).alias("range_days"))
    d = F.col("range_days")
    return t.withColumn("granularity", F.when(d < 1, "hourly").when(d < 30, "daily").when(d < 365, "weekly").otherwise("monthly"))
