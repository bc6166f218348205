"""Cleaning and preparation: imputation, outliers, typing, encoding, scaling and denoising."""
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..functions.vocab import NAME_TERMS
from ..session import pin
from .common import as_double, col, distinct_table, join_on, metric_table, numeric_columns, small, union_all, value_counts
from .ordered import ewma, over_rows, running_sum, with_row_index
from .profile import _modes, fences
from .quantiles import quantile_values
from .relational import drop_duplicate_columns, normal_names
from .roles import _named, columns_by_role, infer_roles

DROP_ABOVE = 80.0


def null_plan(df, roles):
    """(column, nulls, percent, action, value, helpers): what to do about the nulls of each column."""
    t = metric_table(df, df.columns, {"nulls": lambda c: F.count_if(col(c).isNull()), "rows": lambda c: F.count(F.lit(1))}).collect()
    by_role = columns_by_role(roles)
    role = {c: k for k, cs in by_role.items() for c in cs}
    pct = {r["column"]: 100.0 * r["nulls"] / r["rows"] if r["rows"] else 0.0 for r in t}
    numbers = set(numeric_columns(df))
    rows = []
    for r in t:
        c, p = r["column"], pct[r["column"]]
        if not r["nulls"]:
            continue
        helpers = [x for x in by_role.get("numeric", []) if x != c and pct[x] < 30]
        if p > DROP_ABOVE:
            action, value = "drop_column", None
        elif p > 50:
            number = c in numbers
            action = "fill_value" if number else "keep_null"
            value = ("0" if _named(c, "non_negative") else "-999") if number else None
        elif c in numbers:
            action, value = ("knn_impute" if r["rows"] > 100 and p < 30 and len(helpers) >= 2 else "median_impute"), None
        elif role.get(c) in ("categorical", "gender"):
            action, value = "mode_impute", None
        elif role.get(c) == "datetime":
            action, value = "median_date_impute", None
        else:
            action, value = "fill_value", "Unknown"
        rows.append((c, r["nulls"], p, action, value, helpers if action == "knn_impute" else []))
    return df.sparkSession.createDataFrame(rows, "column string, nulls long, percent double, action string, value string, helpers array<string>")


def fill_constant(df, values):
    """Replace nulls by a constant per column."""
    return df.withColumns({c: F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items() if v is not None})


def impute_median(df, cols):
    """Medians of whole-number columns turn the column into DOUBLE."""
    q = quantile_values(df, cols, [0.5])
    return df.withColumns({c: F.coalesce(as_double(c), F.lit(q[c][0])) for c in cols if c in q})


def impute_mode(df, cols):
    """The most frequent value; ties go to the smaller one."""
    modes = {r["column"]: r["mode"] for r in _modes(value_counts(df, cols)).collect()}
    return fill_constant(df, {c: modes.get(c, "Unknown") for c in cols})


def impute_median_date(df, cols):
    micros = df.select(*[F.unix_micros(col(c).cast("timestamp")).alias(c) for c in cols])
    q = quantile_values(micros, cols, [0.5])
    return df.withColumns({c: F.coalesce(col(c).cast("timestamp"), F.timestamp_micros(F.lit(int(q[c][0])))) for c in cols if c in q})


def null_report(before, after, plan):
    """Nulls before and after with the action taken; dropped columns have no count after."""
    count = lambda d: metric_table(d, d.columns, {"nulls": lambda c: F.count_if(col(c).isNull())})
    a = count(after).withColumnRenamed("nulls", "nulls_after")
    b = count(before).withColumnRenamed("nulls", "nulls_before")
    out = b.join(F.broadcast(a), "column", "left").join(F.broadcast(plan.select("column", "action")), "column", "left")
    return out.withColumn("action", F.coalesce("action", F.lit("none")))


def clip_iqr(df, cols, k=3, min_rows=30):
    """Pull values beyond the k x IQR fences back to the fence (columns with at least ``min_rows`` values)."""
    n = {r["column"]: r["n"] for r in metric_table(df, cols, {"n": lambda c: F.count(as_double(c))}).collect()}
    f = {r["column"]: r for r in fences(df, cols, k).collect() if n[r["column"]] >= min_rows}
    clip = lambda c: F.when(col(c).isNotNull(), F.greatest(F.lit(f[c]["low"]), F.least(F.lit(f[c]["high"]), as_double(c))))
    return df.withColumns({c: clip(c) for c in cols if c in f})


def to_boolean(df, cols):
    """Yes/no spellings to BOOLEAN, when any of the columns spells them as words; other values stay as they are."""
    text = lambda c: F.lower(F.trim(col(c).cast("string")))
    row = df.agg(*[F.max(text(c).isin(vocab.BOOLEAN_TRIGGERS)).alias(f"w{i}") for i, c in enumerate(cols)],
                 *[F.bool_and(text(c).isin(vocab.BOOLEAN_TRUE + vocab.BOOLEAN_FALSE)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    if not any(row[f"w{i}"] for i in range(len(cols))):
        return df
    value = lambda c: F.when(text(c).isin(vocab.BOOLEAN_TRUE), True).when(text(c).isin(vocab.BOOLEAN_FALSE), False)
    mixed = lambda c: F.coalesce(value(c).cast("string"), col(c).cast("string"))
    return df.withColumns({c: value(c) if row[f"a{i}"] else mixed(c) for i, c in enumerate(cols)})


def to_binary(df, cols):
    """True and false spellings to 1 and 0; values of neither kind become null."""
    text = lambda c: F.lower(F.trim(col(c).cast("string")))
    return df.withColumns({c: F.when(text(c).isin(vocab.TRUE_WORDS), 1).when(text(c).isin(vocab.FALSE_WORDS), 0).cast("byte") for c in cols})


def encoding_plan(df, cols):
    """(column, distinct_values, method): binary for 2 values, one_hot for 3 to 15, label otherwise."""
    d = F.col("distinct_values")
    return distinct_table(df, cols).withColumn("method", F.when(d == 2, "binary").when(d.between(3, 15), "one_hot").otherwise("label"))


def _values(df, cols, limit):
    """Driver-side sorted distinct values of columns known to have few; fails when one has more than ``limit``."""
    wide = [r["column"] for r in distinct_table(df, cols).collect() if r["distinct_values"] > limit]
    if wide:
        raise ValueError(f"more than {limit} distinct values: {wide}")
    out = {c: [] for c in cols}
    for r in value_counts(df, cols).select("column", "value").orderBy("column", "value").collect():
        out[r["column"]].append(r["value"])
    return out


def one_hot(df, cols, limit=1000):
    """Replace each column by one 0/1 column per value, named ``<column>_<value>``."""
    values = _values(df, cols, limit)
    flags = {f"{c}_{v}": F.coalesce((col(c).cast("string") == v).cast("int"), F.lit(0)) for c in cols for v in values[c]}
    return df.withColumns(flags).drop(*cols)


def label_encode(df, cols, missing="unknown_category"):
    """Replace each column by the position of its value among the sorted values; null counts as a value of its own."""
    out = df
    for c in cols:
        text = F.coalesce(col(c).cast("string"), F.lit(missing))
        codes = with_row_index(df.select(text.alias("_v")).distinct(), ["_v"], name="_code")
        out = out.join(small(codes), text == F.col("_v"), "left").drop("_v", c).withColumnRenamed("_code", c)
    return out.select(*df.columns)


def binary_encode(df, cols):
    """The smaller of two values becomes 0, the larger 1."""
    values = _values(df, cols, 2)
    code = lambda c: F.when(col(c).cast("string") == values[c][0], 0).when(col(c).cast("string") == values[c][-1], 1)
    return df.withColumns({c: code(c) for c in cols if values[c]})


def _scales(df, cols):
    return {r["column"]: r for r in metric_table(df, cols, {
        "mean": lambda c: F.avg(as_double(c)), "std": lambda c: F.stddev_pop(as_double(c)),
        "low": lambda c: F.min(as_double(c)), "high": lambda c: F.max(as_double(c))}).collect()}


def standardize(df, cols):
    """(x - mean) / population deviation; constant columns become 0."""
    s = _scales(df, cols)
    z = lambda c: (as_double(c) - s[c]["mean"]) / s[c]["std"] if s[c]["std"] else as_double(c) * 0.0
    return df.withColumns({c: z(c) for c in cols if s[c]["mean"] is not None})


def min_max(df, cols):
    """(x - min) / (max - min); constant columns become 0."""
    s = _scales(df, cols)
    unit = lambda c: (as_double(c) - s[c]["low"]) / (s[c]["high"] - s[c]["low"]) if s[c]["high"] > s[c]["low"] else as_double(c) * 0.0
    return df.withColumns({c: unit(c) for c in cols if s[c]["low"] is not None})


def parse_numeric(df, cols):
    """Text numbers (decimal comma allowed) to DOUBLE where more than half of the values read as numbers."""
    value = lambda c: F.regexp_replace(F.regexp_replace(col(c).cast("string"), ",", "."), " ", "").try_cast("double")
    row = df.agg(*[F.avg(value(c).isNotNull().cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return df.withColumns({c: value(c) for i, c in enumerate(cols) if row[i] is not None and row[i] > 0.5})


def moving_average(df, cols, order, by=(), window=None):
    """Centred moving average over max(3, rows / 100) rows of the group; values without a full window are kept.

    Sums of a window are differences of two running sums, so the work does not depend on the window's length.
    """
    by, n = list(by), len(cols)
    centre = df.agg(*[F.coalesce(F.avg(as_double(c)), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(cols)]).first() if n else []
    rows = with_row_index(df, order, by)
    if window or not by:
        rows = rows.withColumn("_window", F.lit(window or max(3, rows.count() // 100)).cast("long"))
    else:
        sizes = rows.groupBy(*by).agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) / 100)).cast("long").alias("_window"))
        rows = join_on(rows, sizes, by)
    rows = rows.withColumns({f"_value{i}": F.coalesce(as_double(c) - F.lit(centre[i]), F.lit(0.0)) for i, c in enumerate(cols)})
    rows = rows.withColumns({f"_known{i}": as_double(c).isNotNull().cast("long") for i, c in enumerate(cols)})
    for i in range(n):
        rows = running_sum(running_sum(rows, f"_value{i}", by, f"_s{i}"), f"_known{i}", by, f"_n{i}")
    rows = pin(rows)
    sums = [f"_{x}{i}" for i in range(n) for x in "sn"]
    back = F.floor(F.col("_window") / 2)
    upper = rows.select(*by, (F.col("row_index") - (F.col("_window") - 1 - back)).alias("row_index"), *[F.col(s).alias(f"{s}u") for s in sums])
    lower = rows.select(*by, (F.col("row_index") + back + 1).alias("row_index"), *[F.col(s).alias(f"{s}l") for s in sums])
    wide = join_on(join_on(rows, upper, [*by, "row_index"], "left"), lower, [*by, "row_index"], "left")

    def smooth(i, c):
        part = lambda x: F.col(f"_{x}{i}u") - F.coalesce(F.col(f"_{x}{i}l"), F.lit(0))
        full = (F.col("row_index") >= back) & (part("n") == F.col("_window"))
        return F.coalesce(F.when(full, part("s") / F.col("_window") + F.lit(centre[i])), as_double(c))

    return wide.withColumns({c: smooth(i, c) for i, c in enumerate(cols)}).select(*df.columns)


def exp_smooth(df, c, order, by=(), alpha=0.1):
    """Exponential smoothing of the non-null values of a column."""
    return ewma(df, c, order, by, alpha, name=f"{c}_smooth")


# The Daubechies-4 scaling filter.
DB4 = [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
       -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278]
HIGH = [(-1) ** k * DB4[7 - k] for k in range(8)]


def wavelet_denoise(df, c, order, by=(), shrink=0.2, max_level=5):
    """Soft-threshold the detail coefficients of a db4 decomposition at ``shrink`` times their largest size.

    Every sample adds to a few coefficients and every coefficient to a few samples, so each level is an
    explode and a grouped sum over positions; no series is held in one task.
    """
    keys = {b: f"_b{i}" for i, b in enumerate(by)}
    indexed = pin(with_row_index(df.filter(col(c).isNotNull()), order, list(by)))
    by = list(keys.values())
    named = indexed.select(*[col(b).alias(k) for b, k in keys.items()], "row_index", as_double(c).alias("_x"))
    sizes = named.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    level = F.least(F.lit(max_level), F.floor(F.log2(F.col("_n") / 7.0)))
    sizes = pin(sizes.withColumn("_levels", F.when(F.col("_n") >= 8, level).otherwise(0)).withColumn("_n", F.col("_n").cast("long")))
    signal = named.select(*by, F.col("row_index").alias("i"), F.col("_x").alias("x"))
    signal = join_on(signal, sizes, by) if by else signal.withColumns({k: F.lit(v) for k, v in sizes.first().asDict().items()})
    details, lengths = [], F.col("_n")
    current = signal.withColumn("n", lengths)
    deepest = sizes.agg(F.max("_levels")).first()[0] or 0
    rest = [current.filter(F.col("_levels") == 0)]
    for depth in range(1, int(deepest) + 1):
        taps = pin(_analyse(current.filter(F.col("_levels") >= depth), by))
        peak = taps.groupBy(*by).agg(F.max(F.abs("d")).alias("_peak"))
        cut = (join_on(taps, peak, by) if by else taps.withColumn("_peak", F.lit(peak.first()[0]))).withColumn(
            "d", F.signum("d") * F.greatest(F.abs("d") - shrink * F.col("_peak"), F.lit(0.0)))
        details.append((depth, cut.select(*by, "i", "d")))
        current = taps.select(*by, "i", F.col("a").alias("x"), "n", "_n", "_levels")
        rest.append(current.filter(F.col("_levels") == depth))
    out = None
    for depth, d in reversed(details):
        low = rest[depth].select(*by, "i", "x")
        low = low if out is None else low.unionByName(out)
        out = _synthesise(low, d, by)
    flat = rest[0].select(*by, "i", "x")
    out = flat if out is None else out.unionByName(flat)
    found = out.withColumnsRenamed({"i": "row_index", "x": f"{c}_denoised", **{k: b for b, k in keys.items()}})
    return join_on(indexed, found, [*keys, "row_index"], "left").drop("row_index")


def _analyse(signal, by):
    """Low and high pass coefficients of a signal mirrored at both ends."""
    n, i = F.col("n"), F.col("i")
    # Positions of a sample in the mirrored signal: itself, and its images within 7 of either end.
    images = F.array_compact(F.array(i, F.when(i < 7, -1 - i), F.when(n - i <= 7, 2 * n - 1 - i)))
    placed = signal.withColumn("p", F.explode(images))
    tap = F.explode(F.sequence(F.lit(0), F.lit(7)))
    taps = placed.withColumn("k", tap).withColumn("m", F.col("p") + F.col("k") - 1).filter((F.col("m") % 2 == 0))
    taps = taps.withColumn("m", (F.col("m") / 2).cast("long"))
    size = F.floor((n + 7) / 2)
    low, high = (F.array(*[F.lit(v) for v in reversed(h)]) for h in (DB4, HIGH))
    return (
        taps.filter((F.col("m") >= 0) & (F.col("m") < size))
        .groupBy(*by, F.col("m").alias("i"), size.alias("n"), "_n", "_levels")
        .agg(F.sum(F.col("x") * F.get(low, F.col("k"))).alias("a"), F.sum(F.col("x") * F.get(high, F.col("k"))).alias("d")))


def _synthesise(low, high, by):
    """The signal of one level up from its two coefficient series."""
    both = union_all([
        low.select(*by, "i", F.col("x").alias("v"), F.lit(0).alias("h")), high.select(*by, "i", F.col("d").alias("v"), F.lit(1).alias("h"))])
    bank = F.array(F.array(*[F.lit(v) for v in DB4]), F.array(*[F.lit(v) for v in HIGH]))
    parts = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("t", 2 * F.col("i") + F.col("k") - 6)
    ends = high.groupBy(*by).agg((2 * F.max("i") - 5).alias("_top"))
    parts = parts.withColumn("y", F.col("v") * F.get(F.get(bank, F.col("h")), F.col("k")))
    sums = parts.filter(F.col("t") >= 0).groupBy(*by, F.col("t").alias("i")).agg(F.sum("y").alias("x"))
    bounded = join_on(sums, ends, by) if by else sums.withColumn("_top", F.lit(ends.first()[0]))
    return bounded.filter(F.col("i") <= F.col("_top")).select(*by, "i", "x")


def apply_null_plan(df, plan, key=None):
    """Carry out a null plan. Nearest-neighbour steps need a row ``key`` and fall back to medians without one."""
    from .neighbours import impute_knn
    steps = {}
    for r in plan.collect():
        steps.setdefault(r["action"], []).append(r)
    names = lambda a: [r["column"] for r in steps.get(a, [])]
    out = df.drop(*names("drop_column"))
    if key:
        for r in steps.get("knn_impute", []):
            out = impute_knn(out, r["column"], [h for h in r["helpers"] if h in out.columns], key)
    medians = names("median_impute") + ([] if key else names("knn_impute"))
    out = impute_median(out, medians) if medians else out
    out = impute_mode(out, names("mode_impute")) if names("mode_impute") else out
    out = impute_median_date(out, names("median_date_impute")) if names("median_date_impute") else out
    return fill_constant(out, {r["column"]: r["value"] for r in steps.get("fill_value", [])})


def clean(df, key=None, for_modeling=False):
    """The full preparation in its fixed order; lazy apart from the small statistics each step needs.

    Roles, duplicate columns, nulls, outliers, integer narrowing, booleans; then for modelling also encoding
    and scaling. ``key`` names the row key and is left untouched.
    """
    from .learn import replace_outliers
    from .relational import narrow_types
    names = dict(zip(df.columns, normal_names(df.columns)))
    df, key = df.toDF(*names.values()), names.get(key, key)
    df = drop_duplicate_columns(df)
    roles = infer_roles(df)
    out = apply_null_plan(df, null_plan(df, roles), key)
    by_role = {k: [c for c in v if c in out.columns and c != key] for k, v in columns_by_role(roles).items()}
    numbers = by_role.get("numeric", [])
    if numbers:
        forest = key and len(numbers) >= 3 and out.count() >= 100
        out = replace_outliers(out, numbers, key) if forest else clip_iqr(out, numbers)
    out = narrow_types(out)
    binary = by_role.get("binary", [])
    if binary and not for_modeling:
        out = to_boolean(out, binary)
    if for_modeling:
        out = to_binary(out, binary) if binary else out
        cats = by_role.get("categorical", []) + by_role.get("gender", [])
        plan = {}
        for r in (encoding_plan(out, cats).collect() if cats else []):
            plan.setdefault(r["method"], []).append(r["column"])
        for method, fn in (("binary", binary_encode), ("label", label_encode), ("one_hot", one_hot)):
            out = fn(out, plan[method]) if plan.get(method) else out
        out = standardize(out, numbers) if numbers else out
    return out
