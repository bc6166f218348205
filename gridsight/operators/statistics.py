"""Correlation, tests and selection from sufficient statistics."""
import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.special import p_value
from ..session import pin
from .common import as_double, col, fits, metric_table, union_all, value_counts
from .ordered import running_sum, with_row_index
from .profile import binary_summary, corrected_skew, crosstab
from .quantiles import EXACT_ROWS


def column_pairs(cols):
    """Upper-triangle pairs; enumerated from names, never by joining rows."""
    return list(itertools.combinations(cols, 2))


def pair_table(df, pairs, exprs):
    """(a, b, metrics...) from one aggregate over all pairs."""
    aggs = [fn(a, b).alias(f"{i}_{m}") for i, (a, b) in enumerate(pairs) for m, fn in exprs.items()]
    structs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(f"{i}_{m}").alias(m) for m in exprs])
               for i, (a, b) in enumerate(pairs)]
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("_p")).select("_p.*")


def clean_corr(x, y):
    r = F.corr(x, y)
    return F.when(~F.isnan(r), r)


def pearson(df, cols):
    """Pairwise-complete linear correlation."""
    return pair_table(df, column_pairs(cols), {"r": lambda a, b: clean_corr(as_double(a), as_double(b))})


#: Distinct values that are broadcast, and that one task may hold in a hash table (about 100 bytes each).
BROADCAST_VALUES, HASHED_VALUES = 100_000, 5_000_000


def value_ranks(df, cols):
    """(column, value, n, rank): average rank of each distinct value."""
    long = df.select(*[as_double(c).alias(c) for c in cols]).unpivot([], cols, "column", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if fits(df, EXACT_ROWS):
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("column").orderBy("value")))
    else:
        # Pinned, since numbering reads the counts three times.
        upto = running_sum(with_row_index(pin(counts), ["value"], ["column"]), "n", ["column"], "upto")
    return upto.select("column", "value", "n", "upto", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def average_ranks(df, cols):
    """Add ``<c>_rank`` with ties given their average rank; nulls stay null."""
    ranks = pin(value_ranks(df, cols))
    sizes = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}
    out = df
    for c in cols:
        side, n = ranks.filter(F.col("column") == c).select(F.col("value").alias("_v"), F.col("rank").alias(f"{c}_rank")), sizes.get(c, 0)
        # Few values are broadcast; more, of a proven number, fit a task's hash table, so the rows need no sort.
        side = F.broadcast(side) if n <= BROADCAST_VALUES else side.hint("shuffle_hash") if n <= HASHED_VALUES else side
        out = out.join(side, as_double(c) == F.col("_v"), "left").drop("_v")
    return out


def _ranked_together(df, cols):
    """Rank columns of a table proven small: one sort per column, side by side, then rows are put together again."""
    long = df.withColumn("_id", F.monotonically_increasing_id()).unpivot(["_id"], cols, "column", "value")
    w = Window.partitionBy("column").orderBy("value")
    ties = F.count(F.lit(1)).over(Window.partitionBy("column", "value"))
    ranked = long.withColumn("r", F.rank().over(w) + (ties - 1) / 2.0)
    return ranked.groupBy("_id").agg(*[F.max(F.when(F.col("column") == c, F.col("r"))).alias(f"{c}_rank") for c in cols])


def spearman(df, cols):
    """Rank correlation per pair. Where values are missing, each pair is ranked on its complete rows."""
    frame = df.select(*[as_double(c).alias(c) for c in cols])
    gaps = frame.agg(*[F.count_if(col(c).isNull()).alias(c) for c in cols]).first().asDict()
    full = [c for c in cols if not gaps[c]]
    parts = []
    if len(full) > 1:
        ranked = _ranked_together(frame.select(*full), full) if fits(frame, EXACT_ROWS) else average_ranks(frame.select(*full), full)
        parts.append(pair_table(ranked, column_pairs(full), {"rho": lambda a, b: clean_corr(col(f"{a}_rank"), col(f"{b}_rank"))}))
    for a, b in column_pairs(cols):
        if gaps[a] or gaps[b]:
            ranked = average_ranks(frame.select(a, b).dropna(), [a, b])
            parts.append(pair_table(ranked, [(a, b)], {"rho": lambda a, b: clean_corr(col(f"{a}_rank"), col(f"{b}_rank"))}))
    return union_all(parts)


def strength(r):
    return F.when(r >= 0.7, "strong").when(r >= 0.4, "moderate").when(r >= 0.2, "weak").otherwise("negligible")


def correlation_pairs(df, cols, top=20):
    """Pearson and Spearman per pair (2 digits), kind of relation and strength, strongest first."""
    r, rho = F.round("r", 2), F.round("rho", 2)
    both = pearson(df, cols).join(F.broadcast(spearman(df, cols)), ["a", "b"]).select("a", "b", r.alias("r"), rho.alias("rho"))
    best = F.greatest(F.abs("r"), F.abs("rho"))
    return both.select(
        "a", "b", "r", "rho",
        F.when(F.abs("rho") > F.abs("r") + 0.2, "non_linear").otherwise("linear").alias("relationship"),
        strength(best).alias("strength")).orderBy(best.desc(), "a", "b").limit(top)


def multicollinear_groups(pairs, threshold=0.7):
    """(group_id, column): sets of at least 3 columns linked by |r| > threshold. Bounded by the column count."""
    edges = [(x["a"], x["b"]) for x in pairs.filter(F.abs("r") > threshold).collect()]
    home = {c: c for e in edges for c in e}

    def root(c):
        while home[c] != c:
            c = home[c]
        return c

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        home[hi] = lo
    groups = {}
    for c in home:
        groups.setdefault(root(c), []).append(c)
    rows = [(g, c) for g, members in groups.items() if len(members) > 2 for c in members]
    return pairs.sparkSession.createDataFrame(rows, "group_id string, column string")


def correlation_by(df, a, b, cat, min_rows=10):
    """Correlation per category, with whether categories differ by more than 0.3."""
    x, y = as_double(a), as_double(b)
    g = df.groupBy(cat).agg(F.count(F.lit(1)).alias("n"), clean_corr(x, y).alias("r")).filter(
        (F.col("n") >= min_rows) & F.col("r").isNotNull())
    span = g.agg((F.max("r") - F.min("r")).alias("s")).first()["s"]
    return g.withColumn("differs", F.lit(bool(span is not None and span > 0.3)))


def _groups(df, cat, num):
    v = as_double(num)
    return df.filter(col(cat).isNotNull()).groupBy(cat).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2")).filter(F.col("n") > 0)


def anova(df, cat, num, drop_constant=True):
    """One-way analysis of variance; groups without spread are left out by default."""
    g = _groups(df, cat, num)
    if drop_constant:
        g = g.filter(F.col("s2") > 0)
    n, m, s2 = F.col("n"), F.col("m"), F.coalesce("s2", F.lit(0.0))
    t = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"), F.sum(n * m).alias("nm"),
              F.sum(n * m * m).alias("nmm"), F.sum((n - 1) * s2).alias("within"))
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("total")
    d1, d2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    f = F.when((d1 > 0) & (d2 > 0) & (F.col("within") > 0), (between / d1) / (F.col("within") / d2))
    out = t.select("groups", "total", f.alias("f_statistic"), d1.alias("df_between"), d2.alias("df_within"))
    return out.withColumn("p_value", p_value("f", F.col("f_statistic"), F.col("df_between"), F.col("df_within")))


def welch_t(df, cat, num):
    """Two-sample t-test with unequal variances between the two values of ``cat`` (smaller value first)."""
    g = _groups(df, cat, num)
    pick = lambda fn, c: fn(F.col(c), col(cat))
    t = g.agg(F.count(F.lit(1)).alias("k"), *[pick(fn, c).alias(f"{c}{i}") for i, fn in ((1, F.min_by), (2, F.max_by)) for c in ("n", "m", "s2")])
    e1, e2 = F.col("s21") / F.col("n1"), F.col("s22") / F.col("n2")
    out = t.filter(F.col("k") == 2).select(
        ((F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).alias("t_statistic"),
        ((e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))).alias("df"))
    return out.withColumn("p_value", p_value("t", F.col("t_statistic"), F.col("df")))


def chi_square(df, a, b):
    """Independence of two categories; 2x2 tables get the Yates correction."""
    return chi_square_counts(crosstab(df, a, b), a, b)


def chi_square_counts(cells, a, b):
    """The same from a table of counts. Empty cells are added through the marginal sums, without pairing values."""
    rows = cells.groupBy(a).agg(F.sum("n").alias("ra"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("cb"))
    joined = cells.join(rows, a).join(columns, b)
    shape = rows.agg(F.count(F.lit(1)).alias("r"), F.sum("ra").alias("total")).first()
    k, total = columns.count(), float(shape["total"] or 0)
    dof = (shape["r"] - 1) * (k - 1)
    expected = F.col("ra") * F.col("cb") / F.lit(total)
    gap = F.abs(F.col("n") - expected)
    if dof == 1:
        gap = gap - F.least(F.lit(0.5), gap)
    # An empty cell adds (e - shift)^2 / e. Without the correction all empty cells together add total - sum(e of seen cells).
    stats = joined.agg(F.sum(gap * gap / expected).alias("seen"), F.sum(expected).alias("e")).first()
    value = (stats["seen"] or 0.0) + (total - (stats["e"] or 0.0))
    if dof == 1 and total - (stats["e"] or 0.0) > 1e-9:
        value = _yates_full(rows, columns, cells, a, b, total)
    out = cells.sparkSession.createDataFrame([(float(value), int(dof), total)], "chi2 double, df int, total double")
    return out.withColumn("p_value", p_value("chi2", F.col("chi2"), F.col("df")))


def _yates_full(rows, columns, cells, a, b, total):
    """A 2x2 table with an empty cell: four numbers on the driver."""
    ra = {x[a]: x["ra"] for x in rows.collect()}
    cb = {x[b]: x["cb"] for x in columns.collect()}
    seen = {(x[a], x[b]): x["n"] for x in cells.collect()}
    out = 0.0
    for i in ra:
        for j in cb:
            e = ra[i] * cb[j] / total
            gap = abs(seen.get((i, j), 0) - e)
            out += (gap - min(0.5, gap)) ** 2 / e
    return out


def dow_chi_square(df, ts, cat):
    """Independence of weekday (Monday 0) and category."""
    return chi_square(df.withColumn("day_of_week", F.weekday(col(ts))), "day_of_week", cat)


def k_squared(n, g1, g2):
    """D'Agostino-Pearson omnibus statistic from n, biased skewness and biased excess kurtosis."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta * (2 / beta + F.sqrt(1 + 4 / (beta * beta)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def normality(df, cols):
    """Normality of the values and of their logs (only where more than 80% are positive)."""
    v = as_double
    logs = lambda c: F.when(v(c) > 0, F.log(v(c)))
    t = metric_table(df, cols, {
        "n": lambda c: F.count(v(c)), "skewness": lambda c: F.skewness(v(c)), "kurtosis": lambda c: F.kurtosis(v(c)),
        "ln": lambda c: F.count(logs(c)), "ls": lambda c: F.skewness(logs(c)), "lk": lambda c: F.kurtosis(logs(c)),
    })
    k2 = k_squared(F.col("n"), F.col("skewness"), F.col("kurtosis"))
    lk2 = F.when(F.col("ln") > 0.8 * F.col("n"), k_squared(F.col("ln"), F.col("ls"), F.col("lk")))
    return t.withColumn("k2", k2).withColumn("log_k2", lk2).select(
        "column", "n", "skewness", "kurtosis", "k2", F.exp(-F.col("k2") / 2).alias("p_value"),
        "log_k2", F.coalesce(F.exp(-F.col("log_k2") / 2), F.lit(0.0)).alias("log_p_value"))


def ks_uniform(df, cols):
    """Largest distance between the empirical distribution and the uniform one on [min, max]."""
    ranks = value_ranks(df, cols)
    span = metric_table(df, cols, {"total": lambda c: F.count(as_double(c)), "lo": lambda c: F.min(as_double(c)), "hi": lambda c: F.max(as_double(c))})
    u = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    above = F.col("upto") / F.col("total") - u
    below = u - (F.col("upto") - F.col("n")) / F.col("total")
    d = ranks.join(F.broadcast(span), "column").groupBy("column", "total").agg(F.max(F.greatest(above, below)).alias("d"))
    return d.select("column", F.col("total").alias("n"), "d", p_value("ks", F.col("d"), F.col("total")).alias("p_value"))


def distribution_type(df, cols):
    """One label per column, the first test that passes at 5%."""
    t = normality(df, cols).join(F.broadcast(ks_uniform(df, cols).select("column", F.col("p_value").alias("uniform_p"))), "column")
    label = (
        F.when(F.col("p_value") > 0.05, "normal").when(F.col("log_p_value") > 0.05, "log_normal")
        .when(F.col("uniform_p") > 0.05, "uniform").when(F.abs("skewness") > 1, "skewed")
        .when(F.col("kurtosis") > 1, "heavy_tailed").otherwise("unknown"))
    return t.select("column", label.alias("distribution"), "p_value", "log_p_value", "uniform_p")


def _both_ways(pairs, value):
    return pairs.select(F.col("a").alias("column"), F.col(value).alias("_x")).unionByName(
        pairs.select(F.col("b").alias("column"), F.col(value).alias("_x")))


def correlation_importance(df, cols):
    """Share of each column in the sum of absolute correlations."""
    total = Window.partitionBy()
    s = _both_ways(pearson(df, cols), "r").groupBy("column").agg(F.sum(F.abs("_x")).alias("s"))
    return s.select("column", (F.col("s") / F.sum("s").over(total)).alias("importance"))


def variance_correlation_importance(df, cols):
    """Mean of the variance share and (with more than two columns) the correlation share."""
    total = Window.partitionBy()
    v = metric_table(df, cols, {"v": lambda c: F.var_samp(as_double(c))})
    share = v.select("column", (F.col("v") / F.sum("v").over(total)).alias("share"))
    if len(cols) <= 2:
        return share.withColumnRenamed("share", "importance")
    return share.join(correlation_importance(df, cols), "column").select(
        "column", ((F.col("share") + F.col("importance")) / 2).alias("importance"))


def select_k_best(df, target, cols, k):
    """Columns with the largest univariate regression F against the target (nulls read as the column mean)."""
    means = df.agg(*[F.avg(as_double(c)).alias(c) for c in cols]).first().asDict()
    filled = df.select(as_double(target).alias("_y"), *[F.coalesce(as_double(c), F.lit(means[c])).alias(c) for c in cols])
    t = metric_table(filled, cols, {"r": lambda c: clean_corr(col(c), F.col("_y")), "n": lambda c: F.count(F.when(F.col("_y").isNotNull(), col(c)))})
    r2 = F.col("r") * F.col("r")
    scored = t.select("column", (r2 / (1 - r2) * (F.col("n") - 2)).alias("f_score"))
    return scored.orderBy(F.desc_nulls_last("f_score"), "column").limit(k)


def mutual_information(df, target, cols, bins=10):
    """Mutual information (nats) between equal-width bins of each column and of the target."""
    row = df.agg(*[x for i, c in enumerate([target, *cols]) for x in (F.min(as_double(c)).alias(f"lo{i}"), F.max(as_double(c)).alias(f"hi{i}"))]).first()
    cut = lambda i, c: F.least(F.floor((as_double(c) - F.lit(row[f"lo{i}"])) * bins / F.lit((row[f"hi{i}"] - row[f"lo{i}"]) or 1.0)), F.lit(bins - 1))
    long = df.select(cut(0, target).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), cut(i + 1, c).alias("x")) for i, c in enumerate(cols)])).alias("_s")).select("y", "_s.*")
    joint = long.dropna().groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    parts = joint.withColumns({"nx": over("column", "x"), "ny": over("column", "y"), "t": over("column")})
    n, t = F.col("n"), F.col("t")
    return parts.groupBy("column").agg(F.sum(n / t * F.log(n * t / (F.col("nx") * F.col("ny")))).alias("mutual_information"))


def select_uncorrelated(df, cols, k):
    """Up to k columns by variance, skipping any with |rho| > 0.8 to one already taken."""
    variances = {x["column"]: x["v"] for x in metric_table(df, cols, {"v": lambda c: F.var_samp(as_double(c))}).collect()}
    ranked = sorted((c for c in cols if variances[c] is not None), key=lambda c: (-variances[c], c))[:k]
    live = [c for c in ranked if variances[c] > 0]
    rho = {frozenset((x["a"], x["b"])): abs(x["rho"] or 0.0) for x in spearman(df, live).collect()} if len(live) > 1 else {}
    chosen = []
    for c in ranked:
        if all(rho.get(frozenset((c, s)), 0.0) <= 0.8 for s in chosen):
            chosen.append(c)
    return df.sparkSession.createDataFrame([(i + 1, c, variances[c]) for i, c in enumerate(chosen)], "position int, column string, variance double")


def polynomial_fit(df, x, y):
    """R-squared of a line and of a parabola, from three correlations with centred x."""
    rows = df.select(as_double(x).alias("x"), as_double(y).alias("y")).dropna()
    mean = rows.agg(F.avg("x")).first()[0]
    z = F.col("x") - F.lit(mean)
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.corr(F.col("y"), z).alias("a"), F.corr(F.col("y"), z * z).alias("b"), F.corr(z, z * z).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    out = t.select("n", (a * a).alias("linear_r2"), ((a * a + b * b - 2 * a * b * c) / (1 - c * c)).alias("quadratic_r2"), (b - a * c).alias("_lead"))
    bent = (F.col("n") > 10) & (F.col("quadratic_r2") > F.col("linear_r2") + 0.1)
    kind = F.when(bent & (F.col("_lead") > 0), "quadratic (U-shaped)").when(bent, "quadratic (inverted U-shaped)").otherwise("linear")
    return out.withColumn("relationship", kind).drop("_lead")


def regression_line(df, x, y):
    """Slope, intercept and the two end points of the fitted line."""
    rows = df.select(as_double(x).alias("x"), as_double(y).alias("y")).dropna()
    t = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("x1"), F.max("x").alias("x2"))
    at = lambda v: F.col("slope") * F.col(v) + F.col("intercept")
    return t.select("slope", "intercept", "x1", at("x1").alias("y1"), "x2", at("x2").alias("y2"))


def likert_pairs(df, cols, threshold=0.6):
    """Scale questions answered alike: |rho| (2 digits) above the threshold."""
    rho = F.round("rho", 2)
    return spearman(df, cols).select("a", "b", rho.alias("rho")).filter(F.abs("rho") > threshold).select(
        "a", "b", "rho", F.when(F.col("rho") > 0, "positive").otherwise("negative").alias("direction"),
        F.when(F.abs("rho") > 0.8, "strong").otherwise("moderate").alias("strength"))


def likert_consensus(df, cols):
    """Polarisation (absolute skew) and consensus (share of the top answer)."""
    stats = metric_table(df, cols, {"low": lambda c: F.min(as_double(c)), "high": lambda c: F.max(as_double(c)),
                                    "polarization": lambda c: F.abs(corrected_skew(as_double(c)))})
    top = value_counts(df, cols).groupBy("column").agg((F.max("n") / F.sum("n")).alias("consensus"))
    return stats.join(F.broadcast(top), "column").select(
        "column", "low", "high", "polarization", F.when(F.col("polarization") > 0.5, "high").otherwise("low").alias("polarization_type"),
        "consensus", F.when(F.col("consensus") > 0.7, "high").when(F.col("consensus") > 0.5, "medium").otherwise("low").alias("consensus_type"))


def binary_bias(df, cols):
    """Most and least common value and the ratio of their counts."""
    t = binary_summary(df, cols)
    low = F.struct("n", "value")
    high = F.struct((-F.col("n")).alias("neg"), "value")
    g = t.groupBy("column").agg(F.min(high).alias("hi"), F.min(low).alias("lo"), F.sum("n").alias("total"))
    n = -F.col("hi.neg")
    return g.select("column", F.col("hi.value").alias("most_common"), F.col("lo.value").alias("least_common"), n.alias("most_count"),
                    (100.0 * n / F.col("total")).alias("most_percent"), (n / F.col("lo.n")).alias("bias_ratio"))
