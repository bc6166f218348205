"""Time-series analysis of many series at once.

A series frame is (series_id, ts, value) on a regular grid, made by ``prepare_series``. Resampling comes
first and is a partial aggregate, so a series never has more rows than periods in its time span, however
many raw rows its key has; the keyed windows below rest on that bound.
"""

# The wording of all sentences below; results must agree on it.
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.special import p_value
from ..session import pin
from .common import as_double, col, join_on, series_name, union_all
from .ordered import choose_frequency, resample
from .quantiles import median_table, quantile_table

# Seasonal period per sampling frequency.
PERIODS = {"h": 24, "d": 7, "w": 52, "m": 12, "q": 4, "y": 1}


def in_order():
    return Window.partitionBy("series_id").orderBy("ts")


def prepare_series(df, ts, value, by=(), freq=None):
    """Resample to period means and fill inner gaps linearly; ``freq`` defaults to the choice for the whole table."""
    freq = freq or choose_frequency(df, ts).first()["freq"]
    name = series_name(by) if by else F.lit(value)
    rows = df.select(name.alias("series_id"), col(ts).alias("ts"), as_double(value).alias("value"))
    return resample(rows, "ts", "value", freq, ["series_id"], fill=True).select("series_id", "ts", "value")


def positions(s):
    """Add the 0-based position and the series length."""
    return s.filter(F.col("value").isNotNull()).withColumns({
        "pos": F.row_number().over(in_order()) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})


def series_info(s):
    """Span and descriptive statistics per series."""
    v = F.col("value")
    t = s.groupBy("series_id").agg(
        F.count(v).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.min_by("value", "ts").alias("first_value"), F.max_by("value", "ts").alias("last_value"))
    return join_on(t, median_table(s, ["value"], ["series_id"]).select("series_id", "median"), ["series_id"])


def analyze_series(df, ts, value, by=(), freq=None):
    return series_info(prepare_series(df, ts, value, by, freq))


def series_outliers(s):
    """Rows with flags for |z| > 3 and for the 1.5 x IQR fences, and either."""
    each = Window.partitionBy("series_id")
    q = quantile_table(s, ["value"], [.25, .75], ["series_id"]).select("series_id", F.col("q")[0].alias("_a"), F.col("q")[1].alias("_b"))
    v, iqr = F.col("value"), F.col("_b") - F.col("_a")
    z = (v - F.avg(v).over(each)) / F.stddev_samp(v).over(each)
    t = join_on(s.withColumn("z", z), q, ["series_id"])
    flags = t.withColumns({"z_outlier": F.coalesce(F.abs("z") > 3, F.lit(False)), "iqr_outlier": (v < F.col("_a") - 1.5 * iqr) | (v > F.col("_b") + 1.5 * iqr)})
    return flags.withColumn("outlier", F.col("z_outlier") | F.col("iqr_outlier")).drop("_a", "_b")


def forest_outliers(s, contamination=0.05, least=30):
    """(series_id, ts, value, z, anomaly_score, is_outlier) of series with at least ``least`` points: one isolation forest over
    the z-score and the relative position, which all series share."""
    from .learn import isolation_forest
    t = positions(s).filter(F.col("n") >= least)
    each = Window.partitionBy("series_id")
    z = F.coalesce((F.col("value") - F.avg("value").over(each)) / F.nullif(F.stddev_samp("value").over(each), F.lit(0.0)), F.lit(0.0))
    t = pin(t.withColumns({"z": z, "share": F.col("pos") / F.col("n"), "_key": F.to_json(F.struct("series_id", "ts"))}))
    return isolation_forest(t, ["z", "share"], "_key", contamination).select("series_id", "ts", "value", "z", "anomaly_score", "is_outlier")


def outlier_summary(flags, first=10):
    """Counts, range and the first few outliers of each series."""
    out = flags.filter("outlier")
    rank = F.row_number().over(in_order())
    head = out.withColumn("_r", rank).filter(F.col("_r") <= first).groupBy("series_id").agg(F.array_sort(F.collect_list("ts")).alias("first_outliers"))
    t = out.groupBy("series_id").agg(F.count_if("z_outlier").alias("z_outliers"), F.count_if("iqr_outlier").alias("iqr_outliers"),
                                     F.count(F.lit(1)).alias("outliers"), F.min("value").alias("min"), F.max("value").alias("max"))
    return join_on(t, head, ["series_id"])


def repair_outliers(s):
    """Replace outliers by the centred rolling median over min(7, max(1, n / 5)) rows."""
    t = positions(series_outliers(s))
    w = F.least(F.lit(7), F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    near = F.collect_list(F.struct("pos", "value")).over(in_order().rowsBetween(-3, 3))
    t = t.withColumns({"_w": w, "_near": near})
    lo, hi = F.col("pos") - F.floor(F.col("_w") / 2), F.col("pos") + F.col("_w") - 1 - F.floor(F.col("_w") / 2)
    held = F.sort_array(F.transform(F.filter("_near", lambda x: (x["pos"] >= lo) & (x["pos"] <= hi)), lambda x: x["value"]))
    t = t.withColumn("_held", held)
    k = F.size("_held")
    mid = (F.get("_held", F.floor((k - 1) / 2).cast("int")) + F.get("_held", F.floor(k / 2).cast("int"))) / 2
    return t.select("series_id", "ts", F.when(F.col("outlier"), mid).otherwise(F.col("value")).alias("value"))


def variance_ratio(s):
    """Largest over smallest variance of up to 5 equal parts; below 3 is even."""
    t = positions(s)
    parts = F.least(F.lit(5), F.floor(F.col("n") / 20))
    t = t.withColumn("_parts", parts).withColumn("part", F.floor(F.col("pos") / F.floor(F.col("n") / F.greatest("_parts", F.lit(1)))))
    v = t.filter((F.col("_parts") >= 2) & (F.col("part") < F.col("_parts"))).groupBy("series_id", "part").agg(F.var_samp("value").alias("v"))
    g = v.groupBy("series_id").agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    ratio = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo"))
    return g.select("series_id", ratio.alias("variance_ratio"), F.coalesce(ratio < 3, F.lit(False)).alias("homoscedastic"))


def decompose(s, period, extend=True):
    """Additive trend (centred moving average), seasonal means and residual.

    With ``extend`` the trend's open ends continue the line through its nearest ``period`` points.
    """
    half = period // 2
    frame = in_order().rowsBetween(-half, half)
    t = positions(s).filter(F.col("n") >= 2 * period)
    total = F.sum("value").over(frame)
    if period % 2 == 0:
        total = total - (F.lag("value", half).over(in_order()) + F.lead("value", half).over(in_order())) / 2
    t = t.withColumn("trend", F.when(F.count("value").over(frame) == 2 * half + 1, total / period))
    if extend:
        front, back = F.lit(half), F.col("n") - 1 - half
        early = (F.col("pos") >= front) & (F.col("pos") < F.least(front + period, back))
        late = (F.col("pos") >= F.greatest(front, back - period)) & (F.col("pos") < back)
        fit = lambda fn, cond: fn(F.when(cond, F.col("trend")), F.when(cond, F.col("pos"))).over(Window.partitionBy("series_id"))
        t = t.withColumns({"_ka": fit(F.regr_slope, early), "_na": fit(F.regr_intercept, early), "_kb": fit(F.regr_slope, late), "_nb": fit(F.regr_intercept, late)})
        line = F.when(F.col("pos") < half, F.col("_ka") * F.col("pos") + F.col("_na")).otherwise(F.col("_kb") * F.col("pos") + F.col("_nb"))
        t = t.withColumn("trend", F.coalesce("trend", line)).drop("_ka", "_na", "_kb", "_nb")
    t = t.withColumn("_slot", F.col("pos") % period)
    means = t.groupBy("series_id", "_slot").agg(F.avg(F.col("value") - F.col("trend")).alias("_m"))
    means = means.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy("series_id"))).drop("_m")
    out = join_on(t, means, ["series_id", "_slot"]).drop("_slot")
    return out.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal")).select("series_id", "ts", "pos", "value", "trend", "seasonal", "residual")


def decomposition_summary(parts):
    """Strength of trend and season (present above 0.3) and direction of the trend."""
    rest, flat = F.var_pop("residual"), F.var_pop(F.col("value") - F.col("trend"))
    g = parts.groupBy("series_id").agg(
        rest.alias("_r"), flat.alias("_d"), F.var_pop("value").alias("_v"), F.count("trend").alias("_n"),
        F.regr_slope("trend", "pos").alias("_s"), F.corr("trend", "pos").alias("_c"))
    share = lambda whole: F.when(whole > 1e-300, F.greatest(F.lit(0.0), 1 - F.col("_r") / whole)).otherwise(0.0)
    g = g.withColumns({"seasonality_strength": share(F.col("_d")), "trend_strength": share(F.col("_v"))})
    t = F.abs("_c") * F.sqrt((F.col("_n") - 2) / F.greatest(1 - F.col("_c") * F.col("_c"), F.lit(1e-300)))
    sure = (F.abs("_c") > 0.5) & (p_value("t", t, F.col("_n") - 2) < 0.05)
    direction = F.when(F.coalesce(sure, F.lit(False)), F.when(F.col("_s") > 0, "increasing").otherwise("decreasing")).otherwise("no significant direction")
    return g.select("series_id", "seasonality_strength", "trend_strength", (F.col("seasonality_strength") > 0.3).alias("has_seasonality"),
                    (F.col("trend_strength") > 0.3).alias("has_trend"), direction.alias("trend_direction"))


def decomposition_text(summary):
    """One sentence on each series' trend and season, and what they suggest."""
    strength = lambda c: F.format_string("%.2f", c)
    trend = F.when(~F.col("has_trend"), "does not show a significant trend").when(
        F.col("trend_direction").isin("increasing", "decreasing"),
        F.concat(F.when(F.col("trend_direction") == "increasing", "shows an increasing").otherwise("shows a decreasing"), F.lit(" trend (strength: "), strength("trend_strength"), F.lit(")"))).otherwise(
        F.concat(F.lit("has a trend component (strength: "), strength("trend_strength"), F.lit(") without clear direction")))
    season = F.when(F.col("has_seasonality"), F.concat(F.lit(" and exhibits seasonality (strength: "), strength("seasonality_strength"), F.lit(")"))).otherwise(" and does not show significant seasonality")
    a, b = F.col("has_trend"), F.col("has_seasonality")
    tail = F.when(a & b, "both long-term directional movement and regular cyclical patterns").when(a, "long-term directional movement but no regular cycles").when(
        b, "regular cycles around a stable mean").otherwise("a relatively stable series without strong patterns")
    return summary.select("series_id", F.concat(F.lit("The time series "), trend, season, F.lit(". This suggests "), tail, F.lit(".")).alias("text"))


def seasonal_strength(s, freq="m"):
    """Mean absolute season over the sum of mean absolute trend, season and residual; significant above 0.3."""
    period = {"m": 12, "d": 12, "q": 4, "w": 52}[freq]
    g = decompose(s, period, extend=False).groupBy("series_id").agg(*[F.avg(F.abs(c)).alias(c) for c in ("trend", "seasonal", "residual")])
    share = F.col("seasonal") / (F.col("trend") + F.col("seasonal") + F.col("residual"))
    return g.select("series_id", share.alias("seasonal_strength"), (share > 0.3).alias("significant"))


def acf(s, lags=40):
    """(series_id, lag, acf, limit, significant) to min(lags, n / 4); all lags in one aggregate."""
    t = positions(s)
    t = t.withColumn("d", F.col("value") - F.avg("value").over(Window.partitionBy("series_id")))
    t = t.withColumns({f"l{k}": F.lag("d", k).over(in_order()) for k in range(1, lags + 1)})
    g = t.groupBy("series_id").agg(F.first("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("c0"), *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    long = g.select("series_id", "n", "c0", F.posexplode(F.array(*[F.col(f"c{k}") for k in range(lags + 1)])).alias("lag", "c"))
    r, limit = F.col("c") / F.col("c0"), 1.96 / F.sqrt("n")
    kept = long.filter((F.col("n") >= 3) & (F.col("lag") <= F.floor(F.col("n") / 4)) & (F.col("c0") > 0))
    return kept.select("series_id", "lag", r.alias("acf"), limit.alias("limit"), ((F.col("lag") > 0) & (F.abs(r) > limit)).alias("significant"))


def levinson(r):
    """Partial autocorrelations from autocorrelations r[0..m] by the Durbin recursion."""
    m = len(r) - 1
    out, phi = np.ones(m + 1), np.zeros(0)
    for k in range(1, m + 1):
        den = 1.0 - phi @ r[1:k]
        last = (r[k] - phi @ r[k - 1:0:-1]) / den if abs(den) > 1e-12 else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def pacf(correlations):
    """(series_id, lag, pacf, limit, significant) from an ``acf`` table (at most 41 rows per series)."""
    def solve(pdf):
        pdf = pdf.sort_values("lag")
        pdf["pacf"] = levinson(pdf["acf"].to_numpy())
        pdf["significant"] = (pdf["lag"] > 0) & (pdf["pacf"].abs() > pdf["limit"])
        return pdf[["series_id", "lag", "pacf", "limit", "significant"]]
    return correlations.groupBy("series_id").applyInPandas(solve, "series_id string, lag int, pacf double, limit double, significant boolean")


def order_hint(correlations, partials):
    """AR and MA order suggested by where the (partial) autocorrelations first fall inside the limit."""
    def cut(t, name):
        inside = F.when((F.col("lag") > 0) & (F.abs(name) <= F.col("limit")), F.col("lag"))
        return t.groupBy("series_id").agg(F.coalesce(F.min(inside), F.max("lag") + 1).alias(f"{name}_cut"))
    t = join_on(cut(correlations, "acf"), cut(partials, "pacf"), ["series_id"])
    a, p = F.col("acf_cut"), F.col("pacf_cut")
    same = ((a > 5) & (p > 5)) | ((a <= 5) & (p <= 5))
    ar = F.when(same, F.least(F.lit(2), p)).when((p <= 5) & (a > 5), p).otherwise(0)
    ma = F.when(same, F.least(F.lit(2), a)).when((a <= 5) & (p > 5), a).otherwise(0)
    return t.select("series_id", "acf_cut", "pacf_cut", F.when((ar == 0) & (ma == 0), 1).otherwise(ar).alias("ar_order"), ma.alias("ma_order"))


def pelt(x, penalty, min_size):
    """Change points of the mean by pruned exact search on squared error."""
    n = len(x)
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    best, prev, live = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.array([0])
    best[0] = -penalty
    for t in range(min_size, n + 1):
        size = t - live
        cost = s2[t] - s2[live] - (s1[t] - s1[live]) ** 2 / size
        total = np.where(size >= min_size, best[live] + cost + penalty, np.inf)
        at = int(np.argmin(total))
        best[t], prev[t] = total[at], live[at]
        keep = (size < min_size) | (best[live] + cost <= best[t])
        live = np.append(live[keep], t - min_size + 1)
    cuts, t = [], n
    while t > 0 and np.isfinite(best[t]):
        t = prev[t]
        if t > 0:
            cuts.append(int(t))
    return sorted(cuts)


def change_points(s, penalty=10.0, min_size=5, top=5):
    """(series_id, pos, ts, value, magnitude, percent_change): the largest shifts of the mean per series."""
    def find(pdf):
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        x = pdf["value"].to_numpy(dtype=float)
        cuts = pelt(x, penalty, min_size)
        edges = [0, *cuts, len(x)]
        rows = []
        for i, c in enumerate(cuts, 1):
            before, after = x[edges[i - 1]:c].mean(), x[c:edges[i + 1]].mean()
            rows.append((pdf["series_id"].iloc[0], c, pdf["ts"].iloc[c], x[c], abs(after - before), abs(after - before) / abs(before) * 100 if before else 0.0))
        rows.sort(key=lambda r: (-r[4], r[1]))
        return pd.DataFrame(rows[:top], columns=["series_id", "pos", "ts", "value", "magnitude", "percent_change"])
    return s.filter(F.col("value").isNotNull()).groupBy("series_id").applyInPandas(
        find, "series_id string, pos int, ts timestamp, value double, magnitude double, percent_change double")


def zscore_change_points(s, top=5, threshold=3.0):
    """Change points without a search: trailing z-scores above ``threshold`` that are the largest within a window's distance."""
    t = positions(s)
    w = F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.col("n") / 5))).cast("int")
    held = F.collect_list("value").over(in_order().rowsBetween(-9, 0))
    t = t.withColumn("w", w).withColumn("_h", held).filter(F.size("_h") >= F.col("w"))
    t = t.withColumn("_h", F.slice("_h", F.size("_h") - F.col("w") + 1, F.col("w")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    t = t.withColumn("_m", total(F.col("_h")) / F.col("w"))
    t = t.withColumn("_s", F.sqrt(total(F.transform("_h", lambda v: (v - F.col("_m")) * (v - F.col("_m")))) / (F.col("w") - 1)))
    t = t.filter(F.col("pos") >= F.col("w")).withColumn("z_score", F.when(F.col("_s") > 0, F.abs(F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0))
    around = F.collect_list(F.struct("pos", "z_score")).over(in_order().rowsBetween(-9, 9))
    rival = F.exists(around, lambda x: (F.abs(x["pos"] - F.col("pos")) < F.col("w")) & ((x["z_score"] > F.col("z_score")) | ((x["z_score"] == F.col("z_score")) & (x["pos"] < F.col("pos")))))
    peaks = t.withColumn("_rival", rival).filter((F.col("z_score") > threshold) & ~F.col("_rival"))
    r = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("z_score"), "pos"))
    return peaks.withColumn("_r", r).filter(F.col("_r") <= top).select("series_id", "pos", "ts", "value", "z_score")


def periodicity(s, top=3):
    """(series_id, rank, period, power): the strongest cycles of the detrended periodogram."""
    def find(pdf):
        x = pdf.sort_values("ts")["value"].to_numpy(dtype=float)
        n = len(x)
        rows = []
        if n >= 20:
            at = np.arange(n)
            x = x - np.polyval(np.polyfit(at, x, 1), at)
            power = np.abs(np.fft.rfft(x)) ** 2 / n
            power[1:(-1 if n % 2 == 0 else None)] *= 2
            power[0] = 0.0
            inner = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] > power[2:])) + 1
            chosen = []
            for p in sorted(inner[power[inner] >= 0.1 * power.max()], key=lambda p: -power[p]):
                if all(abs(p - c) >= 5 for c in chosen):
                    chosen.append(p)
            rows = [(pdf["series_id"].iloc[0], i + 1, n / p, float(power[p])) for i, p in enumerate(chosen[:top])]
        return pd.DataFrame(rows, columns=["series_id", "rank", "period", "power"])
    return s.filter(F.col("value").isNotNull()).groupBy("series_id").applyInPandas(find, "series_id string, rank int, period double, power double")


def series_evidence(s, period):
    """One row per series with everything the recommendations and insights look at."""
    from .forecast import adf
    mark = lambda t, name: t.groupBy("series_id").agg(F.count(F.lit(1)).alias(name))
    out = s.groupBy("series_id").agg(F.count("value").alias("n"))
    for t in (decomposition_summary(decompose(s, period)), adf(s).select("series_id", "adf_p_value", "stationary"), variance_ratio(s),
              mark(change_points(s), "change_points"), mark(periodicity(s), "cycles"), mark(series_outliers(s).filter("z_outlier"), "z_outliers")):
        out = join_on(out, t, ["series_id"], "left")
    return out.na.fill(0, ["change_points", "cycles", "z_outliers"])


def series_recommendations(evidence):
    """(series_id, position, text): modelling advice per series."""
    is_, no = lambda c: F.coalesce(F.col(c), F.lit(False)), lambda c: ~F.coalesce(F.col(c), F.lit(True))
    rules = [
        (no("stationary"), F.lit("Apply differencing to make the time series stationary before modeling.")),
        (no("stationary") & no("homoscedastic"), F.lit("Consider applying log or Box-Cox transformation to stabilize variance.")),
        (is_("has_seasonality"), F.lit("Use seasonal models (like SARIMA) to capture the seasonal patterns in the data.")),
        (is_("has_trend") & F.col("trend_direction").isin("increasing", "decreasing"),
         F.concat(F.when(F.col("trend_direction") == "increasing", "The series shows an increasing").otherwise("The series shows a decreasing"), F.lit(" trend. Use models that can capture this movement."))),
        (is_("has_seasonality"), F.lit("SARIMA is recommended for this time series due to its seasonal patterns.")),
        (~is_("has_seasonality") & is_("has_trend"), F.lit("ARIMA with appropriate differencing is suitable for capturing the trend in this time series.")),
        (~is_("has_seasonality") & ~is_("has_trend"), F.lit("Simple forecasting methods like ARIMA or exponential smoothing may be sufficient for this time series.")),
        (F.col("change_points") > 0, F.lit("The time series contains structural changes. Consider using piecewise models or including regime variables.")),
        (F.col("cycles") > 0, F.lit("The detected periodicity should be incorporated into the modeling approach, possibly using Fourier terms.")),
        (F.col("z_outliers") > 0, F.lit("Consider treating outliers before modeling to improve forecast accuracy.")),
        (F.lit(True), F.lit("If available, include relevant external variables to improve forecast accuracy.")),
        (F.lit(True), F.lit("Use time series cross-validation techniques to evaluate model performance more reliably.")),
    ]
    entries = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("position"), t.alias("text"))) for i, (c, t) in enumerate(rules, 1)]))
    return evidence.select("series_id", F.explode(entries).alias("_e")).select("series_id", "_e.*")


def stack_series(df, dates, values, freq="d"):
    """All date x value pairs as series named ``value by date``, each resampled in one job."""
    parts = F.explode(F.array(*[F.struct(F.lit(f"{v} by {d}").alias("series_id"), col(d).cast("timestamp").alias("ts"), as_double(v).alias("value")) for d in dates for v in values]))
    rows = df.select(parts.alias("_p")).select("_p.*").filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    return resample(rows, "ts", "value", freq, ["series_id"], fill=True).select("series_id", "ts", "value")


def analyze_all_series(df, roles, freq="m", columns=None):
    """Info and decomposition of every date column with every numeric column; ``columns`` keeps some of them only."""
    from .roles import columns_by_role
    by = {r: [c for c in cs if columns is None or c in columns] for r, cs in columns_by_role(roles).items()}
    s = pin(stack_series(df, by.get("datetime", []), by.get("numeric", []), freq))
    return join_on(series_info(s), decomposition_summary(decompose(s, PERIODS[freq])), ["series_id"], "left")
