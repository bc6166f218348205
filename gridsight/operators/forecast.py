"""Unit-root test and ARIMA forecasts, one task per resampled series (see ``series.prepare_series``).

Models are fitted by exact likelihood (``state_space``): multiplicative seasonal polynomials, regressors by generalised
least squares, missing values skipped by the filter.
"""

# The wording of all sentences below; results must agree on it.
import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import join_on
from .ordered import choose_frequency
from .state_space import Sarimax
from .series import PERIODS, acf, decompose, decomposition_summary, levinson, pacf, positions, prepare_series, repair_outliers

# MacKinnon's response surface for a unit-root test with a constant.
TAU = {"min": -18.83, "star": -1.61, "max": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)}


def _ols(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, y - x @ beta


def adf_test(x):
    """(statistic, p-value, lags) of the augmented Dickey-Fuller test with the lag count of the best AIC."""
    n = len(x)
    d = np.diff(x)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))
    if n < 6 or np.allclose(d, d[0] if len(d) else 0):
        return np.nan, np.nan, 0

    def fit(lags, skip):
        y = d[skip:]
        cols = [x[skip:-1], np.ones(len(y))] + [d[skip - k:len(d) - k] for k in range(1, lags + 1)]
        m = np.column_stack(cols)
        beta, e = _ols(m, y)
        return m, beta, e

    def aic(lags):
        m, _, e = fit(lags, most)
        k = len(e)
        return k * math.log(max(e @ e / k, 1e-300)) + 2 * m.shape[1]

    lags = min(range(most + 1), key=aic)
    m, beta, e = fit(lags, lags)
    s2 = e @ e / max(len(e) - m.shape[1], 1)
    t = float(beta[0] / math.sqrt(max(s2 * np.linalg.pinv(m.T @ m)[0, 0], 1e-300)))
    if t > TAU["max"] or t < TAU["min"]:
        return t, 1.0 if t > TAU["max"] else 0.0, lags
    c = TAU["small"] if t <= TAU["star"] else TAU["large"]
    return t, 0.5 * math.erfc(-sum(v * t ** i for i, v in enumerate(c)) / math.sqrt(2)), lags


def adf(s):
    """(series_id, adf_statistic, adf_p_value, lags, stationary)"""
    def run(pdf):
        t, p, k = adf_test(pdf.sort_values("ts")["value"].to_numpy(dtype=float))
        return pd.DataFrame([(pdf["series_id"].iloc[0], t, p, k, bool(p < 0.05))], columns=["series_id", "adf_statistic", "adf_p_value", "lags", "stationary"])
    return s.filter(F.col("value").isNotNull()).groupBy("series_id").applyInPandas(run, "series_id string, adf_statistic double, adf_p_value double, lags int, stationary boolean")


def _correlations(x, lags):
    d = x - x.mean()
    c0 = d @ d
    return np.array([1.0] + [(d[k:] @ d[:-k]) / c0 if c0 > 0 else 0.0 for k in range(1, lags + 1)])


def _first_inside(r, limit):
    for i in range(1, min(10, len(r))):
        if abs(r[i]) < limit:
            return max(i - 1, 1)
    return 1


def orders_of(x, seasonal, period):
    """(p, d, q, s) of one series."""
    if len(x) < 8:
        return 1, 0, 0, 0
    d, used = 0, x
    while d < 2 and not adf_test(used)[1] < 0.05:
        if len(used) < 9:
            break
        d, used = d + 1, np.diff(used)
    if d == 2 and not adf_test(used)[1] < 0.05:
        d, used = 1, np.diff(x)
    season = period if seasonal and period > 1 and len(x) > 3 * period else 0
    if len(used) < 8:
        return 1, d, 1, season
    r = _correlations(used, min(40, len(x) // 4))
    limit = 1.96 / math.sqrt(len(used))
    return min(3, _first_inside(levinson(r), limit)), d, min(3, _first_inside(r, limit)), season


def arima_orders(s, period=12, seasonal=None):
    """(series_id, p, d, q, season). ``seasonal`` holds (series_id, has_seasonality); without it no season is used."""
    rows = s.filter(F.col("value").isNotNull())
    rows = join_on(rows, seasonal, ["series_id"], "left").na.fill(False, ["has_seasonality"]) if seasonal is not None else rows.withColumn("has_seasonality", F.lit(False))

    def run(pdf):
        o = orders_of(pdf.sort_values("ts")["value"].to_numpy(dtype=float), bool(pdf["has_seasonality"].iloc[0]), period)
        return pd.DataFrame([(pdf["series_id"].iloc[0], *o)], columns=["series_id", "p", "d", "q", "season"])
    return rows.groupBy("series_id").applyInPandas(run, "series_id string, p int, d int, q int, season int")


def fit_arima(x, p, d, q, season, exog=None):
    """A fitted model of one series, NaN where values are missing; short series get fewer terms. Seasonal orders are (1, 0, 1)."""
    n = int(np.isfinite(x).sum())
    if season and n < 2 * season + p + q + d + 4:
        season = 0
    if n < 2 * (p + q) + d + 4:
        p, q = int(n > 6), 0
    return Sarimax(x, (p, d, q), (1, 0, 1) if season else (0, 0, 0), season, exog).fit()


# Two-sided points of the normal distribution.
Z = {0.8: 1.2815515655446004, 0.9: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def _future(ts, h):
    """Times of the next h periods: whole months or years where the grid has them, else the median step."""
    ts = pd.DatetimeIndex(ts)
    step = np.median(np.diff(ts.asi8)) if len(ts) > 1 else pd.Timedelta(days=1).value
    days = step / pd.Timedelta(days=1).value
    months = 1 if 28 <= days <= 31 else 3 if 89 <= days <= 92 else 12 if 365 <= days <= 366 else 0
    if months and (ts.day == ts[-1].day).all():
        return [ts[-1] + pd.DateOffset(months=months * (i + 1)) for i in range(h)]
    return [ts[-1] + pd.Timedelta(int(step) * (i + 1), unit=ts.unit) for i in range(h)]


FORECAST = "series_id string, step int, ts timestamp, forecast double, lower double, upper double, aic double, bic double, mae double, mse double"


def forecast_arima(s, orders, h=10, level=0.95, exog=()):
    """(series_id, step, ts, forecast, lower, upper, aic, bic, mae, mse). Extra regressors are held at their last value.
    Periods whose value is null are gaps; those before the first and after the last value do not count."""
    exog = list(exog)
    rows = join_on(s, orders, ["series_id"])

    def run(pdf):
        pdf = pdf.sort_values("ts")
        known = np.flatnonzero(pdf["value"].notna().to_numpy())
        if not len(known):
            return pd.DataFrame()
        pdf = pdf.iloc[known[0]:known[-1] + 1]
        p, d, q, season = (int(pdf[c].iloc[0]) for c in ("p", "d", "q", "season"))
        given = pdf[exog].astype(float).ffill().bfill().fillna(0.0).to_numpy() if exog else None
        model = fit_arima(pdf["value"].to_numpy(dtype=float), p, d, q, season, given)
        path, variance = model.forecast(h, np.repeat(given[-1:], h, axis=0) if exog else None)
        wide = Z[level] * np.sqrt(variance)
        name, fit = pdf["series_id"].iloc[0], model.summary()
        return pd.DataFrame([(name, i + 1, t, path[i], path[i] - wide[i], path[i] + wide[i], *fit) for i, t in enumerate(_future(pdf["ts"], h))],
                            columns=[f.split()[0] for f in FORECAST.split(", ")])

    return rows.groupBy("series_id").applyInPandas(run, FORECAST)


def likelihood(s, p=1, d=0, q=0, seasonal=(0, 0, 0), season=0, constant=False):
    """(series_id, n, loglik, variance, ar ARRAY, ma ARRAY): the exact maximum of one model for every series."""
    schema = "series_id string, n long, loglik double, variance double, ar array<double>, ma array<double>"

    def run(pdf):
        y = pdf.sort_values("ts")["value"].to_numpy(dtype=float)
        model = Sarimax(y, (p, d, q), seasonal, season, constant=constant).fit()
        ar, ma = model.coefficients(model.theta)
        return pd.DataFrame([(pdf["series_id"].iloc[0], int(np.isfinite(y).sum()), model.at["loglik"], model.at["scale"], ar.tolist(), ma.tolist())], columns=[f.split()[0] for f in schema.split(", ")])

    return s.groupBy("series_id").applyInPandas(run, schema)


def rolling_validation(s, orders, folds=None):
    """(series_id, mae, rmse, mape, folds): one-step forecasts from 3 to 5 growing training spans."""
    t = join_on(positions(s), orders, ["series_id"])
    k = F.lit(folds) if folds else F.least(F.lit(5), F.greatest(F.lit(3), F.floor(F.col("n") / 20)))
    base = F.greatest(F.lit(8), F.floor(F.col("n") / 2))
    t = t.withColumns({"_k": k.cast("int"), "_base": base}).withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    t = t.withColumn("cut", F.col("_base") + F.floor(F.col("fold") * (F.col("n") - F.col("_base")) / F.col("_k")))
    t = t.filter((F.col("pos") <= F.col("cut")) & (F.col("cut") < F.col("n")))

    def run(pdf):
        pdf = pdf.sort_values("pos")
        x = pdf["value"].to_numpy(dtype=float)
        p, d, q, season = (int(pdf[c].iloc[0]) for c in ("p", "d", "q", "season"))
        guess = fit_arima(x[:-1], p, d, q, season).forecast(1)[0][0]
        return pd.DataFrame([(pdf["series_id"].iloc[0], int(pdf["fold"].iloc[0]), x[-1], float(guess))], columns=["series_id", "fold", "actual", "predicted"])

    each = t.groupBy("series_id", "fold").applyInPandas(run, "series_id string, fold int, actual double, predicted double")
    e = F.abs(F.col("actual") - F.col("predicted"))
    return each.groupBy("series_id").agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                         F.avg(F.when(F.col("actual") != 0, 100 * e / F.abs("actual"))).alias("mape"), F.count(F.lit(1)).alias("folds"))


def future_index(s, h):
    """(series_id, step, ts): the next h times at the series' median step."""
    gap = F.unix_seconds(F.col("ts")) - F.unix_seconds(F.lag("ts").over(Window.partitionBy("series_id").orderBy("ts")))
    from .quantiles import median_table
    m = median_table(s.withColumn("gap", gap), ["gap"], ["series_id"]).select("series_id", "median")
    last = join_on(s.groupBy("series_id").agg(F.max("ts").alias("last")), m, ["series_id"])
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h)))).select(
        "series_id", "step", F.timestamp_seconds(F.unix_seconds("last") + F.col("step") * F.col("median")).alias("ts"))


def forecast(df, ts, value, by=(), h=10, exog=(), freq=None):
    """Prepare, repair, choose orders and forecast every series; ``exog`` columns join as of each period."""
    freq = freq or choose_frequency(df, ts).first()["freq"]
    s = repair_outliers(prepare_series(df, ts, value, by, freq))
    season = decomposition_summary(decompose(s, PERIODS[freq])).select("series_id", "has_seasonality") if PERIODS[freq] > 1 else None
    orders = arima_orders(s, PERIODS[freq], season)
    if exog:
        from .relational import asof_join
        from .common import col, series_name
        name = series_name(by) if by else F.lit(value)
        side = df.select(name.alias("series_id"), col(ts).cast("timestamp").alias("ts"), *[col(x).cast("double").alias(x) for x in exog])
        s = asof_join(s, side, "ts", ["series_id"], right_key=exog[0])
    return forecast_arima(s, orders, h, exog=exog)


def forecast_insights(f, last_values):
    """(series_id, position, text): direction, steadiness and extremes. ``last_values`` holds (series_id, last_value)."""
    w = Window.partitionBy("series_id").orderBy("step")
    sign = F.signum(F.col("forecast") - F.lag("forecast").over(w))
    t = f.withColumn("_sign", sign).withColumn("_turn", (F.col("_sign") != F.lag("_sign").over(w)).cast("int"))
    g = t.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("h"), F.max_by("forecast", "step").alias("end"), F.min("_sign").alias("lo"), F.max("_sign").alias("hi"), F.sum("_turn").alias("turns"),
        F.max("forecast").alias("top"), F.min("forecast").alias("bottom"), F.max_by("step", F.struct("forecast", -F.col("step"))).alias("top_at"), F.min_by("step", F.struct("forecast", "step")).alias("bottom_at"))
    g = join_on(g, last_values, ["series_id"])
    change = (F.col("end") / F.col("last_value") - 1) * 100
    word = F.when(F.col("end") > F.col("last_value"), "increasing").otherwise("decreasing")
    overall = F.when(F.col("end") == F.col("last_value"), F.format_string("The forecast predicts a stable pattern over the next %d periods.", "h")).otherwise(
        F.format_string("The forecast predicts an overall %s trend of %.1f%% over the next %d periods.", word, F.abs(change), F.col("h")))
    shape = F.when(F.col("lo") > 0, "The forecast shows a consistent increasing pattern.").when(F.col("hi") < 0, "The forecast shows a consistent decreasing pattern.").when(
        F.col("turns") >= F.floor(F.col("h") / 2), "The forecast shows a fluctuating pattern with frequent changes in direction.").otherwise("The forecast shows some fluctuations without a clear consistent pattern.")
    rules = [(F.lit(True), overall), (F.col("h") >= 3, shape), (F.col("top") > F.col("last_value") * 1.2, F.format_string("The forecast reaches a peak value in period %d.", "top_at")),
             (F.col("bottom") < F.col("last_value") * 0.8, F.format_string("The forecast reaches a minimum value in period %d.", "bottom_at"))]
    entries = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("position"), x.alias("text"))) for i, (c, x) in enumerate(rules, 1)]))
    return g.select("series_id", F.explode(entries).alias("_e")).select("series_id", "_e.*")
