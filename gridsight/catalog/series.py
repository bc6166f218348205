"""Queries for time series: monthly mean price per return flag, daily event value, and orders."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import query, table
from ..operators import forecast as fc
from ..operators import series as se
from ..operators.common import round_doubles

# The same grid in SQL: monthly means per flag; months without rows are filled linearly (the data has none).
S = """WITH s AS (SELECT l_returnflag AS series_id, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
  p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM s)"""


def monthly(spark, sf):
    return se.prepare_series(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", ["l_returnflag"], "m")


@query(S + """ SELECT series_id, count(*) AS n, min(ts) AS start, max(ts) AS "end", round(avg(value),3) AS mean, round(stddev_samp(value),3) AS std, round(min(value),3) AS min, round(max(value),3) AS max,
  round(arg_min(value, ts),3) AS first_value, round(arg_max(value, ts),3) AS last_value, round(median(value),3) AS median FROM s GROUP BY 1""")
def m1_analyze_series(spark, sf):
    return round_doubles(se.analyze_series(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", ["l_returnflag"], "m"), 3)


KEYS = "CASE o_orderkey % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a' WHEN 2 THEN 'a/b/c' ELSE NULL END AS k1, CASE o_orderkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'b/c' ELSE NULL END AS k2"


@query(f"""SELECT CASE WHEN k1 = 'a/b' THEN 'a\\/b/c' WHEN k1 = 'a' THEN 'a/b\\/c' WHEN k1 = 'a/b/c' THEN 'a\\/b\\/c/\\N' ELSE '\\N/\\N' END AS series_id, count(DISTINCT date_trunc('year', o_orderdate)) AS n
  FROM (SELECT o_orderdate, {KEYS} FROM orders) GROUP BY 1""")
def m1_series_keys(spark, sf):
    """Keys with separators and nulls stay apart."""
    t = table(spark, sf, "orders").selectExpr("o_orderdate", "o_totalprice", *KEYS.replace(" AS k1,", " AS k1;").split("; "))
    return se.analyze_series(t, "o_orderdate", "o_totalprice", ["k1", "k2"], "y").select("series_id", "n")


@query("SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS n, true AS spike_flagged, true AS spike_is_highest, true AS few FROM orders")
def m2_forest_outliers(spark, sf):
    """One month made a hundred times as high is flagged with the highest score, and few others are flagged."""
    t = table(spark, sf, "orders")
    s = se.prepare_series(t.withColumn("v", F.when(F.date_trunc("month", "o_orderdate") == "1997-06-01", F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice"))), "o_orderdate", "v", (), "m")
    f = se.forest_outliers(s)
    spike = F.col("ts") == "1997-06-01"
    return f.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(spike, F.col("is_outlier"))).alias("spike_flagged"),
                 (F.max(F.when(spike, F.col("anomaly_score"))) == F.max("anomaly_score")).alias("spike_is_highest"), (F.count_if("is_outlier") <= 0.1 * F.count(F.lit(1))).alias("few"))


OUT = S + """, q AS (SELECT series_id, quantile_cont(value,.25) a, quantile_cont(value,.75) b, avg(value) m, stddev_samp(value) sd FROM s GROUP BY 1),
  f AS (SELECT p.*, (value-m)/sd AS z, abs((value-m)/sd) > 3 AS z_outlier, value < a-1.5*(b-a) OR value > b+1.5*(b-a) AS iqr_outlier FROM p JOIN q USING (series_id))"""


@query(OUT + " SELECT series_id, ts, round(value,3) AS value, round(z,3)+0.0 AS z, z_outlier, iqr_outlier, z_outlier OR iqr_outlier AS outlier FROM f")
def m2_series_outliers(spark, sf):
    return round_doubles(se.series_outliers(monthly(spark, sf)), 3)


@query(OUT + """ SELECT series_id, count(*) FILTER (WHERE z_outlier) AS z_outliers, count(*) FILTER (WHERE iqr_outlier) AS iqr_outliers, count(*) AS outliers, round(min(value),3) AS min, round(max(value),3) AS max FROM f WHERE z_outlier OR iqr_outlier GROUP BY 1""")
def m2_outlier_summary(spark, sf):
    return round_doubles(se.outlier_summary(se.series_outliers(monthly(spark, sf))).drop("first_outliers"), 3)


@query(OUT + """ SELECT f.series_id, f.ts, round(CASE WHEN z_outlier OR iqr_outlier THEN (SELECT median(g.value) FROM p g WHERE g.series_id = f.series_id AND g.pos BETWEEN f.pos-3 AND f.pos+3) ELSE f.value END,3) AS value FROM f""")
def m3_repair_outliers(spark, sf):
    return round_doubles(se.repair_outliers(monthly(spark, sf)), 3)


@query()
def m4_adf(spark, sf):
    return round_doubles(fc.adf(monthly(spark, sf)))


@query(S + """, g AS (SELECT series_id, pos // (n // least(5, n//20)) AS part, least(5, n//20) k, var_samp(value) v FROM p GROUP BY 1, 2, 3) SELECT series_id, round(max(v)/min(v),3) AS variance_ratio, max(v)/min(v) < 3 AS homoscedastic FROM g WHERE part < k GROUP BY 1""")
def m5_variance_ratio(spark, sf):
    return round_doubles(se.variance_ratio(monthly(spark, sf)), 3)


def parts(extend):
    line = """, CASE WHEN pos < 6 THEN regr_slope(t, pos) FILTER (WHERE pos >= 6 AND pos < least(18, n-7)) OVER w * pos + regr_intercept(t, pos) FILTER (WHERE pos >= 6 AND pos < least(18, n-7)) OVER w
       ELSE regr_slope(t, pos) FILTER (WHERE pos >= greatest(6, n-19) AND pos < n-7) OVER w * pos + regr_intercept(t, pos) FILTER (WHERE pos >= greatest(6, n-19) AND pos < n-7) OVER w END AS x""" if extend else ", NULL AS x"
    return S + f""", m AS (SELECT *, CASE WHEN pos >= 6 AND pos <= n-7 THEN (sum(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
      - (lag(value,6) OVER (PARTITION BY series_id ORDER BY ts) + lead(value,6) OVER (PARTITION BY series_id ORDER BY ts))/2)/12 END AS t FROM p WHERE n >= 24),
      e AS (SELECT *{line} FROM m WINDOW w AS (PARTITION BY series_id)), f AS (SELECT series_id, ts, pos, n, value, coalesce(t, x) AS trend FROM e),
      k AS (SELECT series_id, pos % 12 AS slot, avg(value - trend) AS a FROM f GROUP BY 1, 2), c AS (SELECT series_id, slot, a - avg(a) OVER (PARTITION BY series_id) AS seasonal FROM k),
      d AS (SELECT f.series_id, ts, pos, value, trend, seasonal, value - trend - seasonal AS residual FROM f JOIN c ON f.series_id = c.series_id AND f.pos % 12 = c.slot)"""


@query(parts(True) + " SELECT series_id, ts, CAST(pos AS INTEGER) AS pos, round(value,3) AS value, round(trend,3) AS trend, round(seasonal,3)+0.0 AS seasonal, round(residual,3)+0.0 AS residual FROM d")
def m6_decompose(spark, sf):
    return round_doubles(se.decompose(monthly(spark, sf), 12), 3)


SUMMARY = """, g AS (SELECT series_id, greatest(0, 1-var_pop(residual)/var_pop(value-trend)) ss, greatest(0, 1-var_pop(residual)/var_pop(value)) ts, corr(trend,pos) c, regr_slope(trend,pos) k, count(*) n FROM d GROUP BY 1),
  u AS (SELECT *, CASE WHEN abs(c) > .5 AND abs(c)*sqrt((n-2)/(1-c*c)) > 2 THEN CASE WHEN k > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'no significant direction' END AS dir FROM g)"""


@query(parts(True) + SUMMARY + " SELECT series_id, round(ss,4) AS seasonality_strength, round(ts,4) AS trend_strength, ss > .3 AS has_seasonality, ts > .3 AS has_trend, dir AS trend_direction FROM u")
def m6_decomposition_summary(spark, sf):
    return round_doubles(se.decomposition_summary(se.decompose(monthly(spark, sf), 12)))


@query(parts(False) + " SELECT series_id, round(avg(abs(seasonal))/(avg(abs(trend))+avg(abs(seasonal))+avg(abs(residual))),5) AS seasonal_strength, avg(abs(seasonal))/(avg(abs(trend))+avg(abs(seasonal))+avg(abs(residual))) > .3 AS significant FROM d GROUP BY 1")
def m7_seasonal_strength(spark, sf):
    return round_doubles(se.seasonal_strength(monthly(spark, sf)), 5)


ACF = S + """, d AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id) AS x FROM p), v AS (SELECT series_id, sum(x*x) c0 FROM d GROUP BY 1),
  r AS (SELECT a.series_id, l.lag, any_value(a.n) n, coalesce(sum(a.x*b.x),0)/any_value(c0) AS r FROM d a JOIN v ON a.series_id = v.series_id CROSS JOIN (SELECT unnest(range(41)) AS lag) l LEFT JOIN d b ON b.series_id = a.series_id AND b.pos = a.pos - l.lag WHERE l.lag <= a.n//4 GROUP BY 1, 2)"""


@query(ACF + ' SELECT series_id, CAST(lag AS INTEGER) AS lag, round(r,4)+0.0 AS acf, round(1.96/sqrt(n),4) AS "limit", lag > 0 AND abs(r) > 1.96/sqrt(n) AS significant FROM r')
def m8_acf(spark, sf):
    return round_doubles(se.acf(monthly(spark, sf)))


@query()
def m9_pacf(spark, sf):
    return round_doubles(se.pacf(se.acf(monthly(spark, sf))))


@query(ACF + """, w AS (SELECT series_id, max(r) FILTER (WHERE lag = 1) a, max(r) FILTER (WHERE lag = 2) b FROM r GROUP BY 1)
  SELECT series_id, unnest([0, 1, 2]) AS lag, round(unnest([1.0, a, (b - a*a)/(1 - a*a)]), 4) + 0.0 AS pacf FROM w""")
def m9_pacf_first_lags(spark, sf):
    return round_doubles(se.pacf(se.acf(monthly(spark, sf))).filter("lag <= 2").select("series_id", "lag", "pacf"))


def planted_months(spark, sf, value):
    """A monthly series of known shape over the months of lineitem."""
    month = F.months_between(F.date_trunc("month", "l_shipdate"), F.lit("1995-01-01"))
    return se.prepare_series(table(spark, sf, "lineitem").withColumn("planted", value(F.round(month), F.col("l_shipdate"))), "l_shipdate", "planted", (), "m")


@query("SELECT 'planted' AS series_id, TIMESTAMP '1998-07-01' AS ts, true AS near_100")
def m11_change_point_of_a_step(spark, sf):
    s = planted_months(spark, sf, lambda m, d: F.when(d >= "1998-07-01", 100.0).otherwise(0.0) + m % 2)
    top = se.change_points(s).orderBy(F.desc("magnitude")).limit(1)
    return top.select("series_id", "ts", F.col("magnitude").between(95, 105).alias("near_100"))


@query("SELECT 'planted' AS series_id, 1 AS rank, true AS near_12")
def m13_period_of_a_sine(spark, sf):
    s = planted_months(spark, sf, lambda m, d: 10 * F.sin(2 * 3.141592653589793 * m / 12))
    return se.periodicity(s).filter("rank = 1").select("series_id", "rank", F.col("period").between(11, 13).alias("near_12"))


@query("SELECT 'planted' AS series_id, false AS stationary")
def m4_adf_of_a_curve(spark, sf):
    """A value that accelerates has a unit root at least."""
    return fc.adf(planted_months(spark, sf, lambda m, d: m * m)).select("series_id", "stationary")


@query()
def m10_order_hint(spark, sf):
    a = se.acf(monthly(spark, sf))
    return se.order_hint(a, se.pacf(a))


@query(ACF + """, c AS (SELECT series_id, coalesce(min(lag) FILTER (WHERE lag > 0 AND abs(r) <= 1.96/sqrt(n)), max(lag) + 1) AS a FROM r GROUP BY 1),
  h AS (SELECT series_id, coalesce(min(lag) FILTER (WHERE lag > 0 AND abs(r*r) <= 1.96/sqrt(n)), max(lag) + 1) AS p FROM r GROUP BY 1),
  o AS (SELECT *, (a > 5 AND p > 5) OR (a <= 5 AND p <= 5) AS same FROM c JOIN h USING (series_id)),
  k AS (SELECT *, CASE WHEN same THEN least(2, p) WHEN p <= 5 THEN p ELSE 0 END AS ar, CASE WHEN same THEN least(2, a) WHEN a <= 5 THEN a ELSE 0 END AS ma FROM o)
  SELECT series_id, CAST(a AS INTEGER) AS acf_cut, CAST(p AS INTEGER) AS pacf_cut, CAST(CASE WHEN ar = 0 AND ma = 0 THEN 1 ELSE ar END AS INTEGER) AS ar_order, CAST(ma AS INTEGER) AS ma_order FROM k""")
def m10_order_hint_of_squares(spark, sf):
    """The rule by itself: squared autocorrelations stand for the partial ones."""
    a = se.acf(monthly(spark, sf))
    return se.order_hint(a, a.select("series_id", "lag", (F.col("acf") * F.col("acf")).alias("pacf"), "limit"))


@query()
def m11_change_points(spark, sf):
    return round_doubles(se.change_points(monthly(spark, sf)))


ZSCORES = S + """, w AS (SELECT *, greatest(2, least(10, n//5)) AS w FROM p), z AS (SELECT a.series_id, a.pos, a.ts, a.value, a.w, abs(a.value - (SELECT avg(b.value) FROM w b WHERE b.series_id=a.series_id AND b.pos BETWEEN a.pos-a.w+1 AND a.pos))
    / (SELECT stddev_samp(b.value) FROM w b WHERE b.series_id=a.series_id AND b.pos BETWEEN a.pos-a.w+1 AND a.pos) AS z FROM w a WHERE a.pos >= a.w)
  SELECT series_id, CAST(pos AS INTEGER) AS pos, ts, round(value,3) AS value, round(z,3) AS z_score FROM z a WHERE z > {threshold} AND NOT EXISTS (SELECT 1 FROM z b WHERE b.series_id=a.series_id AND abs(b.pos-a.pos) < a.w AND b.z > a.z)
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY z DESC, pos) <= 5"""


@query(ZSCORES.replace("{threshold}", "3"))
def m12_zscore_change_points(spark, sf):
    return round_doubles(se.zscore_change_points(monthly(spark, sf)), 3)


@query(ZSCORES.replace("{threshold}", "2"))
def m12_zscore_change_points_above_2(spark, sf):
    """A window of ten values can't reach 3 (its largest trailing score is 2.85), but it can reach 2."""
    return round_doubles(se.zscore_change_points(monthly(spark, sf), threshold=2.0), 3)


@query()
def m13_periodicity(spark, sf):
    return round_doubles(se.periodicity(monthly(spark, sf)))


@query()
def m14_arima_orders(spark, sf):
    return fc.arima_orders(monthly(spark, sf))


@query()
def m15_forecast_arima(spark, sf):
    s = monthly(spark, sf)
    return round_doubles(fc.forecast_arima(s, fc.arima_orders(s), 6))


# An autoregression of order 1 around zero: with A, B and C below, the estimate solves n (B - C f)(1 - f^2) = f (A - 2 B f + C f^2).
AR1 = S + """, d AS (SELECT series_id, pos, n, sum(value - m) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS y
    FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM p)),
  l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS before FROM d),
  k AS (SELECT series_id, any_value(n) AS n, sum(y*y) AS a, sum(y*before) AS b, sum(y*y) FILTER (WHERE pos > 0 AND pos < n - 1) AS c FROM l GROUP BY 1)"""


@query("WITH RECURSIVE " + AR1[5:] + """, r AS (SELECT series_id, 0 AS i, -1.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM k
    UNION ALL SELECT series_id, i + 1, CASE WHEN up THEN f ELSE lo END, CASE WHEN up THEN hi ELSE f END
    FROM (SELECT r.series_id, i, lo, hi, (lo+hi)/2 AS f, n*(b - c*f)*(1 - f*f) > f*(a - 2*b*f + c*f*f) AS up FROM r JOIN k USING (series_id) WHERE i < 60)),
  f AS (SELECT series_id, lo AS f FROM r WHERE i = 60), v AS (SELECT *, (a - 2*b*f + c*f*f)/n AS v FROM k JOIN f USING (series_id))
  SELECT series_id, n, round(f, 3) + 0.0 AS ar, round(v/1e6, 2) AS variance, round(-n/2.0*(ln(2*pi()*v) + 1) + 0.5*ln(1 - f*f), 3) AS loglik FROM v""")
def m15_ar1_likelihood(spark, sf):
    """Four-month sums of the deviations from the mean, as an autoregression of order 1."""
    each = Window.partitionBy("series_id")
    s = monthly(spark, sf).withColumn("value", F.col("value") - F.avg("value").over(each))
    s = s.withColumn("value", F.sum("value").over(each.orderBy("ts").rowsBetween(-3, 0)))
    found = fc.likelihood(s)
    return found.select("series_id", "n", (F.round(F.col("ar")[0], 3) + 0.0).alias("ar"), F.round(F.col("variance") / 1e6, 2).alias("variance"), F.round("loglik", 3).alias("loglik"))


@query()
def m16_forecast_with_exogenous(spark, sf):
    return round_doubles(fc.forecast(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", ["l_returnflag"], 6, ["l_quantity"], "m"))


@query()
def m17_rolling_validation(spark, sf):
    s = monthly(spark, sf)
    return round_doubles(fc.rolling_validation(s, fc.arima_orders(s)))


@query("""WITH s AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts FROM events GROUP BY 1, 2), g AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM s GROUP BY 1)
  SELECT series_id, i::INTEGER AS step, last + to_hours(i) AS ts FROM (SELECT series_id, max(ts) AS last FROM g GROUP BY 1), (SELECT unnest(range(1, 6)) AS i)""")
def m18_future_index(spark, sf):
    return fc.future_index(se.prepare_series(table(spark, sf, "events"), "ts", "value", ["event_type"], "h"), 5)


@query()
def m19_forecast_insights(spark, sf):
    s = monthly(spark, sf)
    return fc.forecast_insights(fc.forecast_arima(s, fc.arima_orders(s), 6), se.series_info(s).select("series_id", "last_value"))


# The first twelve months stand for a forecast made after the thirteenth.
KNOWN = S + """, f AS (SELECT series_id, CAST(pos + 1 AS INTEGER) AS step, ts, value AS forecast, value - 10 AS lower, value + 10 AS upper FROM p WHERE pos < 12)"""


def known_forecast(spark, sf):
    p = se.positions(monthly(spark, sf)).filter("pos < 13")
    f = p.filter("pos < 12").select("series_id", (F.col("pos") + 1).cast("int").alias("step"), "ts", F.col("value").alias("forecast"), (F.col("value") - 10).alias("lower"), (F.col("value") + 10).alias("upper"))
    return f, p.filter("pos = 12").select("series_id", F.col("value").alias("last_value"))


@query(KNOWN + """, l AS (SELECT series_id, value AS last FROM p WHERE pos = 12), d AS (SELECT *, sign(forecast - lag(forecast) OVER x) AS sg FROM f WINDOW x AS (PARTITION BY series_id ORDER BY step)),
  t AS (SELECT *, (sg <> lag(sg) OVER (PARTITION BY series_id ORDER BY step))::INT AS turn FROM d),
  g AS (SELECT t.series_id, any_value(last) AS last, count(*) AS h, arg_max(forecast, step) AS final, min(sg) AS lo, max(sg) AS hi, sum(turn) AS turns, max(forecast) AS top, min(forecast) AS bottom, arg_max(step, forecast) AS top_at, arg_min(step, forecast) AS bottom_at
    FROM t JOIN l USING (series_id) GROUP BY 1)
  SELECT series_id, 1 AS position, printf('The forecast predicts an overall %s trend of %.1f%% over the next %d periods.', CASE WHEN final > last THEN 'increasing' ELSE 'decreasing' END, abs((final/last - 1)*100), h) AS text FROM g
  UNION ALL SELECT series_id, 2, CASE WHEN lo > 0 THEN 'The forecast shows a consistent increasing pattern.' WHEN hi < 0 THEN 'The forecast shows a consistent decreasing pattern.' WHEN turns >= h // 2 THEN 'The forecast shows a fluctuating pattern with frequent changes in direction.'
    ELSE 'The forecast shows some fluctuations without a clear consistent pattern.' END FROM g
  UNION ALL SELECT series_id, 3, printf('The forecast reaches a peak value in period %d.', top_at) FROM g WHERE top > last*1.2 UNION ALL SELECT series_id, 4, printf('The forecast reaches a minimum value in period %d.', bottom_at) FROM g WHERE bottom < last*0.8""")
def m19_insights_of_known_forecasts(spark, sf):
    return fc.forecast_insights(*known_forecast(spark, sf))


@query(KNOWN + " SELECT series_id, step, ts, round(forecast,3) AS forecast, round(lower,3) AS lower, round(upper,3) AS upper FROM f")
def v29_line_of_known_forecasts(spark, sf):
    from ..operators.charts import forecast_line
    return round_doubles(forecast_line(known_forecast(spark, sf)[0]), 3)


EVIDENCE = {
    "series_id": "n_name", "stationary": "CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 3 = 1 END", "homoscedastic": "n_nationkey % 5 > 1", "has_seasonality": "n_nationkey % 2 = 0", "has_trend": "n_nationkey % 7 > 2",
    "trend_direction": "CASE n_nationkey % 3 WHEN 0 THEN 'increasing' WHEN 1 THEN 'decreasing' ELSE 'no significant direction' END", "change_points": "n_nationkey % 4", "cycles": "n_nationkey % 3", "z_outliers": "n_nationkey % 6"}
ADVICE = [
    ("NOT stationary", "Apply differencing to make the time series stationary before modeling."), ("NOT stationary AND NOT homoscedastic", "Consider applying log or Box-Cox transformation to stabilize variance."),
    ("has_seasonality", "Use seasonal models (like SARIMA) to capture the seasonal patterns in the data."), ("has_trend AND trend_direction = 'increasing'", "The series shows an increasing trend. Use models that can capture this movement."),
    ("has_trend AND trend_direction = 'decreasing'", "The series shows a decreasing trend. Use models that can capture this movement."), ("has_seasonality", "SARIMA is recommended for this time series due to its seasonal patterns."),
    ("NOT has_seasonality AND has_trend", "ARIMA with appropriate differencing is suitable for capturing the trend in this time series."),
    ("NOT has_seasonality AND NOT has_trend", "Simple forecasting methods like ARIMA or exponential smoothing may be sufficient for this time series."),
    ("change_points > 0", "The time series contains structural changes. Consider using piecewise models or including regime variables."), ("cycles > 0", "The detected periodicity should be incorporated into the modeling approach, possibly using Fourier terms."),
    ("z_outliers > 0", "Consider treating outliers before modeling to improve forecast accuracy."), ("true", "If available, include relevant external variables to improve forecast accuracy."),
    ("true", "Use time series cross-validation techniques to evaluate model performance more reliably.")]


@query("WITH e AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in EVIDENCE.items()) + " FROM nation) " + " UNION ALL ".join(f"SELECT series_id, {i - (i > 4)} AS position, '{t}' AS text FROM e WHERE {c}" for i, (c, t) in enumerate(ADVICE, 1)))
def m20_recommendations_of_known_evidence(spark, sf):
    """Every rule fires for some nation and is silent for another."""
    return se.series_recommendations(table(spark, sf, "nation").select(*[F.expr(e).alias(c) for c, e in EVIDENCE.items()]))


@query()
def m20_series_recommendations(spark, sf):
    return se.series_recommendations(se.series_evidence(monthly(spark, sf), 12))


@query(parts(True) + SUMMARY + """ SELECT series_id, concat('The time series ', CASE WHEN ts <= .3 THEN 'does not show a significant trend' WHEN dir IN ('increasing','decreasing') THEN concat(CASE dir WHEN 'increasing' THEN 'shows an increasing' ELSE 'shows a decreasing' END, printf(' trend (strength: %.2f)', ts))
   ELSE printf('has a trend component (strength: %.2f) without clear direction', ts) END, CASE WHEN ss > .3 THEN printf(' and exhibits seasonality (strength: %.2f)', ss) ELSE ' and does not show significant seasonality' END, '. This suggests ',
   CASE WHEN ts > .3 AND ss > .3 THEN 'both long-term directional movement and regular cyclical patterns' WHEN ts > .3 THEN 'long-term directional movement but no regular cycles' WHEN ss > .3 THEN 'regular cycles around a stable mean' ELSE 'a relatively stable series without strong patterns' END, '.') AS text FROM u""")
def m21_decomposition_text(spark, sf):
    return se.decomposition_text(se.decomposition_summary(se.decompose(monthly(spark, sf), 12)))


@query()
def m22_analyze_all_series(spark, sf):
    from ..operators.roles import infer_roles
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return round_doubles(se.analyze_all_series(t, infer_roles(t)))


@query()
def v29_forecast_line(spark, sf):
    from ..operators.charts import forecast_line
    s = monthly(spark, sf)
    return round_doubles(forecast_line(fc.forecast_arima(s, fc.arima_orders(s), 6)))
