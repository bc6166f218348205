"""Queries for ordered analytics. Small blocks are used so that block edges are exercised."""
from pyspark.sql import functions as F

from . import query, table
from .profiles import gap_sql
from ..operators import ordered as o
from ..operators.common import round_doubles


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value")


def rolled(fn, window, back, ahead, by="PARTITION BY user_id"):
    w = f"({by} ORDER BY ts, event_id ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    return f"SELECT event_id, CASE WHEN count(value) OVER {w} = {window} THEN round({fn}(value) OVER {w},4) END AS r FROM events"


@query(rolled("avg", 7, 3, 3))
def o1_rolling_mean(spark, sf):
    out = o.rolling(events(spark, sf), ["value"], ["ts", "event_id"], 7, ["user_id"], center=True)
    return round_doubles(out.select("event_id", F.col("value_rolling_mean").alias("r")))


@query(rolled("stddev_samp", 5, 4, 0, ""))
def o1_rolling_std_unkeyed(spark, sf):
    out = o.rolling(events(spark, sf), ["value"], ["ts", "event_id"], 5, fn="std")
    return round_doubles(out.select("event_id", F.col("value_rolling_std").alias("r")))


@query(rolled("median", 5, 2, 2))
def o1_rolling_median(spark, sf):
    out = o.rolling(events(spark, sf), ["value"], ["ts", "event_id"], 5, ["user_id"], "median", True)
    return round_doubles(out.select("event_id", F.col("value_rolling_median").alias("r")))


EWMA = """WITH RECURSIVE e AS (SELECT event_id, value, {by} AS k, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT event_id, k, i, value AS y FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.k, e.i, 0.1*e.value + 0.9*r.y FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)
  SELECT event_id, round(y,3) AS y FROM r"""


@query(EWMA.format(by="user_id"))
def o2_ewma(spark, sf):
    return round_doubles(o.ewma(events(spark, sf), "value", ["ts", "event_id"], ["user_id"], name="y", block=50).select("event_id", "y"), 3)


@query()
def o2_ewma_unkeyed(spark, sf):
    return round_doubles(o.ewma(events(spark, sf), "value", ["ts", "event_id"], name="y", block=1000).select("event_id", "y"))


HALF = """WITH e AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)"""


@query(HALF + """, h AS (SELECT avg(value) FILTER (WHERE i < n//2) a, avg(value) FILTER (WHERE i >= n//2) b FROM e)
  SELECT round(a,4) AS first_mean, round(b,4) AS second_mean, round((b-a)/abs(a)*100,4) AS change_percent, CASE WHEN (b-a)/abs(a) > .05 THEN 'increasing' WHEN (b-a)/abs(a) < -.05 THEN 'decreasing' ELSE 'stable' END AS direction FROM h""")
def o3_half_trend(spark, sf):
    return round_doubles(o.half_trend(events(spark, sf), "ts", "value", "event_id"))


@query(HALF + """, h AS (SELECT avg(value) FILTER (WHERE i < n//4) a, avg(value) FILTER (WHERE i >= n - n//4) b FROM e)
  SELECT round(a,4) AS first_mean, round(b,4) AS last_mean, round((b-a)/abs(a)*100,4) AS change_percent, abs((b-a)/a) > .2 AS changed FROM h""")
def o4_quarter_change(spark, sf):
    return round_doubles(o.quarter_change(events(spark, sf), "ts", "value", "event_id"))


@query(f"SELECT ts, round(g,6) AS gap_seconds FROM {gap_sql('ts', 'events')} WHERE g IS NOT NULL")
def o5_gaps(spark, sf):
    return round_doubles(o.gaps(events(spark, sf), "ts"), 6)


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
  h AS (SELECT event_type, avg(value) FILTER (WHERE i < n//4) a, avg(value) FILTER (WHERE i >= n - n//4) b FROM e GROUP BY 1)
  SELECT event_type, round(a,4) AS first_mean, round(b,4) AS last_mean, round((b-a)/abs(a)*100,4) AS change_percent, (SELECT max((b-a)/a) > .2 AND min((b-a)/a) < -.2 FROM h) AS diverging FROM h""")
def o6_group_quarter_change(spark, sf):
    return round_doubles(o.group_quarter_change(table(spark, sf, "events"), "ts", "value", "event_type", "event_id"))


@query("""SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS position, s_name AS name, round(sum(s_acctbal) OVER (ORDER BY s_suppkey) - s_acctbal, 2) AS start, round(sum(s_acctbal) OVER (ORDER BY s_suppkey), 2) AS "end", s_acctbal AS value FROM supplier
  UNION ALL SELECT count(*), 'Total', 0, round(sum(s_acctbal),2), round(sum(s_acctbal),2) FROM supplier""")
def o7_waterfall(spark, sf):
    return round_doubles(o.waterfall(table(spark, sf, "supplier"), "s_name", "s_acctbal", "s_suppkey"), 2)


@query("SELECT value, n, round(sum(n) OVER (ORDER BY value)/sum(n) OVER (),6) AS share FROM (SELECT l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY 1)")
def o8_ecdf(spark, sf):
    return round_doubles(o.ecdf(table(spark, sf, "lineitem"), "l_extendedprice"), 6)


@query("SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1)/2.0 AS DOUBLE) AS o_custkey_rank, CAST(rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1)/2.0 AS DOUBLE) AS o_totalprice_rank FROM orders")
def o9_average_ranks(spark, sf):
    from ..operators.statistics import average_ranks
    return average_ranks(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_totalprice"]).select("o_orderkey", "o_custkey_rank", "o_totalprice_rank")


@query("""WITH e AS (SELECT value, ntile(4) OVER (ORDER BY ts, event_id) AS q FROM events), g AS (SELECT q, avg(value) m, count(*) n FROM e GROUP BY 1),
  l AS (SELECT *, (m - lag(m) OVER (ORDER BY q))/abs(lag(m) OVER (ORDER BY q))*100 AS c FROM g)
  SELECT CAST(q AS INTEGER) AS quarter, round(m,4) AS mean, n, round(c,4) AS change_percent, CASE WHEN c > 10 THEN 'up' WHEN c < -10 THEN 'down' ELSE 'flat' END AS direction FROM l""")
def o10_quartile_means(spark, sf):
    return round_doubles(o.quartile_means(events(spark, sf), "ts", "value", "event_id"))


HOURLY = "(SELECT date_trunc('hour', ts) AS ts, avg(value) AS value, count(value) AS n FROM events WHERE {where} GROUP BY 1)"


@query(f"""WITH h AS {HOURLY.format(where="event_type = 'error'")}, g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h),
  j AS (SELECT g.ts, value, row_number() OVER (ORDER BY g.ts) AS i FROM g LEFT JOIN h USING (ts)),
  k AS (SELECT *, last_value(value IGNORE NULLS) OVER w1 AS a, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER w1 AS ia, first_value(value IGNORE NULLS) OVER w2 AS b, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER w2 AS ib
    FROM j WINDOW w1 AS (ORDER BY i ROWS UNBOUNDED PRECEDING), w2 AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT ts, round(CASE WHEN ib = ia THEN value ELSE a + (b-a)*(i-ia)/(ib-ia) END,6) AS value FROM k""")
def o11_interpolate(spark, sf):
    h = o.resample(table(spark, sf, "events").filter("event_type = 'error'"), "ts", "value", "h")
    return round_doubles(o.interpolate(h.select("ts", "value"), "ts", "value"), 6)


@query("""WITH m AS (SELECT l_returnflag, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, avg(l_extendedprice) v, count(*) n FROM lineitem GROUP BY 1, 2),
  g AS (SELECT l_returnflag, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH)) AS ts FROM m GROUP BY 1)
  SELECT g.l_returnflag, g.ts, round(v,4) AS value, coalesce(n,0) AS n FROM g LEFT JOIN m ON g.l_returnflag = m.l_returnflag AND g.ts = m.ts""")
def o12_resample(spark, sf):
    return round_doubles(o.resample(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice", "m", ["l_returnflag"]))


@query("""WITH g AS (SELECT user_id, (epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts))/1e6 AS s FROM events), m AS (SELECT user_id, median(s) AS s FROM g GROUP BY 1 HAVING median(s) IS NOT NULL)
  SELECT user_id, round(s,4) AS median_gap, CASE WHEN s <= 3600 THEN 'h' WHEN s < 86400 THEN 'd' WHEN floor(s/86400) BETWEEN 1 AND 7 THEN 'w' WHEN floor(s/86400) BETWEEN 28 AND 31 THEN 'm' ELSE 'd' END AS freq FROM m""")
def o13_choose_frequency(spark, sf):
    return round_doubles(o.choose_frequency(events(spark, sf), "ts", ["user_id"]))


@query("SELECT round((epoch_us(max(ts))-epoch_us(min(ts)))/86400e6,4) AS range_days, CASE WHEN (epoch_us(max(ts))-epoch_us(min(ts)))/86400e6 < 30 THEN 'daily' ELSE 'weekly' END AS granularity FROM events")
def o14_display_granularity(spark, sf):
    return round_doubles(o.display_granularity(table(spark, sf, "events"), "ts"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def with_row_index(spark, sf):
    return o.with_row_index(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "row_index")
