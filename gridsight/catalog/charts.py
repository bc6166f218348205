"""Queries for chart datasets."""
from pyspark.sql import functions as F

from . import query, table
from .profiles import RANGED, with_range
from .relational import HASH, LINKS, links
from .text import TOKENS, listed
from ..functions import wording
from ..operators import charts as ch
from ..operators.common import round_doubles

rows = lambda spark, sf, name: table(spark, sf, name)


def bins_sql(value, source, k):
    return f"""s AS (SELECT min(v) lo, max(v) hi FROM (SELECT {value} AS v FROM {source})), g AS (SELECT unnest(range({k}))::INTEGER AS bin),
   c AS (SELECT least(floor((v-lo)*{k}/(hi-lo)), {k}-1)::INTEGER AS bin, count(*) n FROM (SELECT {value} AS v FROM {source}), s GROUP BY 1),
   b AS (SELECT g.bin, lo+g.bin*((hi-lo)/{k}) AS a, lo+(g.bin+1)*((hi-lo)/{k}) AS z, coalesce(n,0) AS n FROM g CROSS JOIN s LEFT JOIN c USING (bin)),
   p AS (SELECT *, coalesce(n > lag(n) OVER (ORDER BY bin) AND n > lead(n) OVER (ORDER BY bin), false) AS peak FROM b),
   m AS (SELECT skewness(v) sk, kurtosis(v) ku FROM (SELECT {value} AS v FROM {source}))"""


HIST = """SELECT bin, printf('%.2f - %.2f', a, z) AS label, round((a+z)/2,4) AS midpoint, n, peak, (SELECT count(*) FILTER (WHERE peak) > 1 FROM p) AS multimodal,
   concat(CASE WHEN abs(sk) <= 1 THEN 'normal' WHEN sk > 0 THEN 'right-skewed' ELSE 'left-skewed' END, CASE WHEN abs(ku) <= 1 THEN '' WHEN ku > 0 THEN ' heavy-tailed' ELSE ' light-tailed' END) AS shape FROM p, m"""


@query("WITH " + bins_sql("value", "events", 15) + HIST)
def v1_histogram(spark, sf):
    return round_doubles(ch.histogram(rows(spark, sf, "events"), "value"))


def bars_sql(c, source, n):
    return f"""WITH k AS (SELECT {c} AS v, count(*) n, row_number() OVER (ORDER BY count(*) DESC, {c}) i FROM {source} WHERE {c} IS NOT NULL GROUP BY 1),
   o AS (SELECT CASE WHEN i <= {n - 1} OR (SELECT count(*) FROM k) <= {n} THEN v ELSE 'Others' END AS value, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1), p AS (SELECT *, n/sum(n) OVER () AS p FROM o)
   SELECT value, n, round(100*p,4) AS percent, round((SELECT -sum(p*log2(p)) FROM p),4) AS entropy, round((SELECT -sum(p*log2(p))/log2(count(*)) FROM p),4) AS balance FROM p"""


@query(bars_sql("p_brand", "part", 12))
def v2_category_bars(spark, sf):
    return round_doubles(ch.category_bars(rows(spark, sf, "part"), "p_brand"))


@query(bars_sql("p_type", "part", 8))
def v3_pie(spark, sf):
    return round_doubles(ch.pie(rows(spark, sf, "part"), "p_type"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) AS value FROM orders GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY ts)-1 AS i, count(*) OVER () AS n FROM m),
   t AS (SELECT (avg(value) FILTER (WHERE i >= n//2) - avg(value) FILTER (WHERE i < n//2))/avg(value) FILTER (WHERE i < n//2)*100 AS c FROM i)
   SELECT ts, round(value,4) AS value, 'monthly' AS granularity, CASE WHEN c > 10 THEN 'increasing' WHEN c < -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM m, t""")
def v4_time_line(spark, sf):
    return round_doubles(ch.time_line(rows(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


HEAT = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a},{b}),2)+0.0 AS value FROM lineitem" for a in HEAT for b in HEAT))
def v5_correlation_heatmap(spark, sf):
    return round_doubles(ch.correlation_heatmap(rows(spark, sf, "lineitem"), HEAT))


RHO = lambda t, a, b: f"(SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a})-1)/2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b})-1)/2.0 AS rb FROM {t}))"


@query(f"""SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, round((SELECT corr(o_custkey, o_totalprice) FROM orders),4) AS r, round({RHO('orders', 'o_custkey', 'o_totalprice')},4) AS rho, 'linear' AS relationship
   FROM orders ORDER BY {HASH('o_orderkey')} LIMIT 2000""")
def v6_scatter(spark, sf):
    return round_doubles(ch.scatter(rows(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 2000))


@query("""WITH g AS (SELECT p_brand, avg(p_retailprice) m, stddev_samp(p_retailprice) s, median(p_retailprice) d, count(*) n, var_samp(p_retailprice) v FROM part GROUP BY 1),
   a AS (SELECT (sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n))/(count(*)-1) / (sum((n-1)*v)/(sum(n)-count(*))) AS f FROM g), t AS (SELECT * FROM g ORDER BY m DESC, p_brand LIMIT 10)
   SELECT p_brand, round(m,4) AS mean, round(s,4) AS std, round(d,4) AS median, n AS count, round(f,4) AS f_statistic, f > 1.53 AS significant, round((SELECT 100*(max(m)-min(m))/avg(m) FROM t),4) AS magnitude_percent FROM t, a""")
def v7_group_means(spark, sf):
    return round_doubles(ch.group_means(rows(spark, sf, "part"), "p_brand", "p_retailprice"))


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice*100 ELSE o_totalprice END AS v FROM orders), q AS (SELECT quantile_cont(v,.25) a, quantile_cont(v,.5) m, quantile_cont(v,.75) b FROM t)
   SELECT 'box' AS kind, 'lower_whisker' AS name, round(min(v),2) AS value FROM t, q WHERE v >= a-1.5*(b-a) UNION ALL SELECT 'box','q1',round(a,2) FROM q UNION ALL SELECT 'box','median',round(m,2) FROM q UNION ALL SELECT 'box','q3',round(b,2) FROM q
   UNION ALL SELECT 'box','upper_whisker',round(max(v),2) FROM t, q WHERE v <= b+1.5*(b-a) UNION ALL (SELECT 'outlier','high',round(v,2) FROM t, q WHERE v > b+1.5*(b-a) ORDER BY v DESC LIMIT 50) UNION ALL (SELECT 'outlier','low',round(v,2) FROM t, q WHERE v < a-1.5*(b-a) ORDER BY v LIMIT 50)""")
def v8_box_plot(spark, sf):
    t = rows(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice")).alias("v"))
    return round_doubles(ch.box_plot(t, "v"), 2)


@query("""WITH s AS (SELECT min(l_quantity) lo, max(l_quantity) hi FROM lineitem), c AS (SELECT l_returnflag, least(floor((l_quantity-lo)*10/(hi-lo)),9)::INTEGER bin, count(*) n FROM lineitem, s GROUP BY 1,2), t AS (SELECT l_returnflag, sum(n) t FROM c GROUP BY 1),
   m AS (SELECT l_returnflag g, count(*) n, avg(l_quantity) m, var_samp(l_quantity) v FROM lineitem GROUP BY 1), a AS (SELECT (sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n))/(count(*)-1) / (sum((n-1)*v)/(sum(n)-count(*))) AS f FROM m)
   SELECT t.l_returnflag AS category, b AS bin, printf('%.2f - %.2f', lo+b*((hi-lo)/10), lo+(b+1)*((hi-lo)/10)) AS label, round(100.0*coalesce(n,0)/t,4) AS percent, 'ANOVA' AS test, f > 2.996 AS significant
   FROM t CROSS JOIN (SELECT unnest(range(10))::INTEGER b) CROSS JOIN s CROSS JOIN a LEFT JOIN c ON c.l_returnflag = t.l_returnflag AND c.bin = b""")
def v9_grouped_histogram(spark, sf):
    return round_doubles(ch.grouped_histogram(rows(spark, sf, "lineitem"), "l_returnflag", "l_quantity"))


@query("""SELECT CAST(l_linenumber AS DOUBLE) AS value, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM lineitem),4) AS percent, round((SELECT avg(l_linenumber) FROM lineitem),4) AS mean, CAST((SELECT median(l_linenumber) FROM lineitem) AS DOUBLE) AS median FROM lineitem GROUP BY 1""")
def v10_likert_bars(spark, sf):
    return round_doubles(ch.likert_bars(rows(spark, sf, "lineitem"), "l_linenumber"))


@query("""SELECT CAST(toxic AS VARCHAR) AS value, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM labels),4) AS percent, (SELECT CAST(toxic AS VARCHAR) FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM labels GROUP BY 1""")
def v11_binary_bars(spark, sf):
    return round_doubles(ch.binary_bars(rows(spark, sf, "labels"), "toxic"))


@query(f"SELECT word AS text, count(*) AS value FROM {TOKENS} WHERE length(word) > 1 AND word NOT IN ({listed(wording.CLOUD_STOP_WORDS)}) GROUP BY 1 ORDER BY value DESC, text LIMIT 100")
def v12_word_cloud(spark, sf):
    return ch.word_cloud_data(rows(spark, sf, "documents"), "text")


@query("WITH " + bins_sql("length(text)", "documents", 15) + HIST)
def v13_text_length_histogram(spark, sf):
    return round_doubles(ch.text_length_histogram(rows(spark, sf, "documents"), "text"))


@query(bars_sql("span", RANGED, 12))
def v14_range_bars(spark, sf):
    return round_doubles(ch.range_bars(with_range(spark, sf), "span"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({x},{y}),2)+0.0 AS value FROM lineitem" for a, x in (("q1", "l_linenumber"), ("q2", "l_orderkey % 5 + 1")) for b, y in (("q1", "l_linenumber"), ("q2", "l_orderkey % 5 + 1"))))
def v15_likert_heatmap(spark, sf):
    return round_doubles(ch.likert_heatmap(rows(spark, sf, "lineitem").select(F.col("l_linenumber").alias("q1"), (F.col("l_orderkey") % 5 + 1).alias("q2")), ["q1", "q2"]))


@query("SELECT o_orderpriority AS x, o_orderstatus AS y, count(*) AS value FROM orders GROUP BY 1, 2")
def v16_category_heatmap(spark, sf):
    return ch.category_heatmap(rows(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query()
def v17_automatic_charts(spark, sf):
    return ch.chart_sizes(ch.automatic_charts(rows(spark, sf, "orders"), "o_orderkey"))


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def v18_chart(spark, sf):
    return ch.chart(rows(spark, sf, "orders"), "bar", ["o_orderstatus"]).select("value", "n")


BOX = "(SELECT min(o_custkey) x0, max(o_custkey) x1, min(o_totalprice) y0, max(o_totalprice) y1, count(*) n FROM orders)"


@query(f"""WITH g AS (SELECT floor((o_custkey-x0)/((x1-x0)/20)) i, floor((o_totalprice-y0)/((y1-y0)/20)) j, any_value(x0) x0, any_value((x1-x0)/20) dx, any_value(y0) y0, any_value((y1-y0)/20) dy, count(*) n FROM orders, {BOX} GROUP BY 1, 2)
   SELECT round(x0+(i+CASE WHEN j%2=0 THEN 0 ELSE 0.5 END)*dx+dx/2,4) AS x, round(y0+j*dy+dy/2,4) AS y, n FROM g""")
def v19_hexbin(spark, sf):
    return round_doubles(ch.hexbin(rows(spark, sf, "orders"), "o_custkey", "o_totalprice"))


@query(f"""WITH e AS (SELECT *, least(50, ceil(sqrt(n/5))) k FROM {BOX}), g AS (SELECT floor((o_custkey-x0)/((x1-x0)/k)) i, floor((o_totalprice-y0)/((y1-y0)/k)) j, any_value(x0) x0, any_value((x1-x0)/k) dx, any_value(y0) y0, any_value((y1-y0)/k) dy, count(*) c FROM orders, e GROUP BY 1, 2)
   SELECT round(x0+(i+0.5)*dx,4) AS x, round(y0+(j+0.5)*dy,4) AS y, c AS n, CAST(greatest(1, ceil(10.0*c/max(c) OVER ())) AS INTEGER) AS size FROM g""")
def v20_density_grid(spark, sf):
    return round_doubles(ch.density_grid(rows(spark, sf, "orders"), "o_custkey", "o_totalprice"))


@query("SELECT o_orderpriority AS source, o_orderstatus AS target, count(*) AS value FROM orders GROUP BY 1, 2")
def v21_sankey_links(spark, sf):
    return ch.sankey(rows(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")[1]


@query("SELECT DISTINCT o_orderpriority AS node, 'source' AS side FROM orders UNION ALL SELECT DISTINCT o_orderstatus, 'target' FROM orders")
def v21_sankey_nodes(spark, sf):
    return ch.sankey(rows(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")[0]


@query(f"""SELECT node, CAST(count(*) AS BIGINT) AS degree, count(DISTINCT other) AS neighbours FROM (SELECT source AS node, target AS other FROM {LINKS} UNION ALL SELECT target, source FROM {LINKS}) GROUP BY 1""")
def v22_network_nodes(spark, sf):
    return ch.network(links(spark, sf).groupBy("source", "target").agg(F.count(F.lit(1)).alias("value")))[0]


@query(f"SELECT DISTINCT CASE WHEN source = 'F' THEN target ELSE source END AS node FROM {LINKS} WHERE source = 'F' OR target = 'F'")
def v22_network_neighbours(spark, sf):
    return ch.neighbours(links(spark, sf), "F")


@query("""WITH m AS (SELECT c_mktsegment AS k, round(sum(c_acctbal),2) AS v FROM customer GROUP BY 1) SELECT row_number() OVER (ORDER BY k) - 1 AS position, k AS name, round(sum(v) OVER (ORDER BY k) - v,2) AS start, round(sum(v) OVER (ORDER BY k),2) AS "end", v AS value FROM m
   UNION ALL SELECT count(*), 'Total', 0, round(sum(v),2), round(sum(v),2) FROM m""")
def v23_waterfall(spark, sf):
    t = rows(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return round_doubles(ch.waterfall_chart(t, "k", "v", "k"), 2)


@query("WITH g AS (SELECT p_type AS name, sum(p_retailprice) AS value FROM part GROUP BY 1) SELECT name, round(value,2) AS value, round((value-min(value) OVER ())/(max(value) OVER ()-min(value) OVER ()),4) AS scale FROM g")
def v24_treemap(spark, sf):
    return ch.treemap(rows(spark, sf, "part"), "p_type", "p_retailprice").withColumns({"value": F.round("value", 2), "scale": F.round("scale", 4)})


@query("WITH g AS (SELECT l_returnflag x, l_linestatus y, avg(l_quantity) v FROM lineitem GROUP BY 1, 2) SELECT x, y, round(v,4) AS value, round((v-min(v) OVER ())/(max(v) OVER ()-min(v) OVER ()),4) AS scale FROM g")
def v25_heatmap_matrix(spark, sf):
    t = rows(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("v"))
    return round_doubles(ch.heatmap_matrix(t, "l_returnflag", "l_linestatus", "v"))


@query("SELECT event_type AS name, round(sum(value),2) AS value, round((SELECT sum(value) FROM events),2) AS total, round(100*sum(value)/(SELECT sum(value) FROM events),2) AS percent FROM events GROUP BY 1")
def v26_donut(spark, sf):
    return round_doubles(ch.donut(rows(spark, sf, "events"), "event_type", "value"), 2)


@query("""WITH p AS (SELECT c_custkey k, CAST(c_nationkey AS DOUBLE) x, c_acctbal y, greatest(c_acctbal/1000, 0.1) z FROM customer), s AS (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM p),
   f AS (SELECT min(k) k FROM p, s GROUP BY least(floor((x-a)*10/(b-a)),9), least(floor((y-c)*10/(d-c)),9)) SELECT k AS c_custkey, x, y, round(z,4) AS size FROM p WHERE k IN (SELECT k FROM f)""")
def v27_bubble(spark, sf):
    t = rows(spark, sf, "customer").withColumn("z", F.col("c_acctbal") / 1000)
    return round_doubles(ch.bubble(t, "c_nationkey", "c_acctbal", "z", 100, "c_custkey"))


@query("""WITH t AS (SELECT event_type g, CAST(user_id AS VARCHAR) k, min(ts) a, max(ts) b FROM events GROUP BY 1, 2) SELECT g AS "group", k AS name, a AS start, b AS "end", false AS header, round((epoch_us(b)-epoch_us(a))/3.6e9,4) AS hours FROM t
   UNION ALL SELECT g, NULL, min(a), max(b), true, round((epoch_us(max(b))-epoch_us(min(a)))/3.6e9,4) FROM t GROUP BY 1""")
def v28_gantt(spark, sf):
    t = rows(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return round_doubles(ch.gantt(t, "a", "b", "event_type", "user_id"))


@query("""WITH z AS (SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS a, (s_acctbal * 0.5 + s_suppkey - avg(s_acctbal * 0.5 + s_suppkey) OVER ()) / stddev_pop(s_acctbal * 0.5 + s_suppkey) OVER () AS b FROM supplier)
  SELECT s_suppkey, round((a+b)/sqrt(2),4) + 0.0 AS pc1, round(abs(a-b)/sqrt(2),4) AS pc2 FROM z""")
def v30_pca_of_two_columns(spark, sf):
    """At most a thousand suppliers, so all of them are drawn; the sign of the second component is free."""
    t = rows(spark, sf, "supplier").withColumn("b", F.col("s_acctbal") * 0.5 + F.col("s_suppkey"))
    return round_doubles(ch.pca_scatter(t, ["s_acctbal", "b"], "s_suppkey").withColumn("pc2", F.abs("pc2")))


@query()
def v30_pca_scatter(spark, sf):
    return round_doubles(ch.pca_scatter(rows(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey"))
