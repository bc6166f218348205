"""Queries for the descriptive profiles."""
from pyspark.sql import functions as F

from . import query, table
from ..operators import profile as p
from ..operators.common import round_doubles
from ..operators.statistics import anova

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r(expr, name, digits=4):
    return f'round({expr}, {digits}) AS "{name}"'


def each(template, cols):
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


NUMERIC = each(
    """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}),2) AS mean, round(stddev_samp({c}),2) AS std,
    round(min({c}),2) AS min, round(quantile_cont({c},.01),2) AS p1, round(quantile_cont({c},.05),2) AS p5,
    round(quantile_cont({c},.25),2) AS p25, round(quantile_cont({c},.5),2) AS p50, round(quantile_cont({c},.75),2) AS p75,
    round(quantile_cont({c},.95),2) AS p95, round(quantile_cont({c},.99),2) AS p99, round(max({c}),2) AS max,
    round(avg(power(({c}-m)/s,3)),2)+0.0 AS skewness, round(kurtosis_pop({c}),2) AS kurtosis
    FROM lineitem, (SELECT avg({c}) m, stddev_pop({c}) s FROM lineitem)""", PRICES)


@query(NUMERIC)
def a1_numeric_summary(spark, sf):
    return p.numeric_summary(table(spark, sf, "lineitem"), PRICES)


@query("""WITH s AS (SELECT count(*) n, min(l_extendedprice) lo, max(l_extendedprice) hi,
    quantile_cont(l_extendedprice,.25) q1, quantile_cont(l_extendedprice,.75) q3 FROM lineitem),
  w AS (SELECT *, least((hi-lo)/(log2(n)+1), 2*(q3-q1)/power(n,1.0/3)) w FROM s),
  k AS (SELECT *, CAST(ceil((hi-lo)/w) AS INTEGER) k FROM w),
  g AS (SELECT unnest(range(k))::INTEGER AS bin, lo, hi, k FROM k),
  c AS (SELECT least(floor((l_extendedprice-lo)*k/(hi-lo)), k-1)::INTEGER AS bin, count(*) n FROM lineitem, k GROUP BY 1)
  SELECT g.bin, round(lo+g.bin*((hi-lo)/k),4) AS lo, round(lo+(g.bin+1)*((hi-lo)/k),4) AS hi, coalesce(c.n,0) AS n
  FROM g LEFT JOIN c USING (bin)""")
def a2_auto_histogram(spark, sf):
    return round_doubles(p.auto_histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


COUNTS = lambda cols, t: each("SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM " + t + " GROUP BY 2", cols)
CATS = ["p_brand", "p_type", "p_name"]


@query(f"""WITH c AS ({COUNTS(CATS, 'part')}),
  t AS (SELECT col, count(*) d, sum(n) total FROM c GROUP BY 1),
  e AS (SELECT col, -sum(n/total*ln(n/total)) e FROM c JOIN t USING (col) GROUP BY 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM c)
  SELECT col AS "column", d AS distinct_values, CAST(total AS BIGINT) AS total, round(e,4) AS entropy,
    first_value(value) OVER (PARTITION BY col ORDER BY rank) AS mode, CAST(rank AS INTEGER) AS rank, value, n, round(100.0*n/total,4) AS percent
  FROM k JOIN t USING (col) JOIN e USING (col) WHERE rank <= 15""")
def a3_categorical_summary(spark, sf):
    return round_doubles(p.categorical_summary(table(spark, sf, "part"), CATS))


FLAGS = ["quality", "toxic"]
BINARY = f"""WITH c AS ({COUNTS(FLAGS, 'labels')})
  SELECT col AS "column", value, n, round(100.0*n/sum(n) OVER (PARTITION BY col),4) AS percent,
  first_value(value) OVER (PARTITION BY col ORDER BY n DESC, value) AS mode FROM c"""


@query(BINARY)
def a4_binary_summary(spark, sf):
    return round_doubles(p.binary_summary(table(spark, sf, "labels"), FLAGS))


# Planted gender words: a fixed share of each spelling.
GENDER = "CASE c_custkey % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'F' WHEN 2 THEN 'nam' WHEN 3 THEN 'Female' ELSE 'other' END"


@query(f"""SELECT {GENDER} AS value, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM customer),4) AS percent
  FROM customer GROUP BY 1""")
def a5_gender_counts(spark, sf):
    return round_doubles(p.gender_counts(table(spark, sf, "customer").withColumn("gender", F.expr(GENDER)), "gender"))


@query("""WITH c AS (SELECT l_linenumber v, count(*) n FROM lineitem GROUP BY 1),
  s AS (SELECT count(*) AS count, avg(l_linenumber) mean, quantile_cont(l_linenumber,.5) median, stddev_samp(l_linenumber) std,
   min(l_linenumber) min, max(l_linenumber) max, count(DISTINCT l_linenumber) scale_points FROM lineitem)
  SELECT 'l_linenumber' AS "column", count, round(mean,4) AS mean, CAST(median AS DOUBLE) AS median,
   CAST((SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS DOUBLE) AS mode, round(std,4) AS std, CAST(min AS DOUBLE) AS min,
   CAST(max AS DOUBLE) AS max, scale_points, CAST(v AS DOUBLE) AS value, n, round(100.0*n/count,4) AS percent FROM c, s""")
def a6_likert_summary(spark, sf):
    return round_doubles(p.likert_summary(table(spark, sf, "lineitem"), ["l_linenumber"]))


# Planted interval text such as "12-17"; every seventh value is null.
RANGE_TEXT = """CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), ' - ',
  CAST(CAST(l_quantity AS INT) + l_linenumber AS STRING)) END"""


def with_range(spark, sf):
    return table(spark, sf, "lineitem").withColumn("span", F.expr(RANGE_TEXT))


RANGED = f"(SELECT *, {RANGE_TEXT.replace('STRING', 'VARCHAR')} AS span FROM lineitem)"


@query(f"""WITH b AS (SELECT span, CAST(regexp_extract(span,'(\\d+)\\s*[-–—]\\s*(\\d+)',1) AS DOUBLE) lo,
   CAST(regexp_extract(span,'(\\d+)\\s*[-–—]\\s*(\\d+)',2) AS DOUBLE) hi FROM {RANGED}),
  c AS (SELECT span AS value, count(*) n, row_number() OVER (ORDER BY count(*) DESC, span) AS rank FROM b WHERE span IS NOT NULL GROUP BY 1)
  SELECT 'span' AS "column", value, n, CAST(rank AS INTEGER) AS rank, s.* FROM c, (SELECT count(DISTINCT span) AS distinct_values,
   round(avg(lo),4) AS mean_lo, round(avg(hi),4) AS mean_hi, round(avg(hi-lo),4) AS mean_width, count(*)-count(span) AS nulls FROM b) s WHERE rank <= 5""")
def a7_range_summary(spark, sf):
    return round_doubles(p.range_summary(with_range(spark, sf), ["span"]))


WORDS = "CASE WHEN trim({c}, ' \t\n\r') = '' THEN 0 ELSE len(string_split_regex(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"


@query(f"""SELECT 'text' AS "column", count(DISTINCT text) AS distinct_values, round(avg(length(text)),4) AS mean_length,
   CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length, round(avg({WORDS.replace('{c}', 'text')}),4) AS mean_words,
   count(*)-count(text) AS nulls FROM documents""")
def a8_text_summary(spark, sf):
    return round_doubles(p.text_summary(table(spark, sf, "documents"), ["text"]))


PARTS = lambda c, t: f"""SELECT 'year' AS part, CAST(year({c}) AS INTEGER) AS value, count(*) AS n FROM {t} GROUP BY 2
  UNION ALL SELECT 'month', CAST(month({c}) AS INTEGER), count(*) FROM {t} GROUP BY 2
  UNION ALL SELECT 'day_of_week', CAST(isodow({c})-1 AS INTEGER), count(*) FROM {t} GROUP BY 2
  UNION ALL SELECT 'hour', CAST(hour({c}) AS INTEGER), count(*) FROM {t} GROUP BY 2"""


def gap_sql(c, t):
    return f"(SELECT {c} AS ts, (epoch_us({c}) - lag(epoch_us({c})) OVER (ORDER BY {c})) / 1e6 AS g FROM {t})"


@query(f"""SELECT 'ts' AS "column", part, value, n, s.*, d.* FROM ({PARTS('ts', 'events')}) q,
  (SELECT min(ts) AS min_ts, max(ts) AS max_ts, round((epoch_us(max(ts))-epoch_us(min(ts)))/86400e6,4) AS range_days FROM events) s,
  (SELECT round(min(g),4) AS gap_min, round(max(g),4) AS gap_max, round(avg(g),4) AS gap_mean, round(stddev_samp(g),4) AS gap_std,
   round(median(g),4) AS gap_median FROM {gap_sql('ts', 'events')}) d""")
def a9_datetime_summary(spark, sf):
    return round_doubles(p.datetime_summary(table(spark, sf, "events"), ["ts"]))


@query("""SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice),4) AS mean, round(stddev_samp(l_extendedprice),4) AS std,
   min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice,.25),4) AS q1,
   round(quantile_cont(l_extendedprice,.5),4) AS median, round(quantile_cont(l_extendedprice,.75),4) AS q3 FROM lineitem GROUP BY 1""")
def a10_group_statistics(spark, sf):
    return round_doubles(p.group_statistics(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


SEGMENT_ROWS = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


@query(f"""WITH j AS (SELECT c_mktsegment, o_totalprice v FROM {SEGMENT_ROWS}),
  g AS (SELECT c_mktsegment, count(*) n, avg(v) m, var_samp(v) s2 FROM j GROUP BY 1),
  a AS (SELECT sum(n) nn, count(*) k, sum(n*m)/sum(n) mm, sum((n-1)*s2) ssw FROM g),
  f AS (SELECT (sum(n*(m-mm)*(m-mm))/(any_value(k)-1))/(any_value(ssw)/(any_value(nn)-any_value(k))) f FROM g, a)
  SELECT c_mktsegment, count(*) AS count, round(avg(v),4) AS mean, round(stddev_samp(v),4) AS std, min(v) AS min, max(v) AS max,
   round(quantile_cont(v,.25),4) AS q1, round(quantile_cont(v,.5),4) AS median, round(quantile_cont(v,.75),4) AS q3,
   round((SELECT f FROM f),4) AS f_statistic FROM j GROUP BY 1""")
def segment_value_report(spark, sf):
    joined = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_mktsegment", "o_totalprice"))
    f = anova(joined, "c_mktsegment", "o_totalprice").first()["f_statistic"]
    return round_doubles(p.group_statistics(joined, "c_mktsegment", "o_totalprice").withColumn("f_statistic", F.lit(f)))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
   o_orderdate, o_orderpriority FROM orders),
  s AS (SELECT count(*) n, count(*)-count(o_totalprice) z, strftime(min(o_orderdate),'%Y-%m-%d %H:%M:%S') a, strftime(max(o_orderdate),'%Y-%m-%d %H:%M:%S') b FROM o)
  SELECT 'size' AS section, 'rows' AS name, CAST(n AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS percent FROM s
  UNION ALL SELECT 'size','columns','6',NULL
  UNION ALL SELECT 'nulls','total',CAST(z AS VARCHAR), round(100.0*z/(n*6),4) FROM s
  UNION ALL SELECT 'nulls','columns_with_nulls','1',NULL
  UNION ALL SELECT 'nulls',c, CASE WHEN c='o_totalprice' THEN CAST(z AS VARCHAR) ELSE '0' END, CASE WHEN c='o_totalprice' THEN round(100.0*z/n,4) ELSE 0 END
    FROM s, unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) u(c)
  UNION ALL SELECT 'types','bigint','2',round(100.0*2/6,4) UNION ALL SELECT 'types','string','2',round(100.0*2/6,4)
  UNION ALL SELECT 'types','double','1',round(100.0/6,4) UNION ALL SELECT 'types','timestamp','1',round(100.0/6,4)
  UNION ALL SELECT 'time_from','o_orderdate',a,NULL FROM s UNION ALL SELECT 'time_to','o_orderdate',b,NULL FROM s""")
def a11_dataset_info(spark, sf):
    orders = table(spark, sf, "orders")
    planted = orders.withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"))
    types = {f.name: f.dataType.simpleString().replace("timestamp_ntz", "timestamp") for f in planted.schema}
    info = p.dataset_info(planted)
    return round_doubles(info.withColumn("name", F.regexp_replace("name", "timestamp_ntz", "timestamp"))) if types else info


def column_facts(c, t, num=True):
    base = f"SELECT '{c}' AS \"column\", 'nulls' AS metric, CAST(count(*)-count({c}) AS DOUBLE) AS value FROM {t} UNION ALL SELECT '{c}', 'distinct', count(DISTINCT {c}) FROM {t}"
    if not num:
        return base
    m = {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})", "skew": f"skewness({c})",
         "kurtosis": f"kurtosis({c})", "q1": f"quantile_cont({c},.25)", "median": f"quantile_cont({c},.5)", "q3": f"quantile_cont({c},.75)"}
    rows = [base] + [f"SELECT '{c}', '{k}', {e} FROM {t}" for k, e in m.items()]
    rows.append(f"""SELECT '{c}', 'outliers', count(*) FROM {t}, (SELECT quantile_cont({c},.25) a, quantile_cont({c},.75) b FROM {t})
        WHERE {c} < a-1.5*(b-a) OR {c} > b+1.5*(b-a)""")
    return " UNION ALL ".join(rows)


CUSTOMER_FACTS = " UNION ALL ".join(
    [column_facts(c, "customer") for c in ("c_custkey", "c_nationkey", "c_acctbal")]
    + [column_facts(c, "customer", False) for c in ("c_name", "c_mktsegment")]
    + [f"SELECT '{c}', 'mean_length', avg(length({c})) FROM customer" for c in ("c_name", "c_mktsegment")]
    + [f"SELECT '{c}', 'top_percent', 100.0*max(n)/sum(n) FROM (SELECT count(*) n FROM customer GROUP BY {c})" for c in ("c_name", "c_mktsegment")])


@query(f"""WITH f AS ({CUSTOMER_FACTS}),
  c AS (SELECT 'c_acctbal' a, 'c_custkey' b, corr(c_acctbal, c_custkey) r FROM customer UNION ALL
   SELECT 'c_custkey', 'c_nationkey', corr(c_custkey, c_nationkey) FROM customer UNION ALL SELECT 'c_nationkey', 'c_acctbal', corr(c_nationkey, c_acctbal) FROM customer)
  SELECT 'table' AS section, '' AS name, 'duplicate_rows' AS metric, CAST((SELECT count(*) FROM customer) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS DOUBLE) AS value
  UNION ALL SELECT 'table', '', 'rows', count(*) FROM customer
  UNION ALL SELECT 'column', "column", metric, round(value, 4) FROM f
  UNION ALL SELECT 'correlation', least(a,b), greatest(a,b), round(r,4) FROM c""")
def a12_profile(spark, sf):
    out = p.profile(table(spark, sf, "customer"))
    flip = (F.col("section") == "correlation") & (F.col("name") > F.col("metric"))
    return round_doubles(out.select("section", F.when(flip, F.col("metric")).otherwise(F.col("name")).alias("name"),
                                    F.when(flip, F.col("name")).otherwise(F.col("metric")).alias("metric"), "value"))


@query(f"""SELECT "column", metric, round(value,4) AS value FROM ({column_facts('value', 'events')} UNION ALL {column_facts('event_type', 'events', False)}
   UNION ALL {column_facts('ts', 'events', False)}
   UNION ALL SELECT 'event_type', 'mean_length', avg(length(event_type)) FROM events
   UNION ALL SELECT 'event_type', 'top_percent', 100.0*max(n)/sum(n) FROM (SELECT count(*) n FROM events GROUP BY event_type)
   UNION ALL SELECT 'ts', 'gap_min_days', min(g)/86400 FROM {gap_sql('ts', 'events')} UNION ALL SELECT 'ts', 'gap_mean_days', avg(g)/86400 FROM {gap_sql('ts', 'events')}
   UNION ALL SELECT 'ts', 'gap_max_days', max(g)/86400 FROM {gap_sql('ts', 'events')} UNION ALL SELECT 'ts', 'range_days', sum(g)/86400 FROM {gap_sql('ts', 'events')})""")
def a13_column_profile(spark, sf):
    return round_doubles(p.column_profile(table(spark, sf, "events"), ["value", "event_type", "ts"]))


@query("""SELECT 's_suppkey' AS "column", 'bigint' AS type, 0 AS nulls, count(DISTINCT s_suppkey) AS distinct_values, CAST(min(s_suppkey) AS DOUBLE) AS min,
   CAST(max(s_suppkey) AS DOUBLE) AS max, round(avg(s_suppkey),4) AS mean, round(quantile_cont(s_suppkey,.5),4) AS median FROM supplier
  UNION ALL SELECT 's_nationkey', 'int', 0, count(DISTINCT s_nationkey), min(s_nationkey), max(s_nationkey), round(avg(s_nationkey),4), round(quantile_cont(s_nationkey,.5),4) FROM supplier
  UNION ALL SELECT 's_acctbal', 'double', 0, count(DISTINCT s_acctbal), min(s_acctbal), max(s_acctbal), round(avg(s_acctbal),4), round(quantile_cont(s_acctbal,.5),4) FROM supplier
  UNION ALL SELECT 's_name', 'string', 0, count(DISTINCT s_name), NULL, NULL, NULL, NULL FROM supplier""")
def a14_basic_stats(spark, sf):
    return round_doubles(p.basic_stats(table(spark, sf, "supplier")))


def yearly_partials(spark, sf):
    orders = table(spark, sf, "orders").withColumn("batch_year", F.year("o_orderdate"))
    return p.partial_profile(orders, "batch_year", ["o_totalprice"], ["o_orderpriority"])


@query("""SELECT 'o_totalprice' AS "column", count(*) AS n, round(avg(o_totalprice),2) AS mean, round(stddev_pop(o_totalprice),2) AS std,
   min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""")
def a15_merge_numeric_partials(spark, sf):
    return round_doubles(p.merge_numeric(yearly_partials(spark, sf)), 2)


@query("""SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS INTEGER) AS rank,
   first_value(o_orderpriority) OVER (ORDER BY count(*) DESC, o_orderpriority) AS mode FROM orders GROUP BY 2""")
def a15_merge_count_partials(spark, sf):
    return p.merge_counts(yearly_partials(spark, sf))


@query("""SELECT year(o_orderdate)::INTEGER AS batch, 'o_totalprice' AS "column", CAST(NULL AS VARCHAR) AS value, count(*) AS n, round(sum(o_totalprice),1) AS total,
   round(sum(o_totalprice*o_totalprice)/1e6,1) AS total_sq, round(var_pop(o_totalprice)*count(*)/1e6,1) AS m2, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1
  UNION ALL SELECT year(o_orderdate)::INTEGER, 'o_orderpriority', o_orderpriority, count(*), NULL, NULL, NULL, NULL, NULL FROM orders GROUP BY 1, 3""")
def a15_partial_profile(spark, sf):
    t = yearly_partials(spark, sf)
    return t.withColumns({"total_sq": F.round(F.col("total_sq") / 1e6, 1), "m2": F.round(F.col("m2") / 1e6, 1), "total": F.round("total", 1)})


SKETCHED = ["l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]


def yearly_sketches(spark, sf):
    return p.sketch_profile(table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate")), "year", *SKETCHED)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n, count(DISTINCT {c}) AS distinct_values, quantile_disc({c}, .25) AS q25, quantile_disc({c}, .5) AS median, quantile_disc({c}, .75) AS q75 FROM lineitem""" for c in SKETCHED[0])
       + "".join(f" UNION ALL SELECT '{c}', count(*), count(DISTINCT {c}), NULL, NULL, NULL FROM lineitem" for c in SKETCHED[1]))
def a15_merge_sketches(spark, sf):
    """Columns of few values, whose quartiles lie well inside a value: sketches must give the exact ones."""
    return p.merge_sketches(yearly_sketches(spark, sf)).select("column", "n", "distinct_values", *[F.col("q")[i].alias(n) for i, n in enumerate(["q25", "median", "q75"])])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM lineitem GROUP BY 2""" for c in SKETCHED[1]))
def a15_merge_frequent_sketches(spark, sf):
    return p.merge_top(yearly_sketches(spark, sf))


TOP = """SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank FROM {t} GROUP BY 2 QUALIFY rank <= 10"""


@query(TOP.format(c="p_brand", t="part") + " UNION ALL " + TOP.format(c="p_type", t="part"))
def a13_top_values(spark, sf):
    return p.top_values(table(spark, sf, "part"), ["p_brand", "p_type"])


@query(TOP.format(c="l_quantity", t="(SELECT CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem)"))
def a16_top_values(spark, sf):
    return p.top_values(table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("l_quantity")), ["l_quantity"])


@query("""SELECT 'shifted' AS "column", count(*) AS n, round(1e9 + avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(1e9 + min(value), 4) AS min, round(1e9 + max(value), 4) AS max FROM events""")
def a15_merge_large_offset(spark, sf):
    t = table(spark, sf, "events").withColumn("shifted", F.col("value") + 1e9)
    return round_doubles(p.merge_numeric(p.partial_profile(t, "event_type", ["shifted"], ["event_type"]).filter("column = 'shifted'")), 4)


@query("""WITH b AS (SELECT least(floor((l_discount-0.0)*10/(m-0.0)),9)::INTEGER AS bin, count(*) n FROM lineitem, (SELECT max(l_discount) m FROM lineitem) GROUP BY 1)
  SELECT 'l_discount' AS "column", g.bin::INTEGER AS bin, round(g.bin*s.max/10,4) AS bin_lo, round((g.bin+1)*s.max/10,4) AS bin_hi, coalesce(b.n,0) AS n, s.*
  FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON b.bin = g.bin, (SELECT count(*) AS count, 0 AS missing, count(DISTINCT l_discount) AS distinct_values,
   min(l_discount) AS min, max(l_discount) AS max, round(avg(l_discount),4) AS mean, round(stddev_pop(l_discount),4) AS std, quantile_cont(l_discount,.5) AS median FROM lineitem) s""")
def a16_column_stats(spark, sf):
    return round_doubles(p.column_stats(table(spark, sf, "lineitem"), ["l_discount"]))


@query("""WITH f AS (SELECT user_id, count(*) "rows", avg(value) quality, min(ts) created FROM events GROUP BY 1)
  SELECT count(*) AS datasets, CAST(sum("rows") AS BIGINT) AS total_rows, round(avg(quality),4) AS mean_quality,
   count(*) FILTER (WHERE date_trunc('month',created) = TIMESTAMP '2024-01-01') AS created_this_month FROM f""")
def a17_portfolio_stats(spark, sf):
    files = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("value").alias("quality"), F.min("ts").alias("created"))
    return round_doubles(p.portfolio_stats(files, "2024-01-15"))


@query("""SELECT coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, 'Unknown') AS segment,
   round(sum(c_acctbal),2) AS c_acctbal, count(*) AS "rows" FROM customer GROUP BY 1""")
def a18_grouped_sums(spark, sf):
    t = table(spark, sf, "customer").withColumn("segment", F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END"))
    return round_doubles(p.grouped_sums(t, "segment", ["c_acctbal"]), 2)


@query(each("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, false AS approximate FROM lineitem", ["l_partkey", "l_suppkey", "l_shipdate"]))
def a19_distinct_counts(spark, sf):
    return p.distinct_counts(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_shipdate"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a20_crosstab(spark, sf):
    return p.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus='F') AS "F", count(*) FILTER (WHERE o_orderstatus='O') AS "O",
   count(*) FILTER (WHERE o_orderstatus='P') AS "P" FROM orders GROUP BY 1""")
def a20_crosstab_wide(spark, sf):
    return p.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", wide=True)


@query("SELECT lang, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM documents),4) AS percent FROM documents GROUP BY 1")
def a21_label_distribution(spark, sf):
    return round_doubles(p.label_distribution(table(spark, sf, "documents"), "lang"))


@query("""SELECT key, count(*) AS requests, round(100.0*count(*) FILTER (WHERE value < 50)/count(*),4) AS success_rate, round(avg(value),4) AS mean_latency,
   round(quantile_cont(value,.5),4) AS p50, round(quantile_cont(value,.95),4) AS p95
  FROM (SELECT event_type AS key, value FROM events UNION ALL SELECT 'ALL', value FROM events) GROUP BY 1""")
def a22_service_metrics(spark, sf):
    return round_doubles(p.service_metrics(table(spark, sf, "events"), "event_type", F.col("value") < 50, "value"))


@query("""SELECT event_type, ts, props, event_id, CAST(recency AS INTEGER) AS recency, kind_count FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS recency,
   count(*) OVER (PARTITION BY event_type) AS kind_count FROM events) WHERE recency <= 10""")
def a23_error_digest(spark, sf):
    return p.error_digest(table(spark, sf, "events"), "event_type", "ts", "props", "event_id")


@query("SELECT event_type, count(*) AS count, round(sum(value),2) AS total, round(avg(value),4) AS mean, max(value) AS max FROM events GROUP BY 1")
def a23_duration_totals(spark, sf):
    return p.duration_totals(table(spark, sf, "events"), "event_type", "value").withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query(f"SELECT CAST(round(g) AS BIGINT) AS gap, count(*) AS n FROM {gap_sql('o_orderdate', 'orders')} WHERE g IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap LIMIT 3")
def a24_common_gaps(spark, sf):
    return p.common_gaps(table(spark, sf, "orders"), "o_orderdate")
