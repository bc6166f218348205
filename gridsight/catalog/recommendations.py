"""Queries for chart recommendations. The SQL gathers the evidence on its own and reads the same rule table."""
from pyspark.sql import functions as F

from . import query, table
from .planted import CONTACT_SQL, contacts
from .profiles import RANGED, with_range
from ..functions import chart_rules as rules
from ..operators import recommend as rec


def ruled(evidence, rule_set, family):
    parts = [f"""SELECT columns, '{k}' AS chart_type, CAST(round({score}, 4) AS DOUBLE) AS score, '{c}' AS category, '{s or "standard"}' AS subcategory, '{x}' AS complexity,
      concat('{k.replace('_', ' ')} ({family}): ', array_to_string(columns, ', ')) AS description FROM e WHERE coalesce({cond}, false)""" for k, c, s, x, cond, score in rule_set]
    return f"WITH e AS ({evidence}) " + " UNION ALL ".join(parts)


NUM = lambda c, t: f"""SELECT ['{c}'] AS columns, count(*) AS "rows", skewness({c}) AS skew, 100.0*count(*) FILTER (WHERE {c} < a-1.5*(b-a) OR {c} > b+1.5*(b-a))/count({c}) AS outlier_percent,
   count(DISTINCT {c})/count(*) AS distinct_ratio, 100.0*(count(*)-count({c}))/count(*) AS null_percent FROM {t}, (SELECT quantile_cont({c},.25) a, quantile_cont({c},.75) b FROM {t})"""


@query(ruled(NUM("value", "events") + " UNION ALL " + NUM("user_id", "events"), rules.NUMERIC, "numeric").replace("rows >", '"rows" >'))
def k2_recommend_numeric(spark, sf):
    return rec.apply_rules(rec.numeric_evidence(table(spark, sf, "events"), ["value", "user_id"]), rules.NUMERIC, "numeric")


CAT = lambda c, t: f"SELECT ['{c}'] AS columns, count(*) AS k, max(n)/sum(n) AS top_share FROM (SELECT count(*) n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})"


@query(ruled(" UNION ALL ".join(CAT(c, "part") for c in ("p_brand", "p_type", "p_name")), rules.CATEGORICAL, "categorical"))
def k3_recommend_categorical(spark, sf):
    return rec.apply_rules(rec.category_evidence(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"]), rules.CATEGORICAL, "categorical")


DAT = lambda c, t: f"SELECT ['{c}'] AS columns, (epoch_us(max({c}))-epoch_us(min({c})))/86400e6 AS range_days, (SELECT stddev_samp(n)/avg(n) FROM (SELECT count(*) n FROM {t} GROUP BY month({c}))) AS month_cv FROM {t}"


@query(ruled(DAT("o_orderdate", "orders"), rules.DATETIME, "datetime"))
def k4_recommend_datetime(spark, sf):
    return rec.apply_rules(rec.datetime_evidence(table(spark, sf, "orders"), ["o_orderdate"]), rules.DATETIME, "datetime")


@query(ruled("SELECT ['l_linenumber'] AS columns, count(DISTINCT l_linenumber) AS points FROM lineitem", rules.LIKERT, "likert"))
def k5_recommend_likert(spark, sf):
    return rec.apply_rules(rec.likert_evidence(table(spark, sf, "lineitem"), ["l_linenumber"]), rules.LIKERT, "likert")


@query(ruled(CAT("quality", "labels") + " UNION ALL " + CAT("toxic", "labels"), rules.BINARY, "binary"))
def k6_recommend_binary(spark, sf):
    return rec.apply_rules(rec.category_evidence(table(spark, sf, "labels"), ["quality", "toxic"]), rules.BINARY, "binary")


@query(ruled("SELECT ['text'] AS columns, avg(length(text)) AS mean_length FROM documents UNION ALL SELECT ['source'], avg(length(source)) FROM documents", rules.TEXT, "text"))
def k7_recommend_text(spark, sf):
    return rec.apply_rules(rec.text_evidence(table(spark, sf, "documents"), ["text", "source"]), rules.TEXT, "text")


@query(ruled(CAT("span", RANGED), rules.RANGE, "range"))
def k8_recommend_range(spark, sf):
    return rec.apply_rules(rec.category_evidence(with_range(spark, sf), ["span"]), rules.RANGE, "range")


PAIR = lambda a, b, t: f'SELECT [\'{a}\',\'{b}\'] AS columns, count(*) AS "rows", corr({a},{b}) AS r FROM {t}'
NET = "(SELECT *, l_extendedprice*(1-l_discount) AS net FROM lineitem)"


@query(ruled(PAIR("l_quantity", "l_extendedprice", NET) + " UNION ALL " + PAIR("l_quantity", "net", NET) + " UNION ALL " + PAIR("l_extendedprice", "net", NET), rules.NUMERIC_NUMERIC, "numeric by numeric").replace("rows >", '"rows" >'))
def k9_recommend_pair_numeric(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return rec.apply_rules(rec.numeric_pairs(t, ["l_quantity", "l_extendedprice", "net"]), rules.NUMERIC_NUMERIC, "numeric by numeric")


GRP = lambda c, v, t: f"""(WITH g AS (SELECT {c}, count(*) n, avg({v}) m, var_samp({v}) s FROM {t} GROUP BY 1) SELECT ['{c}','{v}'] AS columns, count(*) AS k, stddev_samp(m)/avg(m) AS cv,
   count(*) >= 3 AND min(n) >= 5 AND ((sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n))/(count(*)-1))/(sum((n-1)*s)/(sum(n)-count(*))) > 2.4 AS significant FROM g)"""


@query(ruled(" UNION ALL ".join([GRP("p_brand", "p_size", "part"), GRP("p_brand", "p_retailprice", "part"), GRP("p_type", "p_size", "part"), GRP("p_type", "p_retailprice", "part")]), rules.CATEGORICAL_NUMERIC, "categorical by numeric"))
def k10_recommend_pair_categorical_numeric(spark, sf):
    return rec.apply_rules(rec.category_numeric_pairs(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_size", "p_retailprice"]), rules.CATEGORICAL_NUMERIC, "categorical by numeric")


@query(ruled("""SELECT ['ts','value'] AS columns, any_value(n) AS "rows", any_value(d) AS range_days, (avg(value) FILTER (WHERE i >= n - n//4) - avg(value) FILTER (WHERE i < n//4))/abs(avg(value) FILTER (WHERE i < n//4))*100 AS change_percent
   FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 i, count(*) OVER () n FROM events), (SELECT (epoch_us(max(ts))-epoch_us(min(ts)))/86400e6 d FROM events)""", rules.DATETIME_NUMERIC, "datetime by numeric").replace("rows >", '"rows" >'))
def k11_recommend_pair_datetime_numeric(spark, sf):
    return rec.apply_rules(rec.datetime_numeric_pairs(table(spark, sf, "events"), ["ts"], ["value"], "event_id"), rules.DATETIME_NUMERIC, "datetime by numeric")


def chi(a, b, t, crit, cols):
    return f"""(WITH c AS (SELECT {a} a, {b} b, count(*) n FROM {t} GROUP BY 1, 2), r AS (SELECT a, sum(n) x FROM c GROUP BY 1), k AS (SELECT b, sum(n) y FROM c GROUP BY 1), t AS (SELECT sum(n) t FROM c), e AS (SELECT r.a, k.b, x*y/t AS e FROM r, k, t)
      SELECT {cols}, CASE WHEN sum((coalesce(n,0)-e)*(coalesce(n,0)-e)/e) > {crit} THEN 0.01 ELSE 0.5 END AS p FROM e LEFT JOIN c USING (a, b))"""


# 5% points of chi-square with 8 and with 24 degrees of freedom.
@query(ruled(chi("o_orderpriority", "o_orderstatus", "orders", 15.507, "['o_orderpriority','o_orderstatus'] AS columns, 5 AS k1, 3 AS k2"), rules.CATEGORICAL_CATEGORICAL, "categorical by categorical"))
def k12_recommend_pair_categorical(spark, sf):
    return rec.apply_rules(rec.category_pairs(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"]), rules.CATEGORICAL_CATEGORICAL, "categorical by categorical")


@query(ruled("""SELECT ['o_orderdate','l_shipdate'] AS columns, stddev_samp(h) < abs(avg(h))*.2 AND abs(avg(h)-median(h)) < abs(avg(h))*.1 AS consistent FROM (SELECT date_diff('second', o_orderdate, l_shipdate)/3600 AS h FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""", rules.DATETIME_DATETIME, "datetime by datetime"))
def k13_recommend_pair_datetime(spark, sf):
    t = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rec.apply_rules(rec.datetime_pairs(t, ["o_orderdate", "l_shipdate"]), rules.DATETIME_DATETIME, "datetime by datetime")


@query(ruled(chi("isodow(o_orderdate)", "o_orderpriority", "orders", 36.415, "['o_orderdate','o_orderpriority'] AS columns, 5 AS k"), rules.DATETIME_CATEGORICAL, "datetime by categorical"))
def k14_recommend_pair_datetime_categorical(spark, sf):
    return rec.apply_rules(rec.datetime_category_pairs(table(spark, sf, "orders"), ["o_orderdate"], ["o_orderpriority"]), rules.DATETIME_CATEGORICAL, "datetime by categorical")


@query(ruled("""SELECT ['l_linestatus','l_extendedprice'] AS columns, least(n1, n2) AS smallest, CASE WHEN abs((m1-m2)/sqrt(e1+e2)) > 1.96 THEN 0.01 ELSE 0.5 END AS p FROM
   (SELECT count(*) FILTER (WHERE f) n1, count(*) FILTER (WHERE NOT f) n2, avg(v) FILTER (WHERE f) m1, avg(v) FILTER (WHERE NOT f) m2, var_samp(v) FILTER (WHERE f)/count(*) FILTER (WHERE f) e1, var_samp(v) FILTER (WHERE NOT f)/count(*) FILTER (WHERE NOT f) e2 FROM (SELECT l_linestatus = 'F' AS f, l_extendedprice AS v FROM lineitem))""", rules.BINARY_NUMERIC, "binary by numeric"))
def k15_recommend_pair_binary_numeric(spark, sf):
    return rec.apply_rules(rec.binary_numeric_pairs(table(spark, sf, "lineitem"), ["l_linestatus"], ["l_extendedprice"]), rules.BINARY_NUMERIC, "binary by numeric")


LIKERT = "(SELECT l_linenumber AS q1, least(7, l_linenumber + l_orderkey % 2) AS q2 FROM lineitem)"


@query(ruled(PAIR("q1", "q2", LIKERT), rules.LIKERT_LIKERT, "likert by likert"))
def k16_recommend_pair_likert(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_linenumber AS q1", "least(7, l_linenumber + l_orderkey % 2) AS q2")
    return rec.apply_rules(rec.numeric_pairs(t, ["q1", "q2"]), rules.LIKERT_LIKERT, "likert by likert")


@query(ruled("""SELECT ['value','ts','event_type'] AS columns, count(*) AS k, max(c) > 20 AND min(c) < -20 AS diverging FROM (SELECT event_type, (avg(value) FILTER (WHERE i >= n - n//4) - avg(value) FILTER (WHERE i < n//4))/abs(avg(value) FILTER (WHERE i < n//4))*100 AS c
   FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 i, count(*) OVER (PARTITION BY event_type) n FROM events) GROUP BY 1)""", rules.NUMERIC_DATETIME_CATEGORICAL, "numeric, datetime and categorical"))
def k17_recommend_triple_numeric_datetime_categorical(spark, sf):
    return rec.apply_rules(rec.numeric_datetime_category(table(spark, sf, "events"), "value", "ts", "event_type", "event_id"), rules.NUMERIC_DATETIME_CATEGORICAL, "numeric, datetime and categorical")


@query(ruled("SELECT ['p_size','p_retailprice','p_brand'] AS columns, count(*) AS k, max(r) FILTER (WHERE n >= 10) - min(r) FILTER (WHERE n >= 10) AS span FROM (SELECT p_brand, count(*) n, corr(p_size, p_retailprice) r FROM part GROUP BY 1)", rules.TWO_NUMERIC_CATEGORICAL, "two numeric by categorical"))
def k18_recommend_triple_two_numeric(spark, sf):
    return rec.apply_rules(rec.two_numeric_category(table(spark, sf, "part"), [("p_size", "p_retailprice")], "p_brand"), rules.TWO_NUMERIC_CATEGORICAL, "two numeric by categorical")


STRONG = "SELECT abs(corr(l_quantity,l_extendedprice)) a, abs(corr(l_quantity,net)) b, abs(corr(l_extendedprice,net)) c FROM " + NET


@query(ruled(f"SELECT ['l_quantity','l_extendedprice','net'] AS columns, greatest(a,b,c) > .7 AS strong FROM ({STRONG})", rules.THREE_NUMERIC, "three numeric"))
def k19_recommend_triple_numeric(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return rec.apply_rules(rec.numeric_triples(t, ["l_quantity", "l_extendedprice", "net"]), rules.THREE_NUMERIC, "three numeric")


@query(ruled(f"SELECT ['l_quantity','l_extendedprice','net'] AS columns, CAST(a > .7 AS INT) + CAST(b > .7 AS INT) + CAST(c > .7 AS INT) AS strong_pairs, CAST(a > .7 AS INT) + CAST(b > .7 AS INT) + CAST(c > .7 AS INT) >= 2 AS grouped FROM ({STRONG})", rules.CORRELATION, "correlation"))
def k20_recommend_correlation(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return rec.apply_rules(rec.correlation_evidence(t, ["l_quantity", "l_extendedprice", "net"]), rules.CORRELATION, "correlation")


def series_sql():
    from .series import parts
    body = parts(True).replace("l_returnflag AS series_id", "'all' AS series_id")
    return f"""{body}, ev AS (SELECT ['l_shipdate','l_extendedprice','l_quantity'] AS columns, (SELECT (epoch_us(max(l_shipdate))-epoch_us(min(l_shipdate)))/86400e6 FROM lineitem) AS range_days, stddev_samp(seasonal)/stddev_samp(residual) AS seasonal_ratio FROM d) """ + ruled(
        "SELECT 1", rules.SERIES, "time series").split(") ", 1)[1].replace("FROM e WHERE", "FROM ev WHERE")


@query(series_sql())
def k21_recommend_series(spark, sf):
    return rec.apply_rules(rec.series_evidence(table(spark, sf, "lineitem"), "l_shipdate", ["l_extendedprice", "l_quantity"]), rules.SERIES, "time series")


@query()
def k1_recommend_charts(spark, sf):
    return rec.recommend_charts(table(spark, sf, "orders"), "o_orderkey")


# With a quality of 100 the factor is 1, and the six best of the pair rules are one per chart type, then the next best score.
@query("WITH r AS (" + ruled(PAIR("l_extendedprice", "net", NET), rules.NUMERIC_NUMERIC, "numeric by numeric").replace("rows >", '"rows" >') + """), f AS (SELECT *, row_number() OVER (PARTITION BY chart_type ORDER BY score DESC, array_to_string(columns, ','), subcategory) AS f FROM r),
  s AS (SELECT * FROM f ORDER BY CASE WHEN f = 1 THEN 0 ELSE 1 END, score DESC, chart_type LIMIT 6) SELECT CAST(row_number() OVER (ORDER BY score DESC, chart_type, array_to_string(columns, ','), subcategory) AS INTEGER) AS position, columns, chart_type, score, category, subcategory, complexity, description FROM s""")
def k22_best_charts(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    return rec.best_charts(rec.apply_rules(rec.numeric_pairs(t, ["l_extendedprice", "net"]), rules.NUMERIC_NUMERIC, "numeric by numeric"), 100.0, 6)


@query()
def k23_build_charts(spark, sf):
    from ..operators.charts import chart_sizes
    return chart_sizes(rec.build_charts(table(spark, sf, "orders"), "o_orderkey"))
