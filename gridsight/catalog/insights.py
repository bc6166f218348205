"""Queries for insights."""
from pyspark.sql import functions as F

from . import query, table
from .planted import CONTACT_SQL, contacts
from .profiles import RANGED, WORDS, with_range
from .text import TOKENS, listed
from ..functions import wording
from ..operators import insights as ins
from ..operators.roles import infer_roles

AS = lambda kind, title, content, level, cols: f"SELECT '{kind}' AS type, {title} AS title, {content} AS content, CAST({level} AS DOUBLE) AS importance, {cols} AS columns"


@query(AS("summary", "'Dataset Overview'", """concat('This dataset contains ', n, ' rows and 6 columns. It has 1 numeric columns, 1 datetime columns. ', 'The dataset is complete with no missing values. ', 'The data spans from ', strftime(a,'%Y-%m-%d'), ' to ', strftime(b,'%Y-%m-%d'), '.')""", "10", "[]::VARCHAR[]")
       + " FROM (SELECT count(*) n, min(o_orderdate) a, max(o_orderdate) b FROM orders)")
def i2_summary_insight(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.concat("o_orderstatus", F.lit(" 1 2 3 4")).alias("tag"), F.lit("x").alias("c1"), F.lit("y").alias("c2"))
    roles = spark.createDataFrame([("o_orderkey", 0, "id"), ("o_totalprice", 1, "numeric"), ("o_orderdate", 2, "datetime"), ("tag", 3, "text"), ("c1", 4, "text"), ("c2", 5, "text")], "column string, position int, role string")
    return ins.summary_insight(t, roles)


DIST = lambda c, t: AS("distribution", f"'Distribution of {c}'", f"""concat('The {c} variable has an average of ', printf('%.2f', m), ' and a median of ', printf('%.2f', d), '. It appears to be ', CASE WHEN k > 1 THEN 'right-skewed' WHEN k < -1 THEN 'left-skewed' ELSE 'normally distributed' END,
  ' (skewness: ', printf('%.2f', k), '). ', CASE WHEN o > 0 THEN concat('There are ', o, ' outliers (', printf('%.1f', 100.0*o/n), '% of the data).') ELSE 'No significant outliers were detected.' END)""", "CASE WHEN abs(k) > 1.5 OR 100.0*o/n > 5 THEN 8 ELSE 7 END", f"['{c}']") + f"""
  FROM (SELECT avg({c}) m, median({c}) d, skewness({c}) k, count(*) n FROM {t}), (SELECT count(*) o FROM {t}, (SELECT quantile_cont({c},.25) a, quantile_cont({c},.75) b FROM {t}) WHERE {c} < a-1.5*(b-a) OR {c} > b+1.5*(b-a))"""


@query(DIST("value", "events") + " UNION ALL " + DIST("user_id", "events"))
def i3_distribution_insights(spark, sf):
    return ins.distribution_insights(table(spark, sf, "events"), ["value", "user_id"])


@query(AS("correlation", "'Correlation between l_extendedprice and net'", "concat('There is a strong positive correlation (', printf('%.2f', r), ') between l_extendedprice and net. This means that as l_extendedprice increases, net tends to increase as well.')", "least(9, floor(abs(r)*10))", "['l_extendedprice','net']")
       + " FROM (SELECT corr(l_extendedprice, l_extendedprice*(1-l_discount)) r FROM lineitem)")
def i4_correlation_insights(spark, sf):
    return ins.correlation_insights(table(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)")), ["l_tax", "l_extendedprice", "net"])


@query("WITH e AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 i, count(*) OVER () n FROM events), h AS (SELECT (avg(value) FILTER (WHERE i >= n//2) - avg(value) FILTER (WHERE i < n//2))/avg(value) FILTER (WHERE i < n//2)*100 c FROM e), s AS (SELECT strftime(min(ts),'%Y-%m-%d') a, strftime(max(ts),'%Y-%m-%d') b FROM events), d AS (SELECT *, CASE WHEN c > 5 THEN 'increasing' WHEN c < -5 THEN 'decreasing' ELSE 'stable' END AS t FROM h, s) "
       + AS("trend", "'Trend in value over Time'", "concat('The value shows a ', t, ' trend over time. From ', a, ' to ', b, ', ', CASE WHEN t = 'stable' THEN 'there was no significant change in values.' ELSE concat('there was a ', printf('%.1f', abs(c)), '% ', t, ' trend.') END)", "CASE WHEN abs(c) > 50 THEN 9 WHEN abs(c) > 20 THEN 8 ELSE 7 END", "['ts','value']") + " FROM d")
def i5_trend_insights(spark, sf):
    return ins.trend_insights(table(spark, sf, "events"), "ts", ["value"], "event_id")


@query("WITH t AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice*100 ELSE o_totalprice END AS price FROM orders), q AS (SELECT quantile_cont(price,.25)-1.5*(quantile_cont(price,.75)-quantile_cont(price,.25)) l, quantile_cont(price,.75)+1.5*(quantile_cont(price,.75)-quantile_cont(price,.25)) h FROM t), f AS (SELECT l, h, count(*) n, count(*) FILTER (WHERE price < l) lo, count(*) FILTER (WHERE price > h) hi, max(price) mx, min(price) mn FROM t, q GROUP BY 1, 2) "
       + AS("outlier", "'Outliers in price'", "concat('The price variable has ', lo+hi, ' outliers (', printf('%.1f', 100.0*(lo+hi)/n), '% of data). There are ', lo, ' values below ', printf('%.2f', l), ' and ', hi, ' values above ', printf('%.2f', h), '. ', CASE WHEN hi > 0 THEN concat('The highest outlier is ', printf('%.2f', mx), '. ') ELSE '' END, CASE WHEN lo > 0 THEN concat('The lowest outlier is ', printf('%.2f', mn), '.') ELSE '' END)", "least(8, 5+floor(100.0*(lo+hi)/n/2))", "['price']") + " FROM f WHERE lo+hi > n*.01")
def i6_outlier_insights(spark, sf):
    t = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice")).alias("price"), "o_custkey")
    return ins.outlier_insights(t, ["price", "o_custkey"])


PATTERN = lambda c, t: f"""(WITH k AS (SELECT {c} v, count(*) n, row_number() OVER (ORDER BY count(*) DESC, {c}) i FROM {t} GROUP BY 1), s AS (SELECT sum(n) t, count(*) k FROM k), p AS (SELECT 100.0*sum(n)/any_value(t) p, string_agg(concat('''', v, ''' (', printf('%.1f', 100.0*n/t), '%)'), ', ' ORDER BY i) l, any_value(k) k FROM k, s WHERE i <= 3)
  """ + AS("pattern", f"'Value Distribution in {c}'", f"concat('The top 3 values in {c} account for ', printf('%.1f', p), '% of all data: ', l, '.', CASE WHEN k > 10 THEN concat(' There are ', k, ' unique values in total.') ELSE '' END)", "CASE WHEN p > 90 THEN 8 WHEN p > 75 THEN 7 ELSE 6 END", f"['{c}']") + " FROM p WHERE p > 60 AND k >= 3)"


@query(PATTERN("l_returnflag", "lineitem") + " UNION ALL " + PATTERN("l_shipdate", "lineitem"))
def i7_pattern_insights(spark, sf):
    return ins.pattern_insights(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_shipdate"])


BIN = lambda c, t: f"""(WITH k AS (SELECT CAST({c} AS VARCHAR) v, count(*) n, 100.0*count(*)/(SELECT count(*) FROM {t}) p, row_number() OVER (ORDER BY count(*) DESC, {c}) i FROM {t} GROUP BY {c}), w AS (SELECT a.v av, a.p ap, b.v bv, b.p bp FROM k a, k b WHERE a.i = 1 AND b.i = 2)
  """ + AS("pattern", f"CASE WHEN ap-bp > 40 THEN 'Imbalance in {c}' ELSE 'Distribution of {c}' END", f"""CASE WHEN ap-bp > 40 THEN concat('The {c} variable shows a strong imbalance with ''', av, ''' representing ', printf('%.1f', ap), '% of all values. This significant imbalance may indicate a potential bias in the data collection or a natural class distribution.')
   ELSE concat('The {c} variable has a relatively balanced distribution with ''', av, ''' at ', printf('%.1f', ap), '% and ''', bv, ''' at ', printf('%.1f', bp), '%.') END""", "CASE WHEN ap-bp > 40 THEN least(8, 5+floor((ap-bp)/10)) ELSE 5 END", f"['{c}']") + " FROM w)"


@query(BIN("quality", "labels") + " UNION ALL " + BIN("toxic", "labels"))
def i8_binary_insights(spark, sf):
    return ins.binary_insights(table(spark, sf, "labels"), ["quality", "toxic"])


LIK = lambda c, t: f"""(WITH s AS (SELECT avg({c}) m, min({c}) a, max({c}) b, count(*) n FROM {t}), k AS (SELECT {c} v, 100.0*count(*)/(SELECT n FROM s) p FROM {t} GROUP BY 1), x AS (SELECT *, (SELECT v FROM k ORDER BY p DESC, v LIMIT 1) md, (SELECT max(p) FROM k) tp, (SELECT sum(p) FROM k, s s2 WHERE v IN (a, b)) e FROM s)
  """ + AS("pattern", f"concat(CASE WHEN m > (b+a)*.6/(b-a) THEN 'Positive' WHEN m < (b+a)*.4/(b-a) THEN 'Negative' ELSE 'Balanced' END, ' Ratings in {c}')", f"concat('Responses for {c} ', CASE WHEN m > (b+a)*.6/(b-a) THEN 'are generally positive' WHEN m < (b+a)*.4/(b-a) THEN 'tend to be negative' ELSE 'are relatively balanced' END, ' with an average rating of ', printf('%.2f', m), ' on a scale from ', a, ' to ', b, '. The most common response was ', md, ' (', printf('%.1f', tp), '% of responses).')", "least(8, 5+floor(abs(m-(a+b)/2)/((b-a)/2)*5))", f"['{c}']") + " FROM x UNION ALL " + AS(
    "pattern", f"'Polarized Responses in {c}'", f"concat('The responses for {c} show polarization, with ', printf('%.1f', e), '% of responses at the extreme values (', a, ' and ', b, '). This suggests divided opinions or experiences among respondents.')", "7", f"['{c}']") + " FROM x WHERE e > 50)"
POLES = "(SELECT l_linenumber, CASE WHEN l_orderkey % 5 < 2 THEN 1 WHEN l_orderkey % 5 < 4 THEN 5 ELSE l_orderkey % 3 + 2 END AS mood FROM lineitem)"


@query(LIK("l_linenumber", POLES) + " UNION ALL " + LIK("mood", POLES))
def i9_likert_insights(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_linenumber", "CASE WHEN l_orderkey % 5 < 2 THEN 1 WHEN l_orderkey % 5 < 4 THEN 5 ELSE l_orderkey % 3 + 2 END AS mood")
    return ins.likert_insights(t, ["l_linenumber", "mood"])


@query(f"WITH g AS (SELECT 100.0*count(*) FILTER (WHERE pronoun='Male')/count(*) FILTER (WHERE pronoun<>'other') m, 100.0*count(*) FILTER (WHERE pronoun='female')/count(*) FILTER (WHERE pronoun<>'other') f FROM {CONTACT_SQL}) "
       + AS("pattern", "'Gender Distribution in pronoun'", "concat('The gender distribution in pronoun is relatively balanced with ', printf('%.1f', m), '% male and ', printf('%.1f', f), '% female.')", "5", "['pronoun']") + " FROM g")
def i10_gender_insights(spark, sf):
    return ins.gender_insights(contacts(spark, sf), ["pronoun"])


@query(f"WITH b AS (SELECT CAST(split_part(span,' - ',1) AS DOUBLE) l, CAST(split_part(span,' - ',2) AS DOUBLE) h FROM {RANGED} WHERE span IS NOT NULL), s AS (SELECT avg(l) l, avg(h) h, avg(h-l) w, stddev_samp(h-l) sd, min(h-l) a, max(h-l) b FROM b) "
       + AS("pattern", "'Range Analysis for span'", "concat('The ranges in the span column span from an average minimum of ', printf('%.1f', l), ' to an average maximum of ', printf('%.1f', h), ', with an average width of ', printf('%.1f', w), '. ', CASE WHEN b > 2*w THEN concat('There''s significant variation in range widths, from ', printf('%.1f', a), ' to ', printf('%.1f', b), '.') ELSE concat('Range widths are relatively consistent, with all between ', printf('%.1f', a), ' and ', printf('%.1f', b), '.') END)", "6", "['span']") + " FROM s")
def i11_range_insights(spark, sf):
    return ins.range_insights(with_range(spark, sf), ["span"])


@query(f"WITH s AS (SELECT avg(length(text)) c, avg(w) w, stddev_samp(length(text)) sd, 100*avg(CAST(w <= 3 AS INT)) a, 100*avg(CAST(w >= 50 AS INT)) b FROM (SELECT text, {WORDS.replace('{c}', 'text')} AS w FROM documents)), k AS (SELECT word, count(*) n FROM {TOKENS} WHERE length(word) > 2 AND word NOT IN ({listed(wording.COMMON_STOP_WORDS)}) GROUP BY 1), o AS (SELECT *, (SELECT sum(n) FROM k) t FROM k ORDER BY n DESC, word LIMIT 5) "
       + AS("pattern", "'Text Length Analysis for text'", "concat('Text in the text column averages ', printf('%.1f', c), ' characters and ', printf('%.1f', w), ' words per entry. ', CASE WHEN a > 50 THEN concat('Most entries (', printf('%.1f', a), '%) are very short (3 or fewer words), suggesting brief responses or keywords.') WHEN b > 20 THEN concat('A significant portion (', printf('%.1f', b), '%) are long texts (50+ words), suggesting detailed responses or paragraphs.') ELSE concat('Entries are moderate in length, with ', printf('%.1f', a), '% very short and ', printf('%.1f', b), '% very long.') END)", "CASE WHEN sd/c > 1 THEN 7 ELSE 5 END", "['text']") + " FROM s UNION ALL "
       + AS("pattern", "'Common Words in text'", "concat('Common words in text include: ', string_agg(concat('''', word, ''' (', printf('%.1f', 100.0*n/t), '%)'), ', ' ORDER BY n DESC, word), '. These frequent terms may indicate common themes or topics in the text.')", "6", "['text']") + " FROM o")
def i12_text_insights(spark, sf):
    return ins.text_insights(table(spark, sf, "documents"), ["text"])


@query()
def i1_insights(spark, sf):
    return ins.insights(table(spark, sf, "orders"), "o_orderkey")


@query()
def i13_series_insights(spark, sf):
    return ins.series_insights(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@query("""SELECT 'c_acctbal' AS "column", concat('c_acctbal: distinct=', printf('%.2f', count(DISTINCT c_acctbal)::DOUBLE), ', kurtosis=', printf('%.2f', kurtosis(c_acctbal)), ', max=', printf('%.2f', max(c_acctbal)), ', mean=', printf('%.2f', avg(c_acctbal)), ', median=', printf('%.2f', median(c_acctbal)), ', min=', printf('%.2f', min(c_acctbal)), ', nulls=0.00, outliers=0.00, q1=', printf('%.2f', quantile_cont(c_acctbal,.25)), ', q3=', printf('%.2f', quantile_cont(c_acctbal,.75)), ', skew=', printf('%.2f', skewness(c_acctbal)), ', std=', printf('%.2f', stddev_samp(c_acctbal))) AS text FROM customer""")
def i14_column_facts(spark, sf):
    return ins.column_facts(table(spark, sf, "customer"), ["c_acctbal"])


@query()
def i15_dataset_facts(spark, sf):
    return ins.dataset_facts(table(spark, sf, "supplier"))


@query("""SELECT 1 AS position, 'Consider time series analysis using the datetime column(s): o_orderdate' AS text UNION ALL SELECT 2, 'Analyze correlation between numeric variables to identify important relationships'
  UNION ALL SELECT 3, 'Create distribution plots (histograms, box plots) to better understand the data patterns' UNION ALL SELECT 4, 'Perform group analysis to compare metrics across different categories'""")
def i16_analysis_recommendations(spark, sf):
    t = table(spark, sf, "orders")
    return ins.analysis_recommendations(t, infer_roles(t))


@query("SELECT 4 AS position, 'Create lag features for time series analysis to capture temporal patterns' AS text")
def i17_advanced_recommendations(spark, sf):
    t = table(spark, sf, "orders")
    return ins.advanced_recommendations(t, infer_roles(t))


@query("""WITH r AS (SELECT string_agg(concat('r_regionkey: ', r_regionkey, ', r_name: ', r_name), chr(10) ORDER BY r_regionkey) AS t, count(*) AS n FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 3))
  SELECT concat((SELECT count(*) FROM region), ' rows, 2 columns', chr(10), '- r_regionkey (', (SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' ELSE 'int' END FROM information_schema.columns WHERE table_name = 'region' AND column_name = 'r_regionkey'), ', ', chr(10), t) AS text FROM r""".replace("', ', chr(10), t)", "', id)', chr(10), '- r_name (string, name)', chr(10), t)"))
def i18_context_of_regions(spark, sf):
    return ins.context_block(table(spark, sf, "region"), "r_regionkey")


@query()
def i18_context_block(spark, sf):
    return ins.context_block(table(spark, sf, "customer"), "c_custkey")
