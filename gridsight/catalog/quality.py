"""Queries for data quality."""
from pyspark.sql import functions as F

from . import query, table
from .planted import CLEAN, CLEAN_SQL, CONTACT, CONTACT_SQL, CONTACT_TEXT, contacts, dirty_orders, doubled
from .profiles import each, gap_sql
from ..functions import vocab
from ..operators import quality as q
from ..operators.common import round_doubles

AS_OF = "2001-01-01"
COMPLETE = f"""WITH t AS {CLEAN_SQL}, c AS ({each("SELECT '{c}' AS col, count(*)-count({c}) AS nulls, count(*) AS n FROM t", CLEAN)})"""


@query(COMPLETE + ' SELECT col AS "column", nulls, n AS "rows", round(100.0*nulls/n,4) AS null_percent, 100.0*nulls/n > 20 AS problem FROM c')
def q1_completeness(spark, sf):
    return round_doubles(q.completeness(dirty_orders(spark, sf)))


@query(COMPLETE + " SELECT round(100*(1-sum(nulls)/sum(n)),4) AS score, CAST(sum(nulls) AS BIGINT) AS missing_cells, round(100.0*sum(nulls)/sum(n),4) AS missing_percent FROM c")
def q1_completeness_score(spark, sf):
    return round_doubles(q.completeness_score(q.completeness(dirty_orders(spark, sf))))


FORMATS = {"user_email": CONTACT["box"], "join_date": "CASE WHEN c_custkey % 9 = 0 THEN 'soon' ELSE '2020-05-17' END",
           "phone": "CASE WHEN c_custkey % 8 = 0 THEN '12-345' ELSE '090-123-4567' END", "segment": CONTACT["segment"]}
FORMAT_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in FORMATS.items()) + " FROM customer)"


def formats(spark, sf):
    return table(spark, sf, "customer").select(*[F.expr(e).alias(c) for c, e in FORMATS.items()])


FORMAT_ISSUES = f"""SELECT 'user_email' AS "column", 'inconsistent_email_format' AS issue, count(*) AS n FROM {FORMAT_SQL} WHERE NOT regexp_matches(user_email, '{vocab.EMAIL}')
   UNION ALL SELECT 'join_date', 'inconsistent_date_format', count(*) FROM {FORMAT_SQL} WHERE try_cast(join_date AS DATE) IS NULL
   UNION ALL SELECT 'phone', 'inconsistent_phone_format', count(*) - max(k) FROM (SELECT count(*) OVER (PARTITION BY length(regexp_replace(phone,'\\D','','g'))) k FROM {FORMAT_SQL})"""
CASE_ISSUES = f"SELECT 'segment' AS \"column\", 'inconsistent_capitalization' AS issue, count(DISTINCT segment)-count(DISTINCT lower(segment)) AS n FROM {FORMAT_SQL}"


@query(FORMAT_ISSUES)
def q2_format_consistency(spark, sf):
    return q.format_consistency(formats(spark, sf))


@query(CASE_ISSUES)
def q3_case_variants(spark, sf):
    return q.case_variants(formats(spark, sf))


@query("""SELECT col AS "column", 'potential_unit_inconsistency' AS issue, CAST(1 AS BIGINT) AS n FROM (
   SELECT 'o_orderkey' col, log10(max(o_orderkey)) - log10(min(o_orderkey) FILTER (WHERE o_orderkey>0)) s FROM orders
   UNION ALL SELECT 'o_custkey', log10(max(o_custkey)) - log10(min(o_custkey) FILTER (WHERE o_custkey>0)) FROM orders
   UNION ALL SELECT 'o_totalprice', log10(max(o_totalprice)) - log10(min(o_totalprice) FILTER (WHERE o_totalprice>0)) FROM orders) WHERE s > 3""")
def q4_unit_spread(spark, sf):
    return q.unit_spread(table(spark, sf, "orders"))


@query(f"SELECT round(100*(1-least(1.0, sum(n)/(SELECT 4.0*count(*) FROM customer))),4) AS score, CAST(sum(n) AS BIGINT) AS inconsistency_count FROM ({FORMAT_ISSUES} UNION ALL {CASE_ISSUES})")
def q5_consistency_score(spark, sf):
    t = formats(spark, sf)
    return round_doubles(q.consistency_score(q.consistency(t), 4 * t.count()))


DOUBLED = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 20 = 0)"


def doubled_orders(spark, sf):
    return doubled(table(spark, sf, "orders"), "o_orderkey")


@query(f'SELECT a AS "rows", a-b AS duplicates, round(100.0*(a-b)/a,4) AS percent FROM (SELECT (SELECT count(*) FROM {DOUBLED}) a, (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) b)')
def q6_duplicate_rows(spark, sf):
    return round_doubles(q.duplicate_rows(doubled_orders(spark, sf)))


@query(f"""WITH t AS {CLEAN_SQL}, c AS ({each("SELECT '{c}' AS col, count(*) n, count({c}) f, count(DISTINCT {c}) d FROM t", CLEAN)})
   SELECT col AS "column", d AS distinct_values, round(100.0*d/f,4) AS unique_percent, 100.0*d/f >= 90 AND f > n*0.9 AS identifier FROM c WHERE f >= n*0.5""")
def q7_uniqueness(spark, sf):
    return round_doubles(q.uniqueness(dirty_orders(spark, sf)))


@query(f"""SELECT round((100.0-100.0*(a-b)/a)*0.8,4) AS score, round(100.0*(a-b)/a,4) AS duplicate_percent, false AS has_identifier FROM
   (SELECT (SELECT count(*) FROM (SELECT l_quantity, l_discount, l_returnflag FROM lineitem)) a, (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM lineitem)) b)""")
def q7_uniqueness_score(spark, sf):
    return round_doubles(q.uniqueness_score(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_returnflag")))


OUT = lambda c: f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < a-3*(b-a) OR {c} > b+3*(b-a)) AS outliers,
   round(100.0*count(*) FILTER (WHERE {c} < a-3*(b-a) OR {c} > b+3*(b-a))/count({c}),4) AS outlier_percent,
   100.0*count(*) FILTER (WHERE {c} < a-3*(b-a) OR {c} > b+3*(b-a))/count({c}) > 5 AS issue
   FROM t, (SELECT quantile_cont({c},.25) a, quantile_cont({c},.75) b FROM t)"""


@query(f"WITH t AS {CLEAN_SQL} " + " UNION ALL ".join(OUT(c) for c in ("o_orderkey", "price", "half", "amount", "sparse")))
def q8_outlier_share(spark, sf):
    return round_doubles(q.outlier_share(dirty_orders(spark, sf)))


@query("""SELECT 'discount_rate' AS "column", 1.0::DOUBLE AS upper, count(*) FILTER (WHERE l_discount - 0.02 < 0) AS invalid FROM lineitem
   UNION ALL SELECT 'fill_percent', 100.0, count(*) FILTER (WHERE l_quantity*2.5 > 100) FROM lineitem""")
def q9_percent_range(spark, sf):
    li = table(spark, sf, "lineitem")
    return q.percent_range(li.select((F.col("l_discount") - 0.02).alias("discount_rate"), (F.col("l_quantity") * 2.5).alias("fill_percent"), "l_tax"))


@query(f"""SELECT 'o_orderdate' AS "column", count(*) FILTER (WHERE o_orderdate > TIMESTAMP '{AS_OF}') AS future, 0 AS ancient FROM orders
   UNION ALL SELECT 'shifted', 0, count(*) FILTER (WHERE o_orderdate - INTERVAL 100 YEAR < TIMESTAMP '1900-01-01') FROM orders""")
def q10_date_bounds(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return q.date_bounds(o.withColumn("shifted", F.expr("o_orderdate - INTERVAL 100 YEARS")), AS_OF)


@query(f"""SELECT 'ts' AS "column", round(greatest(0, 1-least(1, stddev_pop(g)/avg(g)/3)),4) AS regularity, greatest(0, 1-least(1, stddev_pop(g)/avg(g)/3)) < 0.5 AS irregular FROM {gap_sql('ts', 'events')}""")
def q11_irregular_intervals(spark, sf):
    return round_doubles(q.irregular_intervals(table(spark, sf, "events")))


@query(f"""WITH t AS (SELECT o_totalprice * CASE WHEN o_orderkey % 50 = 0 THEN 100 ELSE 1 END AS price FROM orders), o AS ({OUT('price')})
   SELECT round(100.0 - least(50, 5*count(*) FILTER (WHERE issue) + sum(outlier_percent)/2),2) AS score, CAST(count(*) FILTER (WHERE issue) AS INTEGER) AS issues, round(sum(outlier_percent),2) AS outlier_percent_sum FROM o""")
def q12_integrity_score(spark, sf):
    t = table(spark, sf, "orders").select(F.expr("o_totalprice * CASE WHEN o_orderkey % 50 = 0 THEN 100 ELSE 1 END").alias("price"))
    return round_doubles(q.integrity_score(t, AS_OF), 2)


@query(f"""WITH t AS {CONTACT_SQL}, s AS ({each("SELECT '{c}' AS col, avg(CASE WHEN contains({c},'{') AND contains({c},'}') THEN 1.0 ELSE 0 END) j, avg(CASE WHEN regexp_matches({c},'[,;]') AND NOT regexp_matches({c},'[\n\r]') THEN 1.0 ELSE 0 END) d FROM t", CONTACT_TEXT)})
   SELECT col AS "column", 'potential_json_in_string' AS issue, round(j,4) AS share FROM s WHERE j > 0 UNION ALL SELECT col, 'multiple_values_in_cell', round(d,4) FROM s WHERE d > 0.5""")
def q13_accuracy(spark, sf):
    return round_doubles(q.accuracy(contacts(spark, sf)))


@query(f"""WITH t AS {CONTACT_SQL}, s AS ({each("SELECT '{c}' AS col, avg(CASE WHEN contains({c},'{') AND contains({c},'}') THEN 1.0 ELSE 0 END) j, avg(CASE WHEN regexp_matches({c},'[,;]') THEN 1.0 ELSE 0 END) d FROM t", CONTACT_TEXT)})
   SELECT 100.0 - least(50, 10.0*n)::DOUBLE AS score, n AS issues FROM (SELECT count(*) FILTER (WHERE j>0) + count(*) FILTER (WHERE d>0.5) AS n FROM s)""")
def q13_accuracy_score(spark, sf):
    return q.accuracy_score(q.accuracy(contacts(spark, sf)))


def order_metrics(spark, sf):
    return q.quality_metrics(doubled_orders(spark, sf).drop("o_orderdate"), AS_OF)


ORDER_SCORES = f"""WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {DOUBLED}), o AS ({OUT('o_orderkey')} UNION ALL {OUT('o_custkey')} UNION ALL {OUT('o_totalprice')}),
   n AS (SELECT (SELECT count(*) FROM t) a, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) b),
   u AS (SELECT count(*) k FROM (SELECT log10(max(o_orderkey)) - log10(min(o_orderkey) FILTER (WHERE o_orderkey>0)) s FROM t UNION ALL SELECT log10(max(o_custkey)) - log10(min(o_custkey) FILTER (WHERE o_custkey>0)) FROM t UNION ALL SELECT log10(max(o_totalprice)) - log10(min(o_totalprice)) FROM t) WHERE s > 3),
   p AS (SELECT 100.0::DOUBLE AS completeness, 100*(1-k/(5.0*a)) AS consistency, 100.0-100.0*(a-b)/a AS uniqueness, 100.0-(SELECT 5*count(*) FILTER (WHERE issue)+sum(outlier_percent)/2 FROM o) AS integrity, 100.0::DOUBLE AS accuracy FROM n, u)"""


@query(ORDER_SCORES + """ SELECT round(completeness,2) AS completeness, round(consistency,2) AS consistency, round(uniqueness,2) AS uniqueness, round(integrity,2) AS integrity, round(accuracy,2) AS accuracy,
   round(.3*completeness+.2*consistency+.2*uniqueness+.2*integrity+.1*accuracy,2) AS overall FROM p""")
def q14_overall_score(spark, sf):
    return round_doubles(q.overall_score(order_metrics(spark, sf)), 2)


# Of ten columns besides the key some are mostly null by construction, and price and key spread over more than three decades.
MISSING = "(SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in CLEAN) + f" AS k, {len(CLEAN)} * count(*) AS n FROM {CLEAN_SQL})"


@query(f"""SELECT 1 AS position, printf('High level of missing data: %.1f%% of values are missing', 100.0 * k / n) AS text FROM {MISSING}
  UNION ALL SELECT 2, 'Columns with excessive missing values: amount, half, sparse' UNION ALL SELECT 5, 'Data consistency issues in columns: o_orderkey, price'""")
def q15_issues(spark, sf):
    return q.issues(q.quality_metrics(dirty_orders(spark, sf), AS_OF))


@query("""SELECT 1 AS position, 'Consider imputing missing values or removing columns with excessive missing data' AS text
  UNION ALL SELECT 9, 'Optimize memory usage by converting numeric columns to appropriate dtypes'""")
def q16_recommendations(spark, sf):
    return q.recommendations(q.quality_metrics(dirty_orders(spark, sf), AS_OF))


@query(ORDER_SCORES + """, s AS (SELECT *, .3*completeness+.2*consistency+.2*uniqueness+.2*integrity+.1*accuracy AS overall FROM p)
  SELECT 'score' AS kind, unnest([0, 1, 2, 3, 4, 5]) AS position, unnest(['overall', 'completeness', 'consistency', 'uniqueness', 'integrity', 'accuracy']) AS text,
    round(unnest([overall, completeness, consistency, uniqueness, integrity, accuracy]), 2) AS value FROM s""")
def q17_summary_scores(spark, sf):
    return q.quality_summary(order_metrics(spark, sf)).filter("kind = 'score'")


@query()
def q17_quality_summary(spark, sf):
    return q.quality_summary(q.quality_metrics(dirty_orders(spark, sf), AS_OF))


@query(COMPLETE + ' SELECT col AS "column", nulls AS missing_count, round(100.0*nulls/n,4) AS missing_percent FROM c')
def q18_missing_values(spark, sf):
    return round_doubles(q.missing_values(dirty_orders(spark, sf)))


@query(f"SELECT a-b AS count, round(100.0*(a-b)/a,4) AS percentage FROM (SELECT (SELECT count(*) FROM {DOUBLED}) a, (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) b)")
def q19_duplicates(spark, sf):
    return round_doubles(q.duplicates(doubled_orders(spark, sf)))


@query(f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS price FROM orders), o AS ({OUT('price')} UNION ALL {OUT('o_orderkey')})
   SELECT "column", round(1 - CASE WHEN "column"='price' THEN 0.2 ELSE 0 END - outlier_percent/100*0.3 - 0.2,2) AS quality FROM o""")
def q20_column_quality(spark, sf):
    return round_doubles(q.column_quality(q.quality_metrics(dirty_orders(spark, sf).select("o_orderkey", "price"), AS_OF)), 2)


@query(COMPLETE + ' SELECT col AS "column", round(1.0-nulls/n,4) AS completeness FROM c')
def q21_column_completeness(spark, sf):
    return round_doubles(q.column_completeness(dirty_orders(spark, sf)))
