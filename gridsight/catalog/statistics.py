"""Queries for correlation, tests and selection."""
from pyspark.sql import functions as F

from . import query, table
from .charts import RHO
from ..operators import statistics as st
from ..operators.common import round_doubles

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NET = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice*(1-l_discount) AS net, l_extendedprice*l_extendedprice AS sq FROM lineitem)"
ALL = [*COLS, "net", "sq"]
pairs = lambda cols: [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def li(spark, sf):
    return table(spark, sf, "lineitem").withColumns({"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "sq": F.col("l_extendedprice") * F.col("l_extendedprice")})


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),4)+0.0 AS r FROM {NET}" for a, b in pairs(ALL)))
def c1_pearson(spark, sf):
    return round_doubles(st.pearson(li(spark, sf), ALL))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({RHO(NET, a, b)},4)+0.0 AS rho" for a, b in pairs(ALL)))
def c2_spearman(spark, sf):
    return round_doubles(st.spearman(li(spark, sf), ALL))


NULLED = "(SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS a, o_custkey AS b FROM orders)"


@query(f"SELECT 'a' AS a, 'b' AS b, round({RHO(f'(SELECT * FROM {NULLED} WHERE a IS NOT NULL)', 'a', 'b')},4)+0.0 AS rho")
def c2_spearman_with_nulls(spark, sf):
    t = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("a"), F.col("o_custkey").alias("b"))
    return round_doubles(st.spearman(t, ["a", "b"]))


@query(f"""WITH p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round((SELECT corr({a},{b}) FROM {NET}),2)+0.0 AS r, round({RHO(NET, a, b)},2)+0.0 AS rho" for a, b in pairs(ALL))})
  SELECT a, b, r, rho, CASE WHEN abs(rho) > abs(r)+0.2 THEN 'non_linear' ELSE 'linear' END AS relationship,
  CASE WHEN greatest(abs(r),abs(rho)) >= .7 THEN 'strong' WHEN greatest(abs(r),abs(rho)) >= .4 THEN 'moderate' WHEN greatest(abs(r),abs(rho)) >= .2 THEN 'weak' ELSE 'negligible' END AS strength FROM p""")
def c3_correlation_pairs(spark, sf):
    return round_doubles(st.correlation_pairs(li(spark, sf), ALL))


@query("SELECT 'l_extendedprice' AS group_id, unnest(['l_extendedprice','net','sq']) AS \"column\"")
def c4_multicollinear_groups(spark, sf):
    return st.multicollinear_groups(st.pearson(li(spark, sf), ALL))


@query(f"""WITH g AS (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1 HAVING count(*) >= 10) SELECT l_returnflag, n, round(r,4)+0.0 AS r, (SELECT max(r)-min(r) > .3 FROM g) AS differs FROM g""")
def c5_correlation_by(spark, sf):
    return round_doubles(st.correlation_by(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"))


@query("""WITH g AS (SELECT o_orderpriority k, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders GROUP BY 1)
  SELECT count(*) AS "groups", CAST(sum(n) AS BIGINT) AS total, round((sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n))/(count(*)-1) / (sum((n-1)*v)/(sum(n)-count(*))),3) AS f_statistic, count(*)-1 AS df_between, CAST(sum(n)-count(*) AS BIGINT) AS df_within FROM g""")
def c6_anova(spark, sf):
    return round_doubles(st.anova(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").drop("p_value"), 3)


@query("""WITH g AS (SELECT l_linestatus k, count(*) n, avg(l_extendedprice) m, var_samp(l_extendedprice) v FROM lineitem GROUP BY 1), p AS (SELECT a.n n1, a.m m1, a.v/a.n e1, b.n n2, b.m m2, b.v/b.n e2 FROM g a, g b WHERE a.k = 'F' AND b.k = 'O')
  SELECT round((m1-m2)/sqrt(e1+e2),4) AS t_statistic, round((e1+e2)*(e1+e2)/(e1*e1/(n1-1)+e2*e2/(n2-1)),2) AS df FROM p""")
def c7_welch_t(spark, sf):
    return st.welch_t(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice").select(F.round("t_statistic", 4).alias("t_statistic"), F.round("df", 2).alias("df"))


def chi(a, b, t, yates=False):
    gap = "greatest(abs(coalesce(n,0)-e)-0.5, 0)" if yates else "(coalesce(n,0)-e)"
    return f"""WITH c AS (SELECT {a} a, {b} b, count(*) n FROM {t} GROUP BY 1, 2), r AS (SELECT a, sum(n) x FROM c GROUP BY 1), k AS (SELECT b, sum(n) y FROM c GROUP BY 1), t AS (SELECT sum(n) t FROM c),
      e AS (SELECT r.a, k.b, x*y/t AS e FROM r, k, t) SELECT round(sum({gap}*{gap}/e),4) AS chi2, CAST(((SELECT count(*) FROM r)-1)*((SELECT count(*) FROM k)-1) AS INTEGER) AS df, CAST((SELECT t FROM t) AS DOUBLE) AS total FROM e LEFT JOIN c USING (a, b)"""


@query(chi("o_orderpriority", "o_orderstatus", "orders"))
def c8_chi_square(spark, sf):
    return round_doubles(st.chi_square(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus").drop("p_value"))


@query(chi("quality", "toxic", "labels", True))
def c8_chi_square_yates(spark, sf):
    return round_doubles(st.chi_square(table(spark, sf, "labels"), "quality", "toxic").drop("p_value"))


@query(chi("isodow(o_orderdate)", "o_orderpriority", "orders"))
def c9_dow_chi_square(spark, sf):
    return round_doubles(st.dow_chi_square(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority").drop("p_value"))


def k2(n, g1, g2):
    """The omnibus statistic step by step, as nested selects."""
    return f"""(SELECT z1*z1 + z2*z2 FROM (SELECT z1, ((1-2/(9*a)) - sign(q)*power(abs(q),1.0/3))/sqrt(2/(9*a)) z2 FROM (SELECT *, (1-2/a)/(1+x*sqrt(2/(a-4))) q FROM
     (SELECT *, 6+8/be*(2/be+sqrt(1+4/(be*be))) a FROM (SELECT *, d*ln(y/al+sqrt((y/al)*(y/al)+1)) z1 FROM (SELECT *, 1/sqrt(0.5*ln(w2)) d, sqrt(2/(w2-1)) al FROM
     (SELECT *, sqrt(2*(b2-1))-1 w2 FROM (SELECT {g1}*sqrt((n+1)*(n+3)/(6*(n-2))) y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) b2,
       ({g2}+3-3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) x, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) be FROM (SELECT CAST({n} AS DOUBLE) n)))))))))"""


def norm(c, t):
    return f"""(SELECT '{c}' AS "column", count(*) n, avg(power(({c}-m)/s,3)) g1, kurtosis_pop({c}) g2, count(*) ln, avg(power((ln({c})-lm)/ls,3)) l1, kurtosis_pop(ln({c})) l2 FROM {t}, (SELECT avg({c}) m, stddev_pop({c}) s, avg(ln({c})) lm, stddev_pop(ln({c})) ls FROM {t}))"""


NORM = "(" + " UNION ALL ".join(f"SELECT * FROM {norm(c, t)}" for c, t in (("l_extendedprice", "lineitem"), ("l_quantity", "lineitem"))) + ")"


@query(f"""SELECT "column", n, round(g1,4) AS skewness, round(g2,4) AS kurtosis, round({k2('s.n', 'g1', 'g2')},3) AS k2, round(exp(-{k2('s.n', 'g1', 'g2')}/2),4) AS p_value, round({k2('s.n', 'l1', 'l2')},3) AS log_k2, round(exp(-{k2('s.n', 'l1', 'l2')}/2),4) AS log_p_value FROM {NORM} s""")
def c10_normality(spark, sf):
    t = st.normality(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return t.select("column", "n", *[F.round(c, 4).alias(c) for c in ("skewness", "kurtosis", "p_value", "log_p_value")], *[F.round(c, 3).alias(c) for c in ("k2", "log_k2")])


KS = lambda c, t: f"""SELECT '{c}' AS "column", CAST(sum(k) AS BIGINT) AS n, round(max(greatest(u/tot - (v-lo)/(hi-lo), (v-lo)/(hi-lo) - (u-k)/tot)),6) AS d FROM (SELECT {c} v, count(*) k, sum(count(*)) OVER (ORDER BY {c}) u FROM {t} GROUP BY 1), (SELECT min({c}) lo, max({c}) hi, count(*) tot FROM {t})"""


@query(KS("o_totalprice", "orders") + " UNION ALL " + KS("o_custkey", "orders"))
def c11_ks_uniform(spark, sf):
    return round_doubles(st.ks_uniform(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]).drop("p_value"), 6)


@query(f"""WITH k AS ({KS('o_totalprice', 'orders')} UNION ALL {KS('o_custkey', 'orders')}), m AS (SELECT 'o_totalprice' c, avg(power((o_totalprice-a)/s,3)) g1, kurtosis_pop(o_totalprice) g2 FROM orders, (SELECT avg(o_totalprice) a, stddev_pop(o_totalprice) s FROM orders)
   UNION ALL SELECT 'o_custkey', avg(power((o_custkey-a)/s,3)), kurtosis_pop(o_custkey) FROM orders, (SELECT avg(o_custkey) a, stddev_pop(o_custkey) s FROM orders))
   SELECT "column", CASE WHEN d*(sqrt(n)+.12+.11/sqrt(n)) < 1.3581 THEN 'uniform' WHEN abs(g1) > 1 THEN 'skewed' WHEN g2 > 1 THEN 'heavy_tailed' ELSE 'unknown' END AS distribution FROM k JOIN m ON c = "column\"""")
def c12_distribution_type(spark, sf):
    return st.distribution_type(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]).select("column", "distribution")


CORRS = " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, abs(corr({a},{b})) r FROM lineitem" for a, b in pairs(COLS))


@query(f"""WITH c AS ({CORRS}), s AS (SELECT a AS k, sum(r) r FROM (SELECT a, r FROM c UNION ALL SELECT b, r FROM c) GROUP BY 1), v AS ({' UNION ALL '.join(f"SELECT '{c}' k, var_samp({c}) v FROM lineitem" for c in COLS)})
  SELECT k AS "column", round((v/sum(v) OVER () + r/sum(r) OVER ())/2,4) AS importance FROM s JOIN v USING (k)""")
def c15_variance_correlation_importance(spark, sf):
    return round_doubles(st.variance_correlation_importance(table(spark, sf, "lineitem"), COLS))


@query(f"""SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{c}' AS "column", round(power(corr({c}, net),2)/(1-power(corr({c}, net),2))*(count(*)-2),2) AS f_score FROM {NET}''' for c in COLS)}) ORDER BY f_score DESC LIMIT 2""")
def c17_select_k_best(spark, sf):
    return round_doubles(st.select_k_best(li(spark, sf), "net", COLS, 2), 2)


def mi(c):
    return f"""SELECT '{c}' AS "column", round(sum(n/t*ln(n*t/(nx*ny))),4) AS mutual_information FROM (SELECT *, sum(n) OVER (PARTITION BY x) nx, sum(n) OVER (PARTITION BY y) ny, sum(n) OVER () t FROM
      (SELECT least(floor(({c}-a)*10/(b-a)),9) x, least(floor((net-u)*10/(w-u)),9) y, count(*) n FROM {NET}, (SELECT min({c}) a, max({c}) b, min(net) u, max(net) w FROM {NET}) GROUP BY 1, 2))"""


@query(" UNION ALL ".join(mi(c) for c in COLS))
def c18_mutual_information(spark, sf):
    return round_doubles(st.mutual_information(li(spark, sf), "net", COLS))


@query("""SELECT 1 AS position, 'sq' AS "column", round(var_samp(l_extendedprice*l_extendedprice)/1e15,3) AS variance FROM lineitem UNION ALL SELECT 2, 'l_quantity', round(var_samp(l_quantity)/1e15,3) FROM lineitem""")
def c19_select_uncorrelated(spark, sf):
    return st.select_uncorrelated(li(spark, sf), ["l_quantity", "l_extendedprice", "net", "sq"], 4).withColumn("variance", F.round(F.col("variance") / 1e15, 3))


@query("""WITH p AS (SELECT l_extendedprice*l_extendedprice AS y, l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS z FROM lineitem), c AS (SELECT count(*) n, corr(y,z) a, corr(y,z*z) b, corr(z,z*z) c FROM p), f AS (SELECT n, a*a l, (a*a+b*b-2*a*b*c)/(1-c*c) q, b-a*c k FROM c)
  SELECT n, round(l,4) AS linear_r2, round(q,4) AS quadratic_r2, CASE WHEN q > l+.1 AND k > 0 THEN 'quadratic (U-shaped)' WHEN q > l+.1 THEN 'quadratic (inverted U-shaped)' ELSE 'linear' END AS relationship FROM f""")
def c23_polynomial_fit(spark, sf):
    return round_doubles(st.polynomial_fit(li(spark, sf), "l_extendedprice", "sq"))


@query("""SELECT round(s,4) AS slope, round(i,4) AS intercept, a AS x1, round(s*a+i,4) AS y1, b AS x2, round(s*b+i,4) AS y2 FROM (SELECT regr_slope(l_extendedprice, l_quantity) s, regr_intercept(l_extendedprice, l_quantity) i, min(l_quantity) a, max(l_quantity) b FROM lineitem)""")
def c24_regression_line(spark, sf):
    return round_doubles(st.regression_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


LIKERT = "(SELECT l_linenumber AS q1, least(7, l_linenumber + l_orderkey % 2) AS q2, l_orderkey % 5 + 1 AS q3 FROM lineitem)"


def likert(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_linenumber AS q1", "least(7, l_linenumber + l_orderkey % 2) AS q2", "l_orderkey % 5 + 1 AS q3")


@query(f"""WITH p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round({RHO(LIKERT, a, b)},2)+0.0 AS rho" for a, b in pairs(['q1', 'q2', 'q3']))}) SELECT a, b, rho, CASE WHEN rho > 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(rho) > .8 THEN 'strong' ELSE 'moderate' END AS strength FROM p WHERE abs(rho) > .6""")
def c25_likert_pairs(spark, sf):
    return round_doubles(st.likert_pairs(likert(spark, sf), ["q1", "q2", "q3"]))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(abs(skewness({c})),4) AS polarization, CASE WHEN abs(skewness({c})) > .5 THEN 'high' ELSE 'low' END AS polarization_type,
  round((SELECT max(n)/sum(n) FROM (SELECT count(*) n FROM {LIKERT} GROUP BY {c})),4) AS consensus, (SELECT CASE WHEN max(n)/sum(n) > .7 THEN 'high' WHEN max(n)/sum(n) > .5 THEN 'medium' ELSE 'low' END FROM (SELECT count(*) n FROM {LIKERT} GROUP BY {c})) AS consensus_type FROM {LIKERT}""" for c in ("q1", "q2", "q3")))
def c26_likert_consensus(spark, sf):
    return round_doubles(st.likert_consensus(likert(spark, sf), ["q1", "q2", "q3"]))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", (SELECT CAST({c} AS VARCHAR) FROM labels GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common, (SELECT CAST({c} AS VARCHAR) FROM labels GROUP BY {c} ORDER BY count(*), {c} LIMIT 1) AS least_common,
  max(n) AS most_count, round(100.0*max(n)/sum(n),4) AS most_percent, round(max(n)/min(n),4) AS bias_ratio FROM (SELECT count(*) n FROM labels GROUP BY {c})""" for c in ("quality", "toxic")))
def c27_binary_bias(spark, sf):
    return round_doubles(st.binary_bias(table(spark, sf, "labels"), ["quality", "toxic"]))
