"""Queries for whole-table analyses."""
from pyspark.sql import functions as F

from . import query, table
from .charts import RHO
from ..operators.common import round_doubles
from ..operators.roles import infer_roles
from ..plans import analyze as an


@query()
def g1_analyze(spark, sf):
    return an.report_sizes(an.analyze(table(spark, sf, "customer"), "c_custkey"))


@query()
def g2_advanced_analysis(spark, sf):
    t = table(spark, sf, "customer")
    return an.report_sizes(an.advanced_analysis(t, infer_roles(t), "c_custkey"))


@query()
def g3_guided_analysis(spark, sf):
    return an.report_sizes(an.guided_analysis(table(spark, sf, "customer"), "Analyze the relationship of c_acctbal and c_mktsegment", "c_custkey"))


@query()
def g4_top_insights(spark, sf):
    return an.top_insights(table(spark, sf, "orders"), "o_orderkey")


@query(f"""WITH p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity,l_extendedprice),2)+0.0 AS r, round({RHO('lineitem', 'l_quantity', 'l_extendedprice')},2)+0.0 AS rho FROM lineitem
   UNION ALL SELECT 'l_quantity', 'net', round(corr(l_quantity,n),2)+0.0, round({RHO('(SELECT *, l_extendedprice*(1-l_discount) AS n FROM lineitem)', 'l_quantity', 'n')},2)+0.0 FROM (SELECT *, l_extendedprice*(1-l_discount) AS n FROM lineitem)
   UNION ALL SELECT 'l_extendedprice', 'net', round(corr(l_extendedprice,n),2)+0.0, round({RHO('(SELECT *, l_extendedprice*(1-l_discount) AS n FROM lineitem)', 'l_extendedprice', 'n')},2)+0.0 FROM (SELECT *, l_extendedprice*(1-l_discount) AS n FROM lineitem))
   SELECT a, b, r, rho, CASE WHEN abs(rho) > abs(r)+.2 THEN 'non_linear' ELSE 'linear' END AS relationship, CASE WHEN greatest(abs(r),abs(rho)) >= .7 THEN 'strong' WHEN greatest(abs(r),abs(rho)) >= .4 THEN 'moderate' WHEN greatest(abs(r),abs(rho)) >= .2 THEN 'weak' ELSE 'negligible' END AS strength FROM p WHERE abs(r) >= .3""")
def g5_correlation_table(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return round_doubles(an.correlation_table(t, ["l_quantity", "l_extendedprice", "net"]))
