"""Queries for nearest neighbours, forests, projection, clustering and prediction."""
from pyspark.sql import functions as F

from . import query, table
from .planted import CLEAN_SQL, dirty_orders
from ..operators import learn as ln
from ..operators import neighbours as nb
from ..operators.common import round_doubles

# One donor per customer; nearest by balance and nation.
KNN = """SELECT s_suppkey, c_custkey AS donor, round(sqrt(power(s_acctbal-c_acctbal,2)+power(s_nationkey-c_nationkey,2)),4) AS distance,
   CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt(power(s_acctbal-c_acctbal,2)+power(s_nationkey-c_nationkey,2)), c_custkey) AS INTEGER) AS rank FROM supplier, customer QUALIFY rank <= 3"""


def supplier_points(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("donor"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"))
    return s, c


@query(KNN)
def j8_nearest(spark, sf):
    s, c = supplier_points(spark, sf)
    return round_doubles(nb.nearest(s, c, ["bal", "nation"], 3, "s_suppkey", "donor"))


@query(KNN)
def j8_nearest_on_grid(spark, sf):
    s, c = supplier_points(spark, sf)
    return round_doubles(nb.nearest(s, c, ["bal", "nation"], 3, "s_suppkey", "donor", cell_rows=64))


@query("""WITH p AS (SELECT c_custkey k, c_nationkey::DOUBLE a, (c_custkey % 100)::DOUBLE b, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END t FROM customer),
  r AS (SELECT q.k, d.t, row_number() OVER (PARTITION BY q.k ORDER BY sqrt(power(q.a-d.a,2)+power(q.b-d.b,2)), d.k) i FROM p q, p d WHERE q.t IS NULL AND d.t IS NOT NULL),
  f AS (SELECT k, avg(t) v FROM r WHERE i <= least(5, (SELECT count(*)//20 FROM p)) GROUP BY 1)
  SELECT p.k AS c_custkey, round(coalesce(t, v),4) AS balance FROM p LEFT JOIN f USING (k)""")
def t4_impute_knn(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 100).alias("b"),
                                            F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_acctbal")).alias("balance"))
    return round_doubles(nb.impute_knn(t, "balance", ["a", "b"], "c_custkey").select("c_custkey", "balance"))


SPARSE = {
    "a": "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 7 ELSE c_nationkey END", "b": "CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_custkey % 100 END",
    "c": "CASE WHEN c_custkey % 11 = 0 OR c_custkey % 35 = 0 THEN NULL ELSE c_custkey * 37 % 50 END", "balance": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"}
GAP = "coalesce(power(q.{0}-d.{0},2),0)"
SEEN = "(q.{0}-d.{0} IS NOT NULL)::INT"


@query("WITH p AS (SELECT c_custkey k, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in SPARSE.items()) + " FROM customer), g AS (SELECT q.k, d.k dk, d.balance t, " + " + ".join(GAP.format(c) for c in "abc")
       + " AS s, " + " + ".join(SEEN.format(c) for c in "abc") + """ AS n FROM p q, p d WHERE q.balance IS NULL AND d.balance IS NOT NULL),
  r AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY sqrt(s*(3/n)), dk) i FROM g WHERE n > 0), f AS (SELECT k, avg(t) v FROM r WHERE i <= least(5, (SELECT count(*)//20 FROM p)) GROUP BY 1)
  SELECT p.k AS c_custkey, round(coalesce(balance, v, (SELECT avg(balance) FROM p)),4) AS balance FROM p LEFT JOIN f USING (k)""")
def t4_impute_knn_sparse_helpers(spark, sf):
    """Three helpers with nulls in all combinations; a third of one helper is a single value."""
    t = table(spark, sf, "customer").select("c_custkey", *[F.expr(e).alias(c) for c, e in SPARSE.items()])
    return round_doubles(nb.impute_knn(t, "balance", ["a", "b", "c"], "c_custkey").select("c_custkey", "balance"))


@query()
def t9_isolation_forest(spark, sf):
    t = dirty_orders(spark, sf).select("o_orderkey", "price", F.col("o_orderkey").cast("double").alias("k"), F.dayofyear("o_orderdate").alias("d"))
    return ln.isolation_forest(t, ["price", "k", "d"], "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 7")
def t9_forest_of_planted_outliers(spark, sf):
    """One order in a hundred is far off in two columns; exactly those have the highest scores."""
    far = F.col("o_orderkey") % 100 == 7
    t = table(spark, sf, "orders").select("o_orderkey", F.when(far, F.col("o_totalprice") * 40 + 1e7).otherwise(F.col("o_totalprice")).alias("price"), F.when(far, -5000.0).otherwise(F.dayofyear("o_orderdate").cast("double")).alias("day"))
    scored = ln.isolation_forest(t, ["price", "day"], "o_orderkey", contamination=0.05)
    return scored.orderBy(F.desc("anomaly_score")).limit(t.filter(far).count()).select("o_orderkey")


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", *LI, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query()
def c13_pca_loadings(spark, sf):
    return round_doubles(ln.pca(lines(spark, sf), [*LI, "net"])[1])


@query()
def c13_pca_scores(spark, sf):
    return round_doubles(ln.pca(lines(spark, sf), [*LI, "net"])[0])


@query()
def c14_pca_importance(spark, sf):
    return round_doubles(ln.pca_importance(ln.pca(lines(spark, sf), [*LI, "net"])[1]))


@query()
def c16_forest_importance(spark, sf):
    return ln.forest_importance(lines(spark, sf), "net", LI)


# Closed forms: y = 2x has one component with equal loadings; a target that is twice a feature owes nothing to a constant.
def on_a_line(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (2 * F.col("l_quantity")).alias("y"), F.lit(1.0).alias("flat"))


@query("SELECT 1 AS component, c AS \"column\", 0.7071 AS loading, 1.0::DOUBLE AS explained_variance FROM (VALUES ('x'), ('y')) v(c)")
def c13_pca_loadings_of_a_line(spark, sf):
    return round_doubles(ln.pca(on_a_line(spark, sf), ["x", "y"])[1])


@query("SELECT l_orderkey, l_quantity AS x, round(sqrt(2)*(l_quantity - avg(l_quantity) OVER ())/stddev_pop(l_quantity) OVER (), 4) + 0.0 AS pc1 FROM lineitem")
def c13_pca_scores_of_a_line(spark, sf):
    return round_doubles(ln.pca(on_a_line(spark, sf), ["x", "y"])[0].select("l_orderkey", "x", "pc1"))


@query("SELECT c AS \"column\", 0.5::DOUBLE AS importance FROM (VALUES ('x'), ('y')) v(c)")
def c14_pca_importance_of_a_line(spark, sf):
    return round_doubles(ln.pca_importance(ln.pca(on_a_line(spark, sf), ["x", "y"])[1]))


@query("SELECT c AS \"column\", i::DOUBLE AS importance FROM (VALUES ('x', 1), ('flat', 0)) v(c, i)")
def c16_forest_importance_of_a_line(spark, sf):
    return round_doubles(ln.forest_importance(on_a_line(spark, sf), "y", ["x", "flat"]))


def three_centres(spark, sf):
    """Three far centres; every seventh row lacks one coordinate and is labelled all the same."""
    centre = F.col("c_custkey") % 3
    return table(spark, sf, "customer").select(
        "c_custkey", centre.alias("centre"), (centre * 100 + F.col("c_acctbal") / 1e5).alias("x"), (centre * centre * 100 + F.col("c_nationkey") / 1e3).alias("y"))


@query("SELECT c_custkey % 3 AS centre, count(*) AS n, 1::BIGINT AS clusters, 3::BIGINT AS all_clusters FROM customer GROUP BY 1")
def c20_kmeans_three_centres(spark, sf):
    labels, summary = ln.kmeans_auto(three_centres(spark, sf), ["x", "y"])
    every = summary.agg(F.count_distinct("cluster").alias("all_clusters"))
    return labels.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters")).join(F.broadcast(every), F.lit(True))


@query("SELECT count(*) AS n, count(*) AS labelled FROM customer")
def c20_kmeans_labels_rows_with_nulls(spark, sf):
    t = three_centres(spark, sf).withColumn("x", F.when(F.col("c_custkey") % 7 != 0, F.col("x")))
    return ln.kmeans_auto(t, ["x", "y"], max_k=3)[0].agg(F.count(F.lit(1)).alias("n"), F.count("cluster").alias("labelled"))


@query("SELECT 0 AS cluster, count(*) AS n, 1::BIGINT AS size_is_n, CAST(NULL AS DOUBLE) AS silhouette FROM customer")
def c20_kmeans_constant_rows(spark, sf):
    """Rows that are all equal are one cluster."""
    labels, summary = ln.kmeans_auto(table(spark, sf, "customer").select("c_custkey", F.lit(5.0).alias("x"), F.lit(None).cast("double").alias("y")), ["x", "y"])
    n = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    one = summary.groupBy("cluster").agg(F.max("size").alias("size"), F.max("silhouette").alias("silhouette"))
    return n.join(F.broadcast(one), "cluster").select("cluster", "n", (F.col("size") == F.col("n")).cast("long").alias("size_is_n"), "silhouette")


@query("SELECT true AS close, true AS importance_sums_to_one")
def c28_predict_regression_of_a_line(spark, sf):
    t = on_a_line(spark, sf).withColumn("row", F.xxhash64("l_orderkey", "x", F.monotonically_increasing_id()))
    _, metrics, importance = ln.predict(t, "row", "y", ["x"], "regression")
    return metrics.select((F.col("r2") > 0.9).alias("close")).join(importance.agg((F.abs(F.sum("importance") - 1) < 1e-6).alias("importance_sums_to_one")), F.lit(True))


@query("SELECT 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1")
def c28_predict_classification_of_a_rule(spark, sf):
    t = table(spark, sf, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice").alias("row"), "l_quantity", F.when(F.col("l_quantity") > 25, "many").otherwise("few").alias("size"))
    return round_doubles(ln.predict(t, "row", "size", ["l_quantity"], "classification")[1])


@query()
def c20_kmeans_summary(spark, sf):
    return round_doubles(ln.kmeans_auto(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])[1])


@query()
def c20_kmeans_labels(spark, sf):
    return ln.kmeans_auto(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])[0].select("c_custkey", "cluster")


# Density clusters on one axis have a closed form: core points of a run no two neighbours of which are further apart than eps.
@query("""WITH p AS (SELECT s_suppkey k, s_acctbal x FROM supplier), n AS (SELECT a.k, a.x, count(*) c FROM p a, p b WHERE abs(a.x-b.x) <= 100 GROUP BY 1,2),
  core AS (SELECT *, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 100 THEN 0 ELSE 1 END AS s FROM n WHERE c >= 4), run AS (SELECT k, x, sum(s) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) g FROM core),
  l AS (SELECT k, x, min(k) OVER (PARTITION BY g) lab FROM run), b AS (SELECT p.k, min(l.lab) lab FROM p JOIN l ON abs(p.x-l.x) <= 100 WHERE p.k NOT IN (SELECT k FROM l) GROUP BY 1)
  SELECT p.k AS s_suppkey, CAST(coalesce(l.lab, b.lab, -1) AS VARCHAR) AS cluster FROM p LEFT JOIN l USING (k) LEFT JOIN b USING (k)""")
def c21_dbscan(spark, sf):
    return ln.dbscan(table(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"], eps=100.0, min_samples=4, scale=False)


# Of two standardised columns the components are their sum and difference over the root of two.
@query("""WITH t AS (SELECT c_custkey, c_custkey % 3 AS centre, (c_custkey % 3) * 100 + c_acctbal / 1e5 AS x, (c_custkey % 3) * (c_custkey % 3) * 100 + c_nationkey / 1e3 AS y FROM customer),
  z AS (SELECT c_custkey, centre, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS a, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS b FROM t)
  SELECT centre, count(*) AS n, 1::BIGINT AS clusters, round(avg((a+b)/sqrt(2)),4) AS pc1, round(avg(abs(a-b)/sqrt(2)),4) AS pc2 FROM z GROUP BY 1""")
def c22_projection_of_three_centres(spark, sf):
    labels, _ = ln.kmeans_auto(three_centres(spark, sf), ["x", "y"])
    flat = ln.cluster_projection(labels, ["x", "y"], n=labels.count(), key="c_custkey")
    return round_doubles(flat.groupBy((F.col("c_custkey") % 3).alias("centre")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"), F.avg("pc1").alias("pc1"), F.avg(F.abs("pc2")).alias("pc2")))


@query("SELECT p_partkey, CAST(min(p_partkey) OVER (PARTITION BY p_partkey // 1000) AS VARCHAR) AS cluster FROM part")
def c21_dbscan_chain(spark, sf):
    """A thousand cells in a row, each linked to the next only; then a gap."""
    t = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 0.9 + F.floor(F.col("p_partkey") / 1000) * 50).alias("x"))
    return ln.dbscan(t, "p_partkey", ["x"], eps=1.0, min_samples=2, scale=False)


@query()
def c22_cluster_projection(spark, sf):
    labels, _ = ln.kmeans_auto(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return round_doubles(ln.cluster_projection(labels, ["c_acctbal", "c_nationkey"], key="c_custkey"))


def regression(spark, sf):
    return ln.predict(lines(spark, sf).withColumn("row", F.xxhash64(*LI, "l_orderkey")), "row", "net", LI, "regression")


@query()
def c28_predict_regression_metrics(spark, sf):
    return regression(spark, sf)[1]


@query()
def c28_predict_classification_metrics(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("row", F.xxhash64(*LI, "l_orderkey"))
    return ln.predict(t, "row", "l_returnflag", ["l_quantity", "l_tax", "l_linestatus"], "classification")[1]


@query("""WITH p AS (SELECT l_linestatus a, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END b, count(*) n FROM lineitem GROUP BY 1,2)
  SELECT x AS actual, y AS predicted, coalesce(n,0) AS n FROM (SELECT unnest(['F','O']) x) CROSS JOIN (SELECT unnest(['F','O']) y) LEFT JOIN p ON a = x AND b = y""")
def c29_confusion_matrix(spark, sf):
    return ln.confusion_matrix(table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("actual"), F.when(F.col("l_quantity") > 25, "F").otherwise("O").alias("predicted")))


@query("SELECT c_custkey, c_acctbal AS actual, 5000.0 + c_nationkey AS predicted, round(c_acctbal - (5000.0 + c_nationkey),4) AS error FROM customer")
def c30_actual_vs_predicted(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("actual"), (F.lit(5000.0) + F.col("c_nationkey")).alias("predicted"))
    return round_doubles(ln.actual_vs_predicted(t, "c_custkey"))


@query("""SELECT round(1 - sum(e*e)/(var_pop(c_acctbal)*count(*)),4) AS r2, round(avg(abs(e)),4) AS mae, round(sqrt(avg(e*e)),4) AS rmse FROM (SELECT c_acctbal, c_acctbal - 5000.0 AS e FROM customer)""")
def c30_regression_metrics(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_acctbal").alias("actual"), F.lit(5000.0).alias("predicted"))
    return round_doubles(ln.regression_metrics(t))
