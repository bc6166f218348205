"""Queries for projection, predicates, joins, sampling and set operations."""
from pyspark.sql import functions as F

from . import query, table
from .planted import CLEAN_SQL, dirty_orders, doubled
from ..operators import relational as r
from ..operators.common import round_doubles
from ..operators.profile import crosstab


@query("SELECT o_orderkey, o_totalprice FROM orders")
def p1_select_valid(spark, sf):
    return r.select_valid(table(spark, sf, "orders"), ["o_orderkey", "no_such_column", "o_totalprice"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F','P') AND o_totalprice > 1000 AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10""")
def p2_select_where(spark, sf):
    return r.select_where(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], {"o_orderstatus": ["F", "P"], "o_totalprice": {">": 1000}, "o_orderpriority": "1-URGENT"},
                          ["o_totalprice desc", "o_orderkey"], 50, 10)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def p3_update_where(spark, sf):
    return r.update_where(table(spark, sf, "orders"), {"o_orderstatus": "X", "o_orderpriority": None}, {"o_orderstatus": "P"}).select("o_orderkey", "o_orderstatus")


@query(f"SELECT o_orderkey, status FROM {CLEAN_SQL} WHERE status IS NULL OR status <> 'F'")
def p4_delete_where(spark, sf):
    return r.delete_where(dirty_orders(spark, sf), {"status": "F"}).select("o_orderkey", "status")


@query("SELECT c_custkey AS customer_key, c_name AS name, c_acctbal AS col_2nd_balance, c_mktsegment AS name_2, c_nationkey AS column_4 FROM customer")
def p5_normalize_names(spark, sf):
    return r.normalize_names(table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Customer Key"), F.col("c_name").alias("Name!"), F.col("c_acctbal").alias("2nd Balance"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("??")))


def with_copies(spark, sf):
    c = table(spark, sf, "customer")
    return c.withColumns({"copy": F.col("c_acctbal"), "near_copy": F.when(F.col("c_custkey") == 7, 0.5).otherwise(F.col("c_acctbal")), "seg_copy": F.col("c_mktsegment")})


@query("SELECT 'copy' AS \"column\", 'c_acctbal' AS original UNION ALL SELECT 'seg_copy', 'c_mktsegment'")
def p6_duplicate_columns(spark, sf):
    return r.duplicate_columns(with_copies(spark, sf))


@query("SELECT *, CASE WHEN c_custkey = 7 THEN 0.5 ELSE c_acctbal END AS near_copy FROM customer")
def p6_drop_duplicate_columns(spark, sf):
    return r.drop_duplicate_columns(with_copies(spark, sf))


@query(f"SELECT o_orderkey, price, half, status FROM {CLEAN_SQL}")
def p7_drop_sparse_columns(spark, sf):
    return r.drop_sparse_columns(dirty_orders(spark, sf).select("o_orderkey", "price", "half", "sparse", "status"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def p8_search(spark, sf):
    return r.search(table(spark, sf, "part"), ["p_name", "p_type"], "RING").select("p_partkey", "p_name")


@query("SELECT 'l_extendedprice' AS a, 'net' AS b, round(corr(l_extendedprice, l_extendedprice*(1-l_discount)),4) AS r FROM lineitem")
def p9_filter_pairs(spark, sf):
    from ..operators.statistics import pearson
    return round_doubles(r.filter_pairs(pearson(table(spark, sf, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)")), ["l_extendedprice", "net", "l_tax"])))


@query(f"""SELECT 'price' AS "column", true AS present, 'numeric' AS kind, 0::DOUBLE AS n_failed, true AS ok UNION ALL SELECT 'status', true, 'categorical', 0, true
   UNION ALL SELECT 'price_text', true, 'numeric', count(*) FILTER (WHERE price_text IS NOT NULL AND try_cast(price_text AS DOUBLE) IS NULL), false FROM {CLEAN_SQL}
   UNION ALL SELECT 'absent', false, 'datetime', NULL, false""")
def p10_conformance(spark, sf):
    return r.conformance(dirty_orders(spark, sf), {"price": "numeric", "status": "categorical", "price_text": "numeric", "absent": "datetime"}).withColumn("n_failed", F.col("n_failed").cast("double"))


@query("SELECT l_orderkey::INT AS l_orderkey, l_linenumber::TINYINT AS l_linenumber, l_suppkey::SMALLINT AS l_suppkey, l_quantity FROM lineitem")
def p11_narrow_types(spark, sf):
    return r.narrow_types(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), {"l_orderkey": "int", "l_suppkey": "smallint"})


@query("""SELECT 'l_linenumber' AS "column", 'int8' AS advice UNION ALL SELECT 'l_quantity', 'two_decimals' UNION ALL SELECT 'l_extendedprice', 'two_decimals' UNION ALL SELECT 'l_discount', 'two_decimals' UNION ALL SELECT 'l_tax', 'two_decimals'""")
def p12_narrowing_advice(spark, sf):
    return r.narrowing_advice(table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query("""SELECT n_nationkey, n_name, c_custkey::DOUBLE AS c_custkey, NULL::DOUBLE AS s_suppkey, 'customers' AS child FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 0
   UNION ALL SELECT n_nationkey, n_name, NULL, s_suppkey, 'suppliers' FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey""")
def j1_with_children(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return r.with_children(table(spark, sf, "nation").select("n_nationkey", "n_name"), {"customers": c, "suppliers": s}, "n_nationkey").select("n_nationkey", "n_name", F.col("c_custkey").cast("double").alias("c_custkey"), F.col("s_suppkey").cast("double").alias("s_suppkey"), "child")


@query("""SELECT a.d AS date_column, a.v AS value_column, n, total FROM (SELECT o_orderdate d, o_orderstatus v, count(*) n FROM orders GROUP BY 1,2) a LEFT JOIN
   (SELECT o_orderdate d, o_orderstatus v, round(sum(o_totalprice),2) total FROM orders WHERE o_totalprice > 200000 GROUP BY 1,2) b ON a.d=b.d AND a.v=b.v""")
def j2_attach_forecasts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("date_column"), F.col("o_orderstatus").alias("value_column"), "o_totalprice")
    a = o.groupBy("date_column", "value_column").agg(F.count(F.lit(1)).alias("n"))
    b = o.filter("o_totalprice > 200000").groupBy("date_column", "value_column").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return r.attach_forecasts(a, b)


ERRORS = "(SELECT user_id, ts, event_id AS err_id, value AS err_value FROM events WHERE event_type = 'error')"


@query(f"SELECT e.event_id, err_id::DOUBLE AS err_id, err_value FROM events e ASOF LEFT JOIN {ERRORS} x ON e.user_id = x.user_id AND e.ts >= x.ts")
def j3_asof_join(spark, sf):
    e = table(spark, sf, "events")
    errors = e.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").cast("double").alias("err_id"), F.col("value").alias("err_value"))
    return r.asof_join(e.select("event_id", "user_id", "ts"), errors, "ts", ["user_id"], right_key="err_id", left_key="event_id").select("event_id", "err_id", "err_value")


@query(f"SELECT e.event_id, err_id::DOUBLE AS err_id FROM events e ASOF LEFT JOIN {ERRORS} x ON e.ts <= x.ts")
def j3_asof_join_forward(spark, sf):
    e = table(spark, sf, "events")
    errors = e.filter("event_type = 'error'").select("ts", F.col("event_id").cast("double").alias("err_id"))
    return r.asof_join(e.select("event_id", "ts"), errors, "ts", direction="forward", right_key="err_id", left_key="event_id").select("event_id", "err_id")


@query("SELECT o_orderkey, l_linenumber AS line, quantity FROM orders, (SELECT l_linenumber + 8 AS l_linenumber, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 1)")
def j3_asof_ties(spark, sf):
    """Right rows of one time, keys 9 to 15: the largest number counts, not the last in the alphabet."""
    o = table(spark, sf, "orders").select("o_orderkey", F.lit(1).alias("at"))
    lines = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") + 8).alias("line")).agg(F.avg("l_quantity").alias("quantity")).withColumn("at", F.lit(0))
    return r.asof_join(o, lines, "at", right_key="line", left_key="o_orderkey").select("o_orderkey", "line", "quantity")


@query("""SELECT 'l_quantity' AS a, 'l_tax' AS b, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*) FROM lineitem UNION ALL SELECT 'l_tax', 'l_discount', count(*) FROM lineitem""")
def j4_column_pairs(spark, sf):
    from ..operators.statistics import column_pairs, pair_table
    return pair_table(table(spark, sf, "lineitem"), column_pairs(["l_quantity", "l_tax", "l_discount"]), {"n": lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))})


@query("SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse' WHEN 'purchase' THEN 'buy' ELSE 'unknown' END AS mapped FROM events")
def j5_map_labels(spark, sf):
    return r.map_labels(table(spark, sf, "events").select("event_id", "event_type"), "event_type", {"click": "browse", "view": "browse", "purchase": "buy"})


KEYS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey")]


@query(" UNION ALL ".join(
    f"""SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column WHERE NOT EXISTS (SELECT 1 FROM {ct} WHERE {cc} NOT IN (SELECT {pc} FROM {pt}))
      AND (SELECT count(*) = count(DISTINCT {pc}) FROM {pt})""" for ct, cc in KEYS for pt, pc in KEYS if ct != pt))
def j6_fk_candidates(spark, sf):
    return r.fk_candidates({n: table(spark, sf, n) for n in ("region", "nation", "supplier")})


LINKS = "(SELECT o_orderpriority AS source, o_orderstatus AS target FROM orders UNION ALL SELECT o_orderstatus, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def links(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target"))
    b = o.join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderstatus").alias("source"), F.col("l_returnflag").alias("target"))
    return a.unionByName(b)


@query(f"""SELECT node, CASE WHEN max(s)=1 AND max(t)=1 THEN 'both' WHEN max(s)=1 THEN 'source' ELSE 'target' END AS side FROM (SELECT source AS node, 1 s, 0 t FROM {LINKS} UNION ALL SELECT target, 0, 1 FROM {LINKS}) GROUP BY 1""")
def j7_link_endpoints(spark, sf):
    return r.link_endpoints(links(spark, sf))


@query("SELECT event_id AS task, unnest([event_id - 1, event_id - user_id]) AS depends_on FROM events")
def j9_dependency_edges(spark, sf):
    t = table(spark, sf, "events").select("event_id", F.array(F.col("event_id") - 1, F.col("event_id") - F.col("user_id")).alias("deps"))
    return r.dependency_edges(t, "event_id", "deps")


@query("""SELECT c AS "column", CASE c WHEN 's_acctbal' THEN (SELECT round(avg(s_acctbal),4) FROM supplier) WHEN 's_suppkey' THEN (SELECT round(avg(s_suppkey),4) FROM supplier) END AS mean FROM unnest(['s_suppkey','s_name','s_acctbal']) u(c)""")
def j10_attach_stats(spark, sf):
    from ..operators.common import as_double, metric_table
    s = table(spark, sf, "supplier")
    cols = spark.createDataFrame([("s_suppkey",), ("s_name",), ("s_acctbal",)], "column string")
    return round_doubles(r.attach_stats(cols, metric_table(s, ["s_suppkey", "s_acctbal"], {"mean": lambda c: F.avg(as_double(c))})))


@query("SELECT c_custkey, c_acctbal FROM customer")
def l1_sort_by(spark, sf):
    return r.sort_by(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", True, "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def l2_top_k(spark, sf):
    return r.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


HASH = lambda key: f"CAST(concat('0x', substr(md5(concat(CAST({key} AS VARCHAR), ':42')), 1, 15)) AS BIGINT)"


@query(f"SELECT o_orderkey FROM orders ORDER BY {HASH('o_orderkey')} LIMIT 500")
def l3_sample_n(spark, sf):
    return r.sample_n(table(spark, sf, "orders").select("o_orderkey"), 500, "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i % (n//100) = 0 AND i < (n//100)*100")
def l4_sample_systematic(spark, sf):
    return r.sample_systematic(table(spark, sf, "orders"), 100, ["o_totalprice", "o_orderkey"]).select("o_orderkey")


@query(f"""SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {HASH("concat(l_orderkey,'/',l_partkey,'/',l_linenumber,'/',l_extendedprice,'/',l_suppkey)")}) AS i, count(*) OVER (PARTITION BY l_returnflag) AS s, count(*) OVER () AS n FROM lineitem) WHERE i <= ceil(s * (3000.0/n))""")
def l5_sample_stratified(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", F.concat_ws("/", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_suppkey"))
    return r.sample_stratified(li, 3000, "l_returnflag", "k").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i % (n//200) = 0 AND i < (n//200)*200")
def l6_sample_over_time(spark, sf):
    return r.sample_over_time(table(spark, sf, "events"), 200, "ts", "event_id").select("event_id")


@query("""SELECT min(o_orderkey) AS o_orderkey FROM orders, (SELECT min(o_custkey) x0, max(o_custkey) x1, min(o_totalprice) y0, max(o_totalprice) y1 FROM orders)
   GROUP BY least(floor((o_custkey-x0)*20/(x1-x0)),19), least(floor((o_totalprice-y0)*20/(y1-y0)),19)""")
def l7_sample_grid(spark, sf):
    return r.sample_grid(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 400, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 0")
def l8_every_kth(spark, sf):
    return r.every_kth(table(spark, sf, "orders"), 7, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 20 OFFSET 40")
def l9_page(spark, sf):
    return r.page(table(spark, sf, "conversations"), ["conv_id", "turn"], 3, 20).select("conv_id", "turn", "role")


@query('SELECT count(*) AS "rows", CAST(ceil(count(*)/20) AS BIGINT) AS pages FROM conversations')
def l9_page_count(spark, sf):
    return r.page_count(table(spark, sf, "conversations"), 20)


@query("""WITH f AS (SELECT user_id, min(ts) a, CASE WHEN user_id % 2 = 0 THEN max(ts) END b FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
   SELECT user_id, 'uploaded' AS event, a AS at FROM f UNION ALL SELECT user_id, 'analyzed', b FROM f WHERE b IS NOT NULL""")
def l10_activity_feed(spark, sf):
    f = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.when(F.col("user_id") % 2 == 0, F.max("ts")).alias("b"))
    return r.activity_feed(f, "a", "b", "user_id")


@query("SELECT o_custkey, first(o_orderkey ORDER BY s, o_orderkey) AS o_orderkey, first(s ORDER BY s, o_orderkey) AS s FROM (SELECT o_custkey, o_orderkey, 1 AS s FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders) GROUP BY 1")
def u1_union_dedupe(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    first = o.filter("o_orderstatus = 'F'").drop("o_orderstatus").withColumn("s", F.lit(1))
    return r.union_dedupe([first, o.drop("o_orderstatus").withColumn("s", F.lit(2))], "o_custkey")


@query("SELECT o_orderkey, coalesce(o_totalprice > 400000, false) OR o_orderstatus = 'P' AS flagged FROM orders")
def u2_union_flags(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 400000).alias("a"), (F.col("o_orderstatus") == "P").alias("b"))
    return r.union_flags(t, ["a", "b"]).select("o_orderkey", "flagged")


@query("""WITH c AS (SELECT p_brand AS v, count(*) n, row_number() OVER (ORDER BY count(*) DESC, p_brand) i FROM part GROUP BY 1)
   SELECT CASE WHEN i <= 11 THEN v ELSE 'Others' END AS value, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def u3_top_with_others(spark, sf):
    return r.top_with_others(table(spark, sf, "part"), "p_brand", 12)


@query("SELECT text, min(doc_id) AS position FROM documents GROUP BY 1")
def u4_ordered_distinct(spark, sf):
    return r.ordered_distinct(table(spark, sf, "documents"), "text", "doc_id")


@query("SELECT DISTINCT source FROM documents")
def u5_distinct_values(spark, sf):
    return r.distinct_values(table(spark, sf, "documents"), "source")


@query(f"SELECT doc_id, CASE WHEN {HASH('doc_id')} < {int(0.9 * (1 << 60))} THEN 'train' ELSE 'test' END AS part FROM documents")
def u6_split(spark, sf):
    a, b = r.split(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@query("SELECT doc_id::DOUBLE AS doc_id, text, lang, NULL::DOUBLE AS item_id FROM documents UNION ALL SELECT NULL, text, NULL, item_id FROM benchmark")
def u7_concat(spark, sf):
    return r.concat([table(spark, sf, "documents").select(F.col("doc_id").cast("double").alias("doc_id"), "text", "lang"), table(spark, sf, "benchmark").select(F.col("item_id").cast("double").alias("item_id"), "text")])


@query("SELECT c_mktsegment, round(sum(o_totalprice),1) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def f1_run_sql(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("orders", "customer")}
    return r.run_sql(spark, tables, "SELECT c_mktsegment, round(sum(o_totalprice),1) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


@query("SELECT l_returnflag, quantile_cont(l_quantity,.25) AS q1, quantile_cont(l_quantity,.75) AS q3, max(l_tax) AS top FROM lineitem GROUP BY 1")
def f2_user_aggregates(spark, sf):
    return r.user_aggregates(table(spark, sf, "lineitem"), ["l_returnflag"], {"q1": "percentile(l_quantity, 0.25)", "q3": "percentile(l_quantity, 0.75)", "top": "max(l_tax)"})
