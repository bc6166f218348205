"""Queries for cleaning and preparation."""
from pyspark.sql import functions as F

from . import query, table
from .planted import CLEAN_SQL, CONTACT_SQL, contacts, dirty_orders
from ..operators import clean as c
from ..operators.common import round_doubles
from ..operators.roles import infer_roles

BASE = f"WITH t AS {CLEAN_SQL}"


def dirty(spark, sf, *cols):
    return dirty_orders(spark, sf).select("o_orderkey", *cols)


@query(BASE + """, n AS (SELECT count(*) n, count(*)-count(price) a, count(*)-count(half) b, count(*)-count(amount) e, count(*)-count(sparse) d, count(*)-count(status) f, count(*)-count(day) g, count(*)-count(flag) h FROM t)
  SELECT 'price' AS "column", a AS nulls, round(100.0*a/n,4) AS percent, 'median_impute' AS action, NULL AS value FROM n UNION ALL SELECT 'half', b, round(100.0*b/n,4), 'fill_value', '-999' FROM n
  UNION ALL SELECT 'amount', e, round(100.0*e/n,4), 'fill_value', '0' FROM n UNION ALL SELECT 'sparse', d, round(100.0*d/n,4), 'drop_column', NULL FROM n UNION ALL SELECT 'status', f, round(100.0*f/n,4), 'fill_value', 'Unknown' FROM n
  UNION ALL SELECT 'day', g, round(100.0*g/n,4), 'median_date_impute', NULL FROM n UNION ALL SELECT 'flag', h, round(100.0*h/n,4), 'fill_value', 'Unknown' FROM n""")
def t1_null_plan(spark, sf):
    t = dirty(spark, sf, "price", "half", "amount", "sparse", "status", "day", "flag")
    return round_doubles(c.null_plan(t, infer_roles(t)).drop("helpers"))


@query(BASE + " SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM t)) AS price, coalesce(half, (SELECT median(half) FROM t)) AS half FROM t")
def t2_impute_median(spark, sf):
    return c.impute_median(dirty(spark, sf, "price", "half"), ["price", "half"])


@query(BASE + " SELECT o_orderkey, coalesce(status, (SELECT status FROM t WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM t")
def t3_impute_mode(spark, sf):
    return c.impute_mode(dirty(spark, sf, "status"), ["status"])


@query(BASE + " SELECT o_orderkey, coalesce(day, (SELECT make_timestamp(CAST(floor(median(epoch_us(day))) AS BIGINT)) FROM t)) AS day FROM t")
def t5_impute_median_date(spark, sf):
    return c.impute_median_date(dirty(spark, sf, "day"), ["day"])


@query(BASE + " SELECT o_orderkey, coalesce(status,'Unknown') AS status, coalesce(half,-999) AS half, coalesce(amount,0) AS amount FROM t")
def t6_fill_constant(spark, sf):
    return c.fill_constant(dirty(spark, sf, "status", "half", "amount"), {"status": "Unknown", "half": -999, "amount": 0})


@query(BASE + """ SELECT 'o_orderkey' AS "column", 0::BIGINT AS nulls_before, 0::DOUBLE AS nulls_after, 'none' AS action UNION ALL SELECT 'half', count(*)-count(half), 0, 'fill_value' FROM t UNION ALL SELECT 'sparse', count(*)-count(sparse), NULL, 'drop_column' FROM t
  UNION ALL SELECT 'day', count(*)-count(day), 0, 'median_date_impute' FROM t""")
def t7_null_report(spark, sf):
    t = dirty(spark, sf, "half", "sparse", "day")
    plan = c.null_plan(t, infer_roles(t))
    return c.null_report(t, c.apply_null_plan(t, plan), plan).withColumn("nulls_after", F.col("nulls_after").cast("double"))


@query(BASE + ", q AS (SELECT quantile_cont(price,.25) a, quantile_cont(price,.75) b FROM t) SELECT o_orderkey, CASE WHEN price IS NOT NULL THEN round(greatest(a-3*(b-a), least(b+3*(b-a), price)),4) END AS price FROM t, q")
def t8_clip_iqr(spark, sf):
    return round_doubles(c.clip_iqr(dirty(spark, sf, "price"), ["price"]))


@query(BASE + " SELECT o_orderkey, CASE trim(flag) WHEN 'Yes' THEN true WHEN 'no' THEN false END AS flag FROM t")
def t10_to_boolean(spark, sf):
    return c.to_boolean(dirty(spark, sf, "flag"), ["flag"])


@query(f"SELECT c_custkey, CASE lower(agreed) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END::TINYINT AS agreed FROM {CONTACT_SQL}")
def t11_to_binary(spark, sf):
    return c.to_binary(contacts(spark, sf).select("c_custkey", "agreed"), ["agreed"])


@query("""SELECT 'l_linestatus' AS "column", count(DISTINCT l_linestatus) AS distinct_values, 'binary' AS method FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), 'one_hot' FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), 'label' FROM lineitem""")
def t12_encoding_plan(spark, sf):
    return c.encoding_plan(table(spark, sf, "lineitem"), ["l_linestatus", "l_returnflag", "l_partkey"])


@query(BASE + """ SELECT o_orderkey, coalesce(CAST(status='F' AS INT),0) AS "status_F", coalesce(CAST(status='O' AS INT),0) AS "status_O", coalesce(CAST(status='P' AS INT),0) AS "status_P" FROM t""")
def t13_one_hot(spark, sf):
    return c.one_hot(dirty(spark, sf, "status"), ["status"])


@query(BASE + ", v AS (SELECT DISTINCT coalesce(status,'unknown_category') AS s FROM t), k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS code FROM v) SELECT o_orderkey, code AS status FROM t JOIN k ON coalesce(status,'unknown_category') = s")
def t14_label_encode(spark, sf):
    return c.label_encode(dirty(spark, sf, "status"), ["status"])


@query("SELECT l_orderkey, l_partkey, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END::INTEGER AS l_linestatus FROM lineitem")
def t15_binary_encode(spark, sf):
    return c.binary_encode(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus"), ["l_linestatus"])


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer))/(SELECT stddev_pop(c_acctbal) FROM customer),4) + 0.0 AS c_acctbal FROM customer")
def t16_standardize(spark, sf):
    return round_doubles(c.standardize(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer))/(SELECT max(c_acctbal)-min(c_acctbal) FROM customer),4) AS c_acctbal FROM customer")
def t17_min_max(spark, sf):
    return round_doubles(c.min_max(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query(BASE + " SELECT o_orderkey, try_cast(replace(replace(price_text, ',', '.'), ' ', '') AS DOUBLE) AS price_text, status FROM t")
def t18_parse_numeric(spark, sf):
    return c.parse_numeric(dirty(spark, sf, "price_text", "status"), ["price_text", "status"])


@query("""WITH w AS (SELECT greatest(3, count(*)//100) AS w FROM events), e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i, sum(value) OVER (ORDER BY ts, event_id) AS s FROM events)
  SELECT e.event_id, round(CASE WHEN hi.i IS NOT NULL AND (lo.i IS NOT NULL OR e.i - w//2 = 1) THEN (hi.s - coalesce(lo.s, 0))/w ELSE e.value END, 4) AS value FROM e, w
  LEFT JOIN e hi ON hi.i = e.i + (w - 1 - w//2) LEFT JOIN e lo ON lo.i = e.i - w//2 - 1""")
def t19_moving_average(spark, sf):
    return round_doubles(c.moving_average(table(spark, sf, "events").select("event_id", "ts", "value"), ["value"], ["ts", "event_id"]).select("event_id", "value"))


@query("""WITH e AS (SELECT event_id, event_type, value, row_number() OVER x AS i, sum(value) OVER x AS s, greatest(3, count(*) OVER (PARTITION BY event_type) // 100) AS w FROM events WINDOW x AS (PARTITION BY event_type ORDER BY ts, event_id))
  SELECT e.event_id, round(CASE WHEN hi.i IS NOT NULL AND (lo.i IS NOT NULL OR e.i - e.w//2 = 1) THEN (hi.s - coalesce(lo.s, 0))/e.w ELSE e.value END, 4) AS value FROM e
  LEFT JOIN e hi ON hi.event_type = e.event_type AND hi.i = e.i + (e.w - 1 - e.w//2) LEFT JOIN e lo ON lo.event_type = e.event_type AND lo.i = e.i - e.w//2 - 1""")
def t19_moving_average_grouped(spark, sf):
    t = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return round_doubles(c.moving_average(t, ["value"], ["ts", "event_id"], ["event_type"]).select("event_id", "value"))


@query("""WITH RECURSIVE e AS (SELECT event_id, value, event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT event_id, k, i, value AS y FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.k, e.i, 0.1*e.value + 0.9*r.y FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1) SELECT event_id, round(y,4) AS value_smooth FROM r""")
def t20_exp_smooth(spark, sf):
    return round_doubles(c.exp_smooth(table(spark, sf, "events"), "value", ["ts", "event_id"], ["event_type"]).select("event_id", "value_smooth"))


@query()
def t21_wavelet_denoise(spark, sf):
    return round_doubles(c.wavelet_denoise(table(spark, sf, "events").select("event_id", "event_type", "ts", "value"), "value", ["ts", "event_id"], ["event_type"]))


@query()
def clean_table(spark, sf):
    return c.clean(dirty(spark, sf, "price", "half", "sparse", "status", "day", "flag"), "o_orderkey")


@query()
def clean_for_modeling(spark, sf):
    return c.clean(contacts(spark, sf).select("c_custkey", "segment", "agreed", "grade", "balance"), "c_custkey", for_modeling=True)
