"""Inputs derived from the supplied tables by one expression that Spark and SQL both read."""
from pyspark.sql import functions as F

from . import table

CONTACT = {
    "c_custkey": "c_custkey",
    "box": "CASE WHEN c_custkey % 25 = 0 THEN 'not given' ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END",
    "call_me": "concat('090-', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))",
    "home": "concat(CAST(c_custkey % 500 + 1 AS STRING), ' main street, hanoi, vn')",
    "bracket": "CASE WHEN c_custkey % 10 < 6 THEN concat(CAST(c_custkey % 50 AS STRING), ' - ', CAST(c_custkey % 50 + 10 AS STRING)) ELSE 'open' END",
    "person": "CASE c_custkey % 3 WHEN 0 THEN 'Anna Smith' WHEN 1 THEN 'Bob Lee Jr' ELSE 'Chi Tran' END",
    "page": "concat('http://example.com/', CAST(c_custkey AS STRING))",
    "pronoun": "CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' ELSE 'other' END",
    "segment": "CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END",
    "agreed": "CASE WHEN c_custkey % 4 = 0 THEN 'No' ELSE 'yes' END",
    "grade": "CAST(c_custkey % 5 + 1 AS INT)",
    "balance": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END",
    "note": "concat('case {', CAST(c_custkey AS STRING), '}, open; see file')",
}
CONTACT_TEXT = ["box", "call_me", "home", "bracket", "person", "page", "pronoun", "segment", "agreed", "note"]
CONTACT_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in CONTACT.items()) + " FROM customer)"

CLEAN = {
    "o_orderkey": "o_orderkey", "o_orderdate": "o_orderdate",
    "price": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN o_totalprice * 100 ELSE o_totalprice END",
    "half": "CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_totalprice END",
    "amount": "CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_totalprice END",
    "sparse": "CASE WHEN o_orderkey % 10 < 9 THEN NULL ELSE o_totalprice END",
    "status": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END",
    "day": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END",
    "flag": "CASE WHEN o_orderkey % 3 = 0 THEN ' Yes' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'no' END",
    "priority": "o_orderpriority",
    "price_text": "CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE replace(CAST(CAST(floor(o_totalprice) AS INT) AS STRING), '1', ',') END",
}
CLEAN_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in CLEAN.items()) + " FROM orders)"

MIXED_DATE = """CASE o_orderkey % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN CAST({3} AS STRING) ELSE CAST({4} AS STRING) END"""
MIXED_SPARK = MIXED_DATE.format("date_format(o_orderdate,'yyyy-MM-dd')", "date_format(o_orderdate,'dd/MM/yyyy')", "date_format(o_orderdate,'dd-MMM-yy')",
                                "unix_seconds(o_orderdate)", "datediff(o_orderdate, DATE'1899-12-30')")
MIXED_SQL = MIXED_DATE.format("strftime(o_orderdate,'%Y-%m-%d')", "strftime(o_orderdate,'%d/%m/%Y')", "strftime(o_orderdate,'%d-%b-%y')",
                              "CAST(epoch(o_orderdate) AS BIGINT)", "date_diff('day', DATE '1899-12-30', o_orderdate)")


def contacts(spark, sf):
    return table(spark, sf, "customer").select(*[F.expr(e).alias(c) for c, e in CONTACT.items()])


def dirty_orders(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return orders.select(*[F.expr(e).alias(c) for c, e in CLEAN.items()])


def doubled(df, key):
    """The table with a copy of every 20th row."""
    return df.unionByName(df.filter(F.col(key) % 20 == 0))


def mixed_dates(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", "o_orderdate", F.expr(MIXED_SPARK).alias("stamp"))
