"""Queries for readers and writers: each writes a table out and reads it back."""
from pyspark.sql import functions as F

from . import query, table
from ..sources import io


def written(spark, sf, name, write):
    path = io.scratch_folder(spark)
    write(table(spark, sf, name), path)
    return path


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s1_read_csv(spark, sf):
    path = written(spark, sf, "customer", lambda t, p: t.write.csv(p, header=True, sep=";"))
    return io.read_csv(spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT page_id, url, length(html) AS n FROM pages")
def s2_read_json(spark, sf):
    path = written(spark, sf, "pages", lambda t, p: t.write.json(p))
    return io.read_json(spark, path).select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("SELECT * FROM part")
def s3_read_parquet(spark, sf):
    return io.read_parquet(spark, f"{sf}/part.parquet")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s4_parse_json_documents(spark, sf):
    return io.parse_documents(table(spark, sf, "events").select("event_id", "props"), "props").drop("props")


@query("SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS _c0, s_name AS _c1, s_acctbal AS _c2 FROM supplier")
def s4_parse_csv_documents(spark, sf):
    t = table(spark, sf, "supplier").select("s_suppkey", F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string")).alias("doc"))
    return io.parse_documents(t, "doc", "csv").drop("doc")


@query("""SELECT 'r_regionkey' AS "column", 0 AS position, 'int' AS type, false AS has_nulls, count(*) AS "rows", true AS candidate_key FROM region UNION ALL SELECT 'r_name', 1, 'string', false, count(*), true FROM region""")
def s5_describe_table(spark, sf):
    return io.describe_table(table(spark, sf, "region"))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def s6_table_sample(spark, sf):
    return io.table_sample(table(spark, sf, "orders"), "o_orderkey")


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation")
def s7_append(spark, sf):
    path = io.scratch_folder(spark)
    for _ in range(2):
        io.append(table(spark, sf, "nation"), path)
    return spark.read.parquet(path)


@query("SELECT item_id, text, CASE WHEN item_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM benchmark")
def s8_write_jsonl(spark, sf):
    path = io.scratch_folder(spark)
    t = table(spark, sf, "benchmark").withColumn("split", F.when(F.col("item_id") % 10 == 0, "test").otherwise("train"))
    io.write_jsonl(t, path, "split")
    return io.read_json(spark, path).select("item_id", "text", "split")


@query("""SELECT c_mktsegment AS segment, count(*) AS n, 'b' AS dataset_id FROM customer GROUP BY 1
   UNION ALL SELECT c_mktsegment, 2*count(*), 'a' FROM customer GROUP BY 1""")
def s9_save_report(spark, sf):
    path = io.scratch_folder(spark)
    counts = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    for dataset, factor in (("a", 1), ("b", 1), ("a", 2)):
        io.save_report({"columns": counts.withColumn("n", F.col("n") * factor)}, path, dataset)
    return spark.read.parquet(f"{path}/columns")


@query("SELECT o_orderkey AS \"oOrderkey\", o_totalprice AS \"oTotalprice\", {'oOrderstatus': o_orderstatus, 'nItems': 1} AS \"orderInfo\" FROM orders")
def s10_rename_keys(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.struct("o_orderstatus", F.lit(1).alias("n_items")).alias("order_info"))
    return io.rename_keys(t, "camel")


@query("SELECT o_orderkey, o_totalprice, {'o_orderstatus': o_orderstatus} AS order_info FROM orders")
def s10_rename_keys_snake(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("oOrderkey"), F.col("o_totalprice").alias("oTotalprice"), F.struct(F.col("o_orderstatus").alias("oOrderstatus")).alias("orderInfo"))
    return io.rename_keys(t, "snake")
