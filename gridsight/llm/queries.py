"""The registered queries of the corpus operators, and their SQL where SQL can say it."""
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, exact_dedup, lexical, line_dedup, mixing, nearest, quality_rules, repair, simhash, token_files, toxicity, urls, warc
from .sql import SQL

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_mix_sources(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    planned = mixing.plan_mix(docs.select("doc_id", "source", "text"), carry=["doc_id"])
    return planned.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_simhash(spark, folder):
    docs = table(spark, folder, "documents")
    named = simhash.components(simhash.fingerprints(docs))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).drop("text")


@query
def op4_warc(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return warc.read_archives(warc.write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_token_files(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    manifest = token_files.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_files(manifest)


@query
def op6_toxicity(spark, folder):
    docs, labels = (table(spark, folder, n) for n in ("documents", "labels"))
    return toxicity.classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


@query
def op7_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op8_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


# Fixed values of the task: host and path rules.
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@query
def op9_url_filter(spark, folder):
    pages = table(spark, folder, "pages")
    return urls.filter_urls(pages.select("page_id", "url"), urls.listed_urls(pages), URL_RULES).drop("canonical")


@query
def op10_nearest(spark, folder):
    return nearest.search(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@query
def op11_exact_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = exact_dedup.label(exact_dedup.build(docs))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query
def op12_ranked_search(spark, folder):
    found = lexical.search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query
def op13_conversation_repair(spark, folder):
    turns = table(spark, folder, "conversations")
    found = repair.repair_all(turns, repair.damage(turns))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


def load():
    return QUERIES, SQL
