"""A corpus pipeline: filter toxic documents, drop repeated lines, keep one of near copies, mix sources, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Its result is written as Parquet and
reread as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""
import public_tokenizers
from pyspark.sql import functions as F

from gridsight.llm import bpe, line_dedup, mixing, near_copies, toxicity
from gridsight.llm.common import stored

TOKENIZER = "byte_bpe_50k.json"
# A quarter of the encoder's usual memories: the executors of a pipeline still hold what earlier stages needed.
REMEMBERED = 1 << 16


def filter_toxic(spark, docs, sf_dir):
    """Rows that the classifier, trained on the labelled ones among them, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(docs, labels).filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark, docs, sf_dir):
    """All rows, without the lines that ten or more of them share; n_chars follows the text."""
    left = line_dedup.drop_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark, docs, sf_dir):
    """One row, that of the smallest doc_id, of each component of texts linked by a Jaccard similarity of 0.8 of five-word shingles:
    SimHash and an exact check, then a prefix filter for the pairs beyond the fingerprints' radius."""
    return near_copies.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """One row for each copy that the mix takes."""
    return mixing.mix(docs)


def encode_texts(spark, docs, sf_dir):
    """Token ids of each row, with digests of the ids and of the text they decode to."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), ids=True, remembered=REMEMBERED)


STAGES = [
    ("toxicity", filter_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

# No stage but the mix and the line dedup can be said in SQL; tests/llm/test_pipeline.py compares each stage with a plain Python version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
