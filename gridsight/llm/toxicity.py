"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Training takes at most ``sample`` labelled rows, those of the smallest id hashes. A first pass counts in how many toxic and other
texts each hashed n-gram occurs; n-grams whose occurrence depends on the label are features, each worth its log-count
ratio where it occurs and 0 elsewhere. Logistic regression weighs them. Ratios and weights become one table of ``BUCKETS``
numbers (4 MB, whatever the input), which scores whole texts where they lie.

Null and empty texts have no n-gram and get the classifier's base score. Rows with a null id are scored and never train.
Labels other than 0 and 1 are ignored; repeated rows count each. Without labels of both classes every score is the share of
toxic labels (0 without any). Scores depend on the text alone; other columns are ignored.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from ..operators.common import col
from .common import in_batches, stored, text_of, tidy

BUCKETS = 1 << 20
SIZES = (3, 4, 5, 6)
FEATURES = 8192
LEAST_CHI2 = 10.83  # one in a thousand by chance
SAMPLE = 20_000
REGULARIZATION = 0.001


def ngrams(text):
    """Bucket of every character n-gram of a text, repeats included."""
    chars = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    chars[chars < 33] = 32
    out, rolled = [], None
    for n in range(1, max(SIZES) + 1):
        if len(chars) < n:
            break
        tail = chars[n - 1:] + np.uint32(1)
        rolled = tail * np.uint32(0x9E3779B1) if rolled is None else (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + tail * np.uint32(0xC2B2AE3D)
        if n in SIZES and text:
            out.append(((rolled ^ (rolled >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> np.uint32(12))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def is_held_out(key):
    """Whether the row never trains: crc32 of the id's text is divisible by 5, or there is no id."""
    return F.coalesce(F.crc32(col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs, labels, key="doc_id", text="text", label="toxic", sample=SAMPLE):
    """At most ``sample`` labelled texts outside the held-out fold; the sample's ids are a broadcast of proven size."""
    picked = (
        labels.filter(~is_held_out(key) & col(label).isin(0, 1)).select(col(key).alias("_id"), col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id", "label").limit(sample))
    rows = docs.select(col(key).alias("_id"), text_of(text).alias("text"))
    return stored(rows.join(F.broadcast(picked), "_id").select("label", "text"), "toxicity-sample")


def gram_counts(rows):
    """(bucket, toxic, other): texts of each class that have the n-gram; each task sums its texts first."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = ngrams(text.as_py())
                if len(grams):
                    counts[label, np.unique(grams)] += 1
        found = np.nonzero(counts.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1, found]), pa.array(counts[0, found])], names=["bucket", "toxic", "other"])

    return in_batches(rows).mapInArrow(tidy(run), "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def chosen_features(rows, toxic, other):
    """(bucket, ratio) of at most ``FEATURES`` n-grams with the clearest dependence on the label."""
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    c, d = F.lit(float(toxic)) - a, F.lit(float(other)) - b
    chi2 = F.lit(float(toxic + other)) * (a * d - b * c) * (a * d - b * c) / ((a + b) * F.greatest(c + d, F.lit(1.0)) * F.lit(float(toxic)) * F.lit(float(other)))
    ratio = F.log((a + 1) / F.lit(toxic + 2.0)) - F.log((b + 1) / F.lit(other + 2.0))
    found = gram_counts(rows).select("bucket", ratio.alias("ratio"), chi2.alias("chi2")).filter(F.col("chi2") >= LEAST_CHI2)
    return found.orderBy(F.desc("chi2"), "bucket").limit(FEATURES).toPandas()


def train(docs, labels, key="doc_id", text="text", label="toxic", sample=SAMPLE):
    """(weights, base): one weight per bucket and the base value of the linear score."""
    rows = training_rows(docs, labels, key, text, label, sample)
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    toxic, other = n["toxic"], n["all"] - n["toxic"]
    weights = np.zeros(BUCKETS, dtype=np.float32)
    if not toxic or not other:
        return weights, 40.0 if toxic else -40.0
    features = chosen_features(rows, toxic, other)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[features["bucket"]] = np.arange(len(features))
    ratios = features["ratio"].to_numpy()
    if not len(features):
        return weights, float(np.log(toxic / other))
    shared = rows.sparkSession.sparkContext.broadcast((place, ratios))

    @F.udf(VectorUDT())
    def scaled(text):
        place, ratios = shared.value
        at = np.unique(place[ngrams(text)])
        at = at[at >= 0]
        return Vectors.sparse(len(ratios), at, ratios[at])

    table = stored(rows.select(F.col("label").cast("double").alias("label"), scaled("text").alias("features")), "toxicity-features")
    model = LogisticRegression(maxIter=60, regParam=REGULARIZATION, standardization=False, aggregationDepth=2).fit(table)
    weights[features["bucket"]] = (model.coefficients.toArray() * ratios).astype(np.float32)
    return weights, float(model.intercept)


def score(docs, weights, base, text="text"):
    """``docs`` with a column ``score`` (0 to 1); the whole text counts, each n-gram once."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        table, out = shared.value, np.empty(len(texts))
        for i, t in enumerate(texts):
            grams = ngrams(t)
            hit = np.unique(grams[table[grams] != 0])
            out[i] = base + table[hit].sum(dtype=np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    return in_batches(docs).withColumn("score", probability(text_of(text)))


def classify(docs, labels, key="doc_id", text="text", label="toxic", sample=SAMPLE):
    """``docs`` with held_out, score and predicted (1 where the score is at least 0.5)."""
    weights, base = train(docs, labels, key, text, label, sample)
    return score(docs, weights, base, text).withColumns({"held_out": is_held_out(key), "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})
