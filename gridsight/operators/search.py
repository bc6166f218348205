"""Cosine search over vector columns."""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import col


def cosine(vec, query):
    """Cosine of a vector column and a fixed query, in double precision on the JVM."""
    norm = float(np.sqrt(np.dot(query, query)))
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(vec, q, lambda a, b: a.cast("double") * b), F.lit(0.0), add)
    size = F.sqrt(F.aggregate(F.transform(vec, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), add))
    return F.when(size * norm > 0, dot / (size * F.lit(norm))).otherwise(0.0)


def vector_search(df, vec, query, k=5, key="row_index"):
    """The k rows nearest to one query; each task keeps only its own top k."""
    return df.withColumn("score", cosine(col(vec), query)).orderBy(F.desc("score"), key).limit(k).drop(vec)


def vector_search_many(df, vec, key, queries, k=5):
    """(query_key, key, score, rank) for a bounded set of queries {query_key: vector}.

    Each Arrow batch is scored by one matrix product and passes on k rows per query.
    """
    names = list(queries)
    q = np.array([queries[n] for n in names], dtype="float64")
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def score(batches):
        for batch in batches:
            v = np.stack(batch[vec].to_numpy()).astype("float64")
            s = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
            ids = batch[key].to_numpy()
            for i, n in enumerate(names):
                top = np.lexsort((ids, -s[i]))[:k]
                yield pd.DataFrame({"query_key": n, key: ids[top], "score": s[i][top]})

    kind = dict(df.dtypes)[key]
    hits = df.select(key, vec).mapInPandas(score, f"query_key string, {key} {kind}, score double")
    w = Window.partitionBy("query_key").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
