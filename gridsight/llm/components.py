"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a partial aggregate and a join on the node; each is written to the shared folder. No edge list, however
large, meets the driver: it sees one row of counts per round.
"""
from pyspark.sql import functions as F

from .common import stored


def _state(edges):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_000_007))).first())


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges):
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    moved = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges, name="components"):
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node of its component."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges)), f"{name}-stars")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
