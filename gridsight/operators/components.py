"""Connected components of an edge table in few rounds, whatever the length of its paths."""
from pyspark.sql import functions as F

from ..session import pin
from .ordered import BROADCAST_ROWS, sort_tasks


def _stars(edges, large, tasks=None):
    """One round: the larger neighbours of each node (or the smaller ones and the node) are tied to its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else down
    both = both.repartition(tasks, "a") if tasks else both
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    tied = both.filter("b > a") if large else both
    moved = tied.join(least.hint("merge") if tasks else least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = moved if large else moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return kept.filter("a <> b").distinct()


def components(edges):
    """((node, root) of every node of ``edges`` (a, b), rounds): the root is the smallest node of its component.

    Alternates the two kinds of rounds; each halves the length of paths, so rounds grow with its logarithm. Each is a
    partial aggregate and a join, pinned by a reliable checkpoint; the driver sees two numbers per round. Many edges are dealt
    to tasks of about ``SORT_ROWS`` and sorted there.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
    edges = pin(edges.select("a", "b").filter("a <> b").distinct())
    before, rounds = None, 0
    while (now := state(edges)) != before and now[0]:
        before, rounds = now, rounds + 1
        tasks = sort_tasks(edges.sparkSession, 2 * now[0]) if now[0] > BROADCAST_ROWS else None
        edges = pin(_stars(_stars(edges, True, tasks), False, tasks))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), rounds
