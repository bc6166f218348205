"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

Documents of a source queue in a shuffled order that depends on their ids alone. Each document gets its virtual
finish time: the words its source has served up to and including it, divided by the source's weight. A second copy
of a document queues behind the first copies of its source, and so on, up to ``max_repeats``. All copies are
range-sorted by finish time and truncated at the total budget, so whole documents are taken.

A source that runs dry leaves its share to the others in proportion to their weights. ``target`` says how much that
is: the water level at which no source exceeds ``max_repeats`` times its words.

Null and empty texts have no words; they are taken 0 times. A null source is a source of its own, after all others;
null ids share one place in the shuffle, where size and text decide. Repeated rows queue one after the other. An empty
table gives an empty mix. Columns of ``docs`` are carried along; ``size`` and the other columns made here replace
columns of the same name.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.common import col
from ..operators.ordered import with_row_index
from .common import WORD, stored, text_of

BUCKET_ROWS = 1_000
HEX_DIGITS = 6


def source_targets(sized, weights, share, max_repeats):
    """(place, source, source_docs, source_size, weight, target), one row per source, stored."""
    sources = sized.groupBy("_source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("size").alias("source_size"))
    ranked = with_row_index(stored(sources, "mix-sources"), [F.col("_source").asc_nulls_last()], name="place")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", cycle).withColumn("most", max_repeats * F.col("source_size")), "mix-weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    budget, level, before = share * total, 0.0, -1
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)).alias("dry"), F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if row["n"] == before or not row["weight"]:
            break
        level, before = (budget - row["dry"]) / row["weight"], row["n"]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)) if row["weight"] else F.col("most").cast("double")
    return ranked.withColumn("target", target).drop("most"), budget


def queued(sized, targets):
    """Each document with ``served``: the words of its source up to and including it in the shuffled order.

    Sums run within hash ranges of at most about ``BUCKET_ROWS`` documents; a table of the ranges' totals carries them on, so
    a source with most of the rows is spread over many tasks.
    """
    docs = targets.agg(F.coalesce(F.max("source_docs"), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 << min(4 * HEX_DIGITS, max(0, (docs // BUCKET_ROWS).bit_length()))
    mark = F.md5(F.coalesce("_key", F.lit("")).cast("binary"))
    bucket = F.floor(F.conv(F.substring("_mark", 1, HEX_DIGITS), 16, 10).cast("long") * buckets / F.lit(1 << 4 * HEX_DIGITS))
    marked = sized.withColumn("_mark", mark).withColumn("_bucket", bucket)
    sums = marked.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_source", "_bucket").orderBy("_mark", "size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_run", F.sum("size").over(order))
        .join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("served", F.col("_before") + F.col("_run"))
        .join(targets.withColumnRenamed("_source", "_t"), F.col("_source").eqNullSafe(F.col("_t"))))


def place_of(copy):
    """The sort key of the n-th copy (from 0) of a document: virtual finish time first."""
    served = F.col("served") + copy * F.col("source_size")
    return F.struct((served / F.col("weight")).alias("finish"), F.col("place").alias("source"), F.lit(copy).alias("copy"), served.alias("served"))


def cut_off(rows, budget, max_repeats):
    """The sort key of the first copy beyond the budget; None if everything fits."""
    copies = rows.filter("size > 0").select("size", F.explode(F.array(*[place_of(n) for n in range(max_repeats)])).alias("at"))
    lined_up = stored(copies.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "mix-order")
    left = budget
    for part in lined_up.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect():
        if part["n"] > left:
            run = F.sum("size").over(Window.partitionBy("part").orderBy("at"))
            last = lined_up.filter(F.col("part") == part["part"]).withColumn("run", run).filter(F.col("run") > left)
            return last.agg(F.min("at").alias("at")).first()["at"]
        left -= part["n"]
    return None


def plan_mix(docs, key="doc_id", text="text", source="source", weights=(3, 1, 2), share=1.5, max_repeats=2, carry=None):
    """``docs`` (or its columns ``carry``) with size, source_size, weight, target, and taken (words the mix takes, copies counted)."""
    made = ("size", "source_size", "weight", "target", "taken")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    sized = docs.select(
        *[col(c) for c in carry], col(key).cast("string").alias("_key"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        col(source).cast("string").alias("_source"), F.xxhash64(text_of(text)).alias("_tie"))
    targets, budget = source_targets(sized, weights, share, max_repeats)
    targets = stored(targets, "mix-targets")
    rows = stored(queued(sized, targets), "mix-queue")
    end = cut_off(rows, budget, max_repeats)
    copies = F.lit(max_repeats)
    if end is not None:
        edge = F.struct(F.lit(end["finish"]).alias("finish"), F.lit(end["source"]).cast("long").alias("source"), F.lit(end["copy"]).alias("copy"), F.lit(end["served"]).cast("long").alias("served"))
        copies = sum((F.when(place_of(n) < edge, 1).otherwise(0) for n in range(max_repeats)), F.lit(0))
    return rows.withColumn("taken", copies * F.col("size")).select(*[col(c) for c in carry], *made)


def mix(docs, **how):
    """The mix itself: the columns of ``docs``, one row for each copy that is taken."""
    whole = docs.withColumn("_row", F.struct(*[col(c) for c in docs.columns]))
    planned = plan_mix(whole, carry=["_row"], **how).filter("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return planned.withColumn("_copy", copies).select("_row.*")
