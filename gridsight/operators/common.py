"""Small helpers shared by the operators."""
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name):
    """A column reference that tolerates dots and spaces in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(field):
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df):
    return [f.name for f in df.schema if is_numeric(f)]


def string_columns(df):
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df):
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def as_double(name):
    """The column as DOUBLE with NaN read as null."""
    value = col(name).cast("double")
    return F.when(~F.isnan(value), value)


def stack_metrics(row, cols, metrics, by=()):
    """Turn aggregates named ``<i>_<metric>`` into one row per column."""
    structs = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{m}").alias(m) for m in metrics])
        for i, c in enumerate(cols)
    ]
    return row.select(*by, F.explode(F.array(*structs)).alias("_m")).select(*by, "_m.*")


def metric_table(df, cols, exprs, by=()):
    """One wide aggregate over all columns, returned as one row per column.

    ``exprs`` maps a metric name to a function from column name to an aggregate.
    """
    aggs = [fn(c).alias(f"{i}_{m}") for i, c in enumerate(cols) for m, fn in exprs.items()]
    return stack_metrics(df.groupBy(*by).agg(*aggs), cols, list(exprs), by)


def value_counts(df, cols, by=()):
    """(by..., column, value STRING, n) of the non-null values, pre-aggregated before the shuffle."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols
    ]))
    return (
        df.select(*by, pairs.alias("_p")).select(*by, "_p.*")
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def all_of(conditions):
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def fits(df, limit):
    """Whether the frame has at most ``limit`` rows (an exact count, not an estimate)."""
    return df.select(F.lit(1)).count() <= limit


def small(df, limit=100_000):
    """Mark a side for broadcast once its row count is proven; otherwise leave the choice to Spark."""
    return F.broadcast(df) if fits(df, limit) else df


def spread(df, rows):
    """The rows dealt evenly to tasks of about ``rows`` rows each, however few splits their files have; fewer rows stay as they are."""
    tasks = -(-df.select(F.lit(1)).count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def ratio(part, whole):
    """part / whole, or 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def round_doubles(df, digits=4):
    """Round every DOUBLE column (reports and comparisons only)."""
    return df.select(*[
        (F.round(col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else col(f.name)
        for f in df.schema
    ])


#: Rows of a task that tries many patterns on each of their texts.
PATTERN_ROWS = 20_000


def text_metrics(df, cols, exprs):
    """Like ``metric_table`` for text columns and many patterns: columns become rows first, so the
    generated code holds each pattern once rather than once per column."""
    long = spread(df.select(*[col(c).cast("string").alias(c) for c in cols]), PATTERN_ROWS).unpivot([], cols, "column", "value")
    return long.groupBy("column").agg(*[fn("value").alias(m) for m, fn in exprs.items()])


def series_name(by):
    """One name for several key columns: no two different keys, nulls included, share a name."""
    part = lambda b: F.coalesce(F.replace(F.replace(col(b).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/")), F.lit("\\N"))
    return F.concat_ws("/", *[part(b) for b in by])


def join_on(left, right, keys, how="inner"):
    """Join on equal keys with null equal to null; key columns come from the left side only."""
    renamed = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    match = all_of([col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    out = left.join(renamed, match, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_k{i}" for i in range(len(keys))])


def distinct_table(df, cols):
    """(column, distinct_values), exact. Columns of one type are stacked, de-duplicated and counted
    together, which spreads hot columns by value and keeps the plan small however many columns there are."""
    kinds = {}
    for c in cols:
        t = df.schema[c].dataType
        plain = not isinstance(t, (T.StructType, T.MapType, T.ArrayType, T.VariantType))
        kinds.setdefault(t.simpleString() if plain else "json", []).append(c)
    parts = []
    for kind, names in kinds.items():
        value = (lambda c: F.to_json(F.struct(col(c)))) if kind == "json" else col
        long = df.select(*[value(c).alias(c) for c in names]).unpivot([], names, "column", "value")
        parts.append(long.filter(F.col("value").isNotNull()).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")))
    found = union_all(parts)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return F.broadcast(names.join(found, "column", "left").select("column", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values")))


def local(df):
    """A table bounded by the column count, computed once and kept on the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
