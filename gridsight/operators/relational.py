"""Projection, predicates, joins, sampling and set operations."""
import itertools
import re

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import all_of, any_of, as_double, col, metric_table, numeric_columns, small, union_all
from .ordered import fill_forward, hash_rank, take_smallest, with_row_index

# ---- projection, predicates and row changes


def select_valid(df, cols):
    """The wanted columns that exist; all columns when none does."""
    have = [c for c in cols if c in df.columns]
    return df.select(*[col(c) for c in have]) if have else df


OPERATORS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
    "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
}


def predicate(conditions):
    """A filter from {column: value | [values] | {operator: value}}; None means null."""
    tests = []
    for c, want in conditions.items():
        if isinstance(want, (list, tuple)):
            tests.append(col(c).isin(list(want)))
        elif isinstance(want, dict):
            tests += [OPERATORS[op](col(c), F.lit(v)) for op, v in want.items()]
        else:
            tests.append(col(c).isNull() if want is None else col(c) == F.lit(want))
    return all_of(tests)


def select_where(df, cols=None, conditions=None, order_by=None, limit=None, offset=None):
    """Filter, sort, page and project. ``order_by`` lists columns, each optionally followed by ``desc``."""
    out = df.filter(predicate(conditions)) if conditions else df
    if order_by:
        keys = [k.split() for k in ([order_by] if isinstance(order_by, str) else order_by)]
        out = out.orderBy(*[col(k[0]).desc() if k[-1].lower() == "desc" and len(k) > 1 else col(k[0]) for k in keys])
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out.select(*cols) if cols else out


def update_where(df, values, conditions):
    """The table with non-null ``values`` written into matching rows."""
    hit = F.coalesce(predicate(conditions), F.lit(False))
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(col(c)) for c, v in values.items() if v is not None})


def delete_where(df, conditions):
    return df.filter(~F.coalesce(predicate(conditions), F.lit(False)))


def normal_names(names):
    """Lower-case words joined by underscores, unique, and starting with a letter."""
    seen, out = {}, []
    for i, name in enumerate(names):
        n = re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", str(name).strip().lower()))
        n = f"column_{i}" if not n else f"col_{n}" if n[0].isdigit() else n
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def normalize_names(df):
    return df.toDF(*normal_names(df.columns))


def duplicate_columns(df):
    """(column, original): columns equal to an earlier one in every row, found in one aggregate."""
    fields = df.schema.fields
    pairs = [(a.name, b.name) for a, b in itertools.combinations(fields, 2) if a.dataType == b.dataType and not isinstance(a.dataType, T.MapType)]
    if len(fields) > 30 and pairs:
        names = sorted({c for p in pairs for c in p})
        digest = df.agg(*[F.sum(F.xxhash64(col(c)).cast("decimal(38,0)")).alias(f"d{i}") for i, c in enumerate(names)]).first()
        mark = {c: digest[i] for i, c in enumerate(names)}
        pairs = [(a, b) for a, b in pairs if mark[a] == mark[b]]
    same = df.agg(*[F.bool_and(col(a).eqNullSafe(col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    found = {}
    for (a, b), equal in zip(pairs, same):
        if equal and a not in found:
            found.setdefault(b, a)
    return df.sparkSession.createDataFrame(list(found.items()), "column string, original string")


def drop_duplicate_columns(df):
    return df.drop(*[r["column"] for r in duplicate_columns(df).collect()])


def drop_sparse_columns(df, max_null=0.8):
    """Without the columns whose null share exceeds ``max_null``."""
    row = df.agg(*[F.avg(col(c).isNull().cast("double")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if row[i] is not None and row[i] > max_null])


def search(df, cols, text):
    """Rows where any of the columns contains the text, ignoring case."""
    return df.filter(any_of([F.contains(F.lower(col(c)), F.lit(text.lower())) for c in cols]))


def filter_pairs(pairs, threshold=0.3):
    return pairs.filter(F.abs("r") >= threshold)


KIND_CASTS = {"numeric": "double", "integer": "bigint", "datetime": "timestamp", "boolean": "boolean"}


def conformance(df, kinds):
    """Check declared kinds (numeric, integer, datetime, boolean, categorical) and required columns."""
    present = [c for c in kinds if c in df.columns]
    failed = lambda c: F.count_if(col(c).isNotNull() & col(c).cast("string").try_cast(KIND_CASTS[kinds[c]]).isNull()) if kinds[c] in KIND_CASTS else F.sum(F.lit(0))
    parts = []
    if present:
        t = metric_table(df, present, {"kind": lambda c: F.any_value(F.lit(kinds[c])), "n_failed": lambda c: F.coalesce(failed(c), F.lit(0)).cast("long")})
        parts.append(t.select("column", F.lit(True).alias("present"), "kind", "n_failed", (F.col("n_failed") == 0).alias("ok")))
    missing = [(c, False, k, None, False) for c, k in kinds.items() if c not in df.columns]
    if missing:
        parts.append(df.sparkSession.createDataFrame(missing, "column string, present boolean, kind string, n_failed long, ok boolean"))
    return union_all(parts)


INTEGER_SIZES = [("tinyint", 2 ** 7), ("smallint", 2 ** 15), ("int", 2 ** 31), ("bigint", 2 ** 63)]


def narrow_plan(df):
    """Driver-side {column: type}: the smallest signed integer type that holds each integer column."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    if not ints:
        return {}
    row = df.agg(*[x for i, c in enumerate(ints) for x in (F.min(col(c)).alias(f"l{i}"), F.max(col(c)).alias(f"h{i}"))]).first()
    return {c: next(t for t, m in INTEGER_SIZES if -m <= row[f"l{i}"] and row[f"h{i}"] < m) for i, c in enumerate(ints) if row[f"l{i}"] is not None}


def narrow_types(df, least=None):
    """Each integer column in the smallest type that holds it, or in the type that ``least`` gives for it if that is wider."""
    plan, order = narrow_plan(df), [t for t, _ in INTEGER_SIZES]
    plan.update({c: t for c, t in (least or {}).items() if c not in plan or order.index(t) > order.index(plan[c])})
    return df.select(*[col(c).cast(plan[c]).alias(c) if c in plan else col(c) for c in df.columns])


def narrowing_advice(df):
    """(column, advice): integers that fit 8 bits, fractions that equal their 2-decimal rounding."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    num = numeric_columns(df)
    t = metric_table(df, num, {
        "lo": lambda c: F.min(as_double(c)), "hi": lambda c: F.max(as_double(c)), "two": lambda c: F.bool_and(F.round(as_double(c), 2) == as_double(c))})
    whole = F.col("column").isin(ints)
    advice = F.when(whole & (F.col("lo") >= -128) & (F.col("hi") <= 127), "int8").when(~whole & F.col("two"), "two_decimals")
    return t.select("column", advice.alias("advice")).filter(F.col("advice").isNotNull())


# ---- joins


def with_children(parent, children, key):
    """Left outer join of a parent with each named child table, one tagged block of rows per child."""
    parts = [parent.join(child, key, "left").withColumn("child", F.lit(name)) for name, child in children.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def attach_forecasts(analyses, forecasts):
    return analyses.join(forecasts, ["date_column", "value_column"], "left")


def asof_join(left, right, on, by=(), direction="backward", right_key=None, left_key=None):
    """Match each left row with the latest right row at or before it (``forward``: earliest at or after).

    Both sides are put in one order and the matches carried along it; equal times of the right side are
    ordered by ``right_key``.
    """
    by, back = list(by), direction == "backward"
    values = [c for c in right.columns if c not in [*by, on]]
    if values == [right_key]:
        # Of equal times only the last row can match (``forward``: the first, and null comes first), so one row of each is put in order.
        own = col(right_key)
        last = F.max(own) if back else F.when(F.count(own) == F.count(F.lit(1)), F.min(own))
        right = right.groupBy(*by, on).agg(last.alias(right_key))
    # Each side's tie key keeps its own type, so 9 comes before 10.
    tie = lambda c: col(c) if c else F.lit(0)
    a = left.withColumns({"_side": F.lit(1 if back else 0), "_left_tie": tie(left_key)})
    b = right.select(*by, on, tie(right_key).alias("_right_tie"), F.struct(*values).alias("_match")).withColumn("_side", F.lit(0 if back else 1))
    rows = a.unionByName(b, allowMissingColumns=True)
    indexed = with_row_index(rows, [on, "_side", "_left_tie", "_right_tie"], by)
    filled = fill_forward(indexed, ["_match"], by, backward=not back)
    kept = filled.filter(F.col("_side") == (1 if back else 0))
    return kept.select(*left.columns, *[F.col(f"_match.{c}").alias(c) for c in values])


def map_labels(df, c, mapping, default="unknown", name="mapped"):
    """Translate labels by a fixed dictionary."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), f"_label string, {name} string")
    return df.join(F.broadcast(table), col(c) == F.col("_label"), "left").drop("_label").withColumn(name, F.coalesce(name, F.lit(default)))


WORD_BITS = 63


def inclusions(tables):
    """(child_table, child_column, parent_table, parent_column, parent_is_key): every column of whole numbers or text
    whose values (nulls aside) all occur in a column of another table of the same kind.

    An inverted index in one pass: each distinct value knows the set of columns that hold it, as bits; the columns
    that hold all values of a column are the intersection (``bit_and``) of the sets of its values. The number of jobs does
    not depend on the number of columns, and a value that many rows share is counted before it moves.
    """
    names = [(t, f.name, isinstance(f.dataType, T.StringType)) for t, df in tables.items() for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.StringType))]
    number = {(t, c): i for i, (t, c, _) in enumerate(names)}
    long = []
    for t, df in tables.items():
        own = [(c, text) for u, c, text in names if u == t]
        if own:
            cells = F.array(*[F.struct(F.lit(number[t, c]).alias("c"), F.lit(text).alias("text"), col(c).cast("string").alias("v")) for c, text in own])
            long.append(df.select(F.explode(cells).alias("_e")).select("_e.*"))
    spark = next(iter(tables.values())).sparkSession
    schema = "child_table string, child_column string, parent_table string, parent_column string, parent_is_key boolean"
    if not long:
        return spark.createDataFrame([], schema)
    words = -(-len(names) // WORD_BITS)
    counted = union_all(long).groupBy("text", "v", "c").agg(F.count(F.lit(1)).alias("n"))
    bit = lambda w: F.when(F.floor(F.col("c") / WORD_BITS) == w, F.expr(f"shiftleft(1L, c % {WORD_BITS})")).otherwise(F.lit(0).cast("long"))
    sets = counted.groupBy("text", "v").agg(F.collect_list(F.struct("c", "n")).alias("held"), *[F.bit_or(bit(w)).alias(f"w{w}") for w in range(words)])
    each = sets.select("v", *[f"w{w}" for w in range(words)], F.explode("held").alias("_h"))
    has = F.col("v").isNotNull()
    per = each.groupBy("_h.c").agg(
        F.count_if(has).alias("distinct"), F.max(~has | (F.col("_h.n") > 1)).alias("repeats"), *[F.bit_and(F.when(has, F.col(f"w{w}"))).alias(f"w{w}") for w in range(words)])
    found = []
    rows = {r["c"]: r for r in per.collect()}  # a row per column
    for i, r in rows.items():
        if not r["distinct"]:
            continue
        for j, (t, c, _) in enumerate(names):
            if t != names[i][0] and r[f"w{j // WORD_BITS}"] >> j % WORD_BITS & 1:
                found.append((names[i][0], names[i][1], t, c, not rows[j]["repeats"]))
    return spark.createDataFrame(found, schema)


def fk_candidates(tables):
    """(child_table, child_column, parent_table, parent_column): values all found in a unique parent column without nulls."""
    return inclusions(tables).filter("parent_is_key").drop("parent_is_key")


def link_endpoints(links, source="source", target="target"):
    """(node, side): source, target or both, from one pass over the links."""
    ends = links.select(F.explode(F.array(
        F.struct(col(source).alias("node"), F.lit(1).alias("s"), F.lit(0).alias("t")),
        F.struct(col(target).alias("node"), F.lit(0).alias("s"), F.lit(1).alias("t")))).alias("_e")).select("_e.*")
    g = ends.filter(F.col("node").isNotNull()).groupBy("node").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    return g.select("node", F.when((F.col("s") == 1) & (F.col("t") == 1), "both").when(F.col("s") == 1, "source").otherwise("target").alias("side"))


def dependency_edges(df, id, deps):
    """(task, depends_on)"""
    return df.select(col(id).alias("task"), F.explode(col(deps)).alias("depends_on"))


def attach_stats(columns, stats):
    return columns.join(small(stats), "column", "left")


# ---- sort, top-k and sampling


def sort_by(df, c, desc=False, key=None):
    """Sort by one column with nulls read as 0 (or the empty text)."""
    zero = F.lit(0) if isinstance(df.schema[c].dataType, T.NumericType) else F.lit("")
    v = F.coalesce(col(c), zero) if isinstance(df.schema[c].dataType, (T.NumericType, T.StringType)) else col(c)
    return df.orderBy(v.desc() if desc else v.asc(), *([col(key)] if key else []))


def top_k(df, c, k, key):
    return df.orderBy(col(c).desc_nulls_last(), col(key)).limit(k)


def sample_n(df, n, key, seed=42):
    """n rows chosen by a hash of the key: random-looking and repeatable."""
    return take_smallest(df, [], hash_rank(col(key), seed), lambda total: F.least(F.lit(n), total))


def sample_systematic(df, n, order):
    """Every (rows / n)-th row in order."""
    indexed = with_row_index(df, order)
    step = max(1, df.count() // n)
    return indexed.filter(F.col("row_index") % step == 0).filter(F.col("row_index") < step * n).drop("row_index")


def sample_stratified(df, n, strata, key, seed=42):
    """About n rows with each stratum in its share, rounded up."""
    total = df.count()
    frac = min(1.0, n / total) if total else 1.0
    return take_smallest(df, [strata], hash_rank(col(key), seed), lambda size: F.ceil(size * F.lit(frac)))


def sample_over_time(df, n, ts, key):
    return sample_systematic(df, n, [ts, key])


def sample_grid(df, x, y, n, key):
    """One point per cell of a square grid of about n cells: the one with the smallest key."""
    side = int(-(-(n ** 0.5) // 1))
    b = df.agg(F.min(as_double(x)).alias("x0"), F.max(as_double(x)).alias("x1"), F.min(as_double(y)).alias("y0"), F.max(as_double(y)).alias("y1")).first()
    cell = lambda c, lo, hi: F.least(F.floor((as_double(c) - F.lit(lo)) * side / F.lit((hi - lo) or 1.0)), F.lit(side - 1))
    whole = F.struct(*[col(c) for c in df.columns])
    g = df.filter(as_double(x).isNotNull() & as_double(y).isNotNull()).groupBy(cell(x, b["x0"], b["x1"]).alias("_cx"), cell(y, b["y0"], b["y1"]).alias("_cy"))
    return g.agg(F.min_by(whole, col(key)).alias("_p")).select("_p.*")


def every_kth(df, k, order):
    return with_row_index(df, order).filter(F.col("row_index") % k == 0).drop("row_index")


def page(df, order, number, size):
    """One page (from 1) of a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df, size):
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.ceil(F.col("rows") / size).alias("pages"))


def activity_feed(df, created, finished, name, n=3):
    """The n newest datasets, each with an upload and (when finished) an analysis event, newest first."""
    newest = df.orderBy(col(created).desc(), col(name)).limit(n)
    events = F.array_compact(F.array(
        F.struct(F.lit("uploaded").alias("event"), col(created).alias("at")),
        F.when(col(finished).isNotNull(), F.struct(F.lit("analyzed").alias("event"), col(finished).alias("at")))))
    return newest.select(name, F.explode(events).alias("_e")).select(name, "_e.*").orderBy(F.desc("at"), name)


# ---- set operations


def union_dedupe(dfs, on):
    """Union in list order, keeping the first row per value of ``on``."""
    tagged = union_all([d.withColumn("_source", F.lit(i)) for i, d in enumerate(dfs)])
    cols = dfs[0].columns
    best = tagged.groupBy(on).agg(F.min_by(F.struct(*cols), F.struct("_source", *[c for c in cols if c != on])).alias("_r"))
    return best.select("_r.*")


def union_flags(df, flags, name="flagged"):
    """Rows with any of the boolean columns set."""
    return df.withColumn(name, any_of([F.coalesce(col(f), F.lit(False)) for f in flags]))


def top_with_others(df, c, n):
    """Counts of the n-1 most frequent values and of all others; at most n values are kept as they are."""
    counts = df.filter(col(c).isNotNull()).groupBy(col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.orderBy(F.desc("n"), "value").limit(n + 1).collect()
    if len(ranked) <= n:
        return counts
    keep = [r["value"] for r in ranked[:n - 1]]
    return counts.groupBy(F.when(F.col("value").isin(keep), F.col("value")).otherwise("Others").alias("value")).agg(F.sum("n").alias("n"))


def ordered_distinct(df, c, pos):
    """Distinct values with the position of their first appearance."""
    return df.groupBy(c).agg(F.min(pos).alias("position"))


def distinct_values(df, c):
    return df.select(c).distinct()


def split(df, key, ratio=0.9, seed=42):
    """(train, test) by a hash of the key; the two filters are complementary."""
    cut = int(ratio * (1 << 60))
    h = hash_rank(col(key), seed)
    return df.filter(h < cut), df.filter(h >= cut)


def concat(dfs):
    """Union by name; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# ---- user code


def run_sql(spark, tables, query, max_rows=None):
    """Run a SELECT over named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(query)
    return out if max_rows is None else out.limit(max_rows)


def user_aggregates(df, by, exprs):
    """Grouped aggregates written as SQL expressions, {name: expression}."""
    return df.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in exprs.items()])
