"""Semantic roles. Evidence for all columns comes from two wide aggregates; rules run on that small table."""
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from .common import any_of, col, datetime_columns, distinct_table, is_numeric, local, metric_table, numeric_columns, string_columns, text_metrics, union_all
from .dates import datetime_share
from .profile import word_count


def _named(column, term):
    """Whether a column name holds a role's word (a driver-side test on names)."""
    return re.search(vocab.NAME_TERMS[term], column, re.IGNORECASE) is not None


def _share(c, pattern, lower=False):
    text = F.lower(col(c)) if lower else col(c)
    return F.coalesce(F.avg(text.rlike(pattern).cast("double")), F.lit(0.0))


def basic_evidence(df):
    """(column, kind, rows, non_null, distinct_values, low, high): pass one, all columns at once."""
    num, dates = set(numeric_columns(df)), set(datetime_columns(df))
    kind = lambda c: "numeric" if c in num else "datetime" if c in dates else "string" if c in string_columns(df) else "other"
    fractional = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))}
    plain = lambda c: col(c) if kind(c) != "other" else F.to_json(F.struct(col(c)))
    t = metric_table(df, df.columns, {
        "kind": lambda c: F.any_value(F.lit(kind(c))), "fractional": lambda c: F.any_value(F.lit(c in fractional)),
        "rows": lambda c: F.count(F.lit(1)), "non_null": lambda c: F.count(col(c)),
        "low": lambda c: F.min(plain(c)).cast("string"), "high": lambda c: F.max(plain(c)).cast("string"),
    })
    return t.join(distinct_table(df, df.columns), "column")


def _verdict(evidence, columns, named, rule, weight):
    """(column, evidence, match): the rule and its measured value per column."""
    flags = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(bool(named(c))))]) if columns else None
    t = evidence.withColumn("named", flags[F.col("column")])
    return t.select("column", weight.cast("double").alias("evidence"), F.coalesce(rule, F.lit(False)).alias("match"))


def is_id(df, strict=False, threshold=0.9, evidence=None):
    """Mostly distinct values and either a number or an id-like name. Fractional columns need the name unless ``strict``."""
    e = basic_evidence(df) if evidence is None else evidence
    ratio = F.when(F.col("rows") > 0, F.col("distinct_values") / F.col("rows")).otherwise(0.0)
    number = F.col("kind") == "numeric"
    plain = number if strict else number & ~F.col("fractional")
    return _verdict(e, df.columns, lambda c: _named(c, "id"), (ratio > threshold) & (plain | F.col("named")), ratio)


def is_id_by_ratio(df, threshold=0.8, evidence=None):
    """The looser id test used for insights: 0.8, 0.64 with an id-like name, or 0.95 for any kind."""
    e = basic_evidence(df) if evidence is None else evidence
    ratio = F.when(F.col("rows") > 0, F.col("distinct_values") / F.col("rows")).otherwise(0.0)
    terms = ("id", "uuid", "guid", "key", "code", "sku", "_id", "index")
    rule = ((F.col("kind") == "numeric") & (ratio > threshold)) | (F.col("named") & (ratio > threshold * 0.8)) | ((ratio > 0.95) & (F.col("rows") > 100))
    return _verdict(e, df.columns, lambda c: any(t in c.lower() for t in terms), rule, ratio)


def is_binary(df, evidence=None):
    """Exactly two values: 0 and 1, or two spellings of true and false. With two values, they are the minimum and maximum."""
    e = basic_evidence(df) if evidence is None else evidence
    lo, hi = F.lower(F.trim("low")), F.lower(F.trim("high"))
    word = lambda c: c.isin(vocab.TRUE_WORDS + vocab.FALSE_WORDS)
    numbers = (F.col("kind") == "numeric") & (F.abs(F.col("low").try_cast("double")) < 1e-10) & (F.abs(F.col("high").try_cast("double") - 1) < 1e-10)
    words = (F.col("kind") == "string") & word(lo) & word(hi) & (lo != hi)
    flags = (F.col("low") == "false") & (F.col("high") == "true")
    return _verdict(e, df.columns, lambda c: False, (F.col("distinct_values") == 2) & (numbers | words | flags), F.col("distinct_values"))


def is_likert(df, evidence=None):
    """3 to 10 values in steps of about 1 from about 1 up to at most 10, or a scale-like name."""
    num = numeric_columns(df)
    e = basic_evidence(df) if evidence is None else evidence
    lo, hi, d = F.col("low").try_cast("double"), F.col("high").try_cast("double"), F.col("distinct_values")
    whole = {c: True for c in num}
    if num:
        # A value is on the scale when it lies within 0.1 of a whole step.
        check = metric_table(df, num, {"on_steps": lambda c: F.bool_and(F.abs(col(c) - F.round(col(c).cast("double"))) <= 0.05)})
        e = e.join(F.broadcast(check), "column", "left")
    else:
        e = e.withColumn("on_steps", F.lit(False))
    steps = (F.abs((hi - lo) - (d - 1)) < 0.1) & F.coalesce("on_steps", F.lit(False)) & lo.between(0.9, 1.1) & hi.between(2.9, 10.1)
    rule = (F.col("kind") == "numeric") & d.between(3, 10) & (steps | F.col("named"))
    return _verdict(e, df.columns, lambda c: c in whole and _named(c, "likert"), rule, d)


def is_datetime(df, threshold=0.85):
    """A timestamp type, or text with a date word in its name that mostly parses."""
    typed = datetime_columns(df)
    maybe = [c for c in string_columns(df) if any(t in c.lower() for t in vocab.DATE_TERMS)]
    e = df.sparkSession.createDataFrame([(c, 1.0 if c in typed else 0.0) for c in df.columns], "column string, base double")
    if maybe:
        e = e.join(F.broadcast(datetime_share(df, maybe, threshold).select("column", "share")), "column", "left")
        e = e.withColumn("base", F.greatest("base", F.coalesce("share", F.lit(0.0))))
    return e.select("column", F.col("base").alias("evidence"), (F.col("base") >= threshold).alias("match"))


def is_numeric_role(df):
    num = set(numeric_columns(df))
    return df.sparkSession.createDataFrame([(c, float(c in num), c in num) for c in df.columns], "column string, evidence double, match boolean")


def text_evidence(df, cols):
    """Pass two: pattern shares of all text columns in one aggregate."""
    unit = "|".join(r"\d+\s*" + re.escape(u) for u in vocab.UNITS)
    exprs = {
        "email": lambda c: _share(c, vocab.EMAIL), "phone": lambda c: _share(c, vocab.PHONE), "url": lambda c: _share(c, vocab.URL),
        "hyphen": lambda c: _share(c, vocab.HYPHEN_RANGE), "to": lambda c: _share(c, vocab.TO_RANGE, True), "units": lambda c: _share(c, unit, True),
        "house": lambda c: _share(c, vocab.HOUSE_NUMBER, True), "commas": lambda c: F.avg(F.length(col(c)) - F.length(F.replace(col(c), F.lit(",")))),
        "mean_length": lambda c: F.avg(F.length(col(c))), "words": lambda c: F.avg(word_count(col(c))), "digits": lambda c: _share(c, r"\d"),
    }
    for i, p in enumerate(vocab.COMPARISONS):
        exprs[f"cmp{i}"] = lambda c, p=p: _share(c, p, True)
    for i, (_, _, p) in enumerate(vocab.ADDRESS_PATTERNS):
        exprs[f"adr{i}"] = lambda c, p=p: _share(c, p, True)
    return text_metrics(df, cols, exprs)


def gender_evidence(df, cols):
    """Distinct lower-case values and how many of them are gender words."""
    words = vocab.NAME_TERMS["gender"]
    long = df.select(*[F.lower(col(c)).alias(c) for c in cols]).unpivot([], cols, "column", "value").filter(F.col("value").isNotNull()).distinct()
    found = long.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.col("value").rlike("(?iu)" + words)).alias("hits"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found, "column", "left").na.fill(0)


def _text_rule(df, term, rule, weight, evidence=None):
    cols = string_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, evidence double, match boolean")
    e = text_evidence(df, cols) if evidence is None else evidence
    return _verdict(e, cols, lambda c: _named(c, term), F.col("named") | rule, weight)


def is_email(df, evidence=None):
    return _text_rule(df, "email", F.col("email") > 0.9, F.col("email"), evidence)


def is_phone(df, evidence=None):
    return _text_rule(df, "phone", F.col("phone") > 0.9, F.col("phone"), evidence)


def is_url(df, evidence=None):
    return _text_rule(df, "url", F.col("url") > 0.9, F.col("url"), evidence)


def is_gender(df, evidence=None):
    cols = string_columns(df)
    e = gender_evidence(df, cols) if evidence is None else evidence
    return _verdict(e, cols, lambda c: _named(c, "gender"), F.col("named") | (F.col("values").between(2, 5) & (F.col("hits") >= 2)), F.col("hits"))


def address_score():
    group = lambda g: sum((w * F.col(f"adr{i}") for i, (k, w, _) in enumerate(vocab.ADDRESS_PATTERNS) if k == g), F.lit(0.0))
    return F.greatest(group("us"), group("uk"), group("vn")) + 2 * F.col("house") + 0.5 * F.least(F.col("commas"), F.lit(3.0))


def is_address(df, evidence=None):
    return _text_rule(df, "address", (F.col("mean_length") >= 10) & (address_score() > 1), address_score(), evidence)


def is_range(df, evidence=None):
    cmp = [F.col(f"cmp{i}") for i in range(len(vocab.COMPARISONS))]
    total = sum(cmp[1:], cmp[0])
    rule = (
        (F.col("hyphen") > 0.4) | (F.col("to") > 0.4) | any_of([c > 0.2 for c in cmp]) | (total > 0.3)
        | ((F.col("units") > 0.5) & ((F.col("hyphen") > 0.1) | (F.col("to") > 0.1) | (total > 0.1))))
    return _text_rule(df, "range", rule, F.greatest(F.col("hyphen"), F.col("to"), total), evidence)


def is_name(df, evidence=None):
    return _text_rule(df, "name", F.col("words").between(1, 4) & (F.col("digits") < 0.05), F.col("words"), evidence)


def categorical_or_text(df, evidence=None):
    """Few distinct values (at most 20 and at most 10% of the rows) read as categories."""
    e = (basic_evidence(df) if evidence is None else evidence).filter(F.col("kind") == "string")
    few = F.col("distinct_values") <= F.least(F.lit(20.0), F.col("rows") * 0.1)
    return e.select("column", F.col("distinct_values").cast("double").alias("evidence"), few.alias("match"))


def infer_roles(df, strict=False):
    """(column, position, role) for every column; the first matching role wins."""
    e = local(basic_evidence(df))
    text = string_columns(df)
    first = [("id", is_id(df, strict, evidence=e)), ("datetime", local(is_datetime(df))), ("binary", is_binary(df, e)), ("likert", local(is_likert(df, e))), ("numeric", is_numeric_role(df))]
    if text:
        te = local(text_evidence(df, text))
        first += [("email", is_email(df, te)), ("phone", is_phone(df, te)), ("gender", is_gender(df, local(gender_evidence(df, text)))), ("range", is_range(df, te)),
                  ("address", is_address(df, te)), ("name", is_name(df, te)), ("url", is_url(df, te))]
    first.append(("categorical", categorical_or_text(df, e)))
    role_names = [role for role, _ in first]
    marks = union_all([v.filter("match").select("column", F.lit(i).alias("rank")) for i, (_, v) in enumerate(first)])
    best = marks.unionByName(e.filter("non_null = 0").select("column", F.lit(-1).alias("rank"))).collect()
    hits, empty = {}, {r["column"] for r in best if r["rank"] < 0}
    for r in sorted((r for r in best if r["rank"] >= 0), key=lambda r: r["rank"]):
        hits.setdefault(r["column"], role_names[r["rank"]])
    rows = [(c, i, hits.get(c) if c not in empty or hits.get(c) in ("datetime", "numeric") else "categorical") for i, c in enumerate(df.columns)]
    rows = [(c, i, r or ("text" if c in text else "categorical")) for c, i, r in rows]
    return df.sparkSession.createDataFrame(rows, "column string, position int, role string")


def columns_by_role(roles):
    """Driver-side {role: [columns]} in table order; bounded by the column count."""
    out = {}
    for r in roles.orderBy("position").collect():
        out.setdefault(r["role"], []).append(r["column"])
    return out


def basic_roles(df):
    """Simple fallback roles: boolean, numeric, datetime, categorical, text."""
    e = basic_evidence(df)
    bools = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    lo, hi = F.col("low").try_cast("double"), F.col("high").try_cast("double")
    zero_one = (F.col("kind") == "numeric") & lo.isin(0.0, 1.0) & hi.isin(0.0, 1.0) & (F.col("distinct_values") <= 2)
    role = (
        F.when(zero_one | F.col("column").isin(bools), "boolean").when(F.col("kind") == "numeric", "numeric").when(F.col("kind") == "datetime", "datetime")
        .when(F.col("distinct_values") < F.least(F.lit(20.0), F.col("rows") * 0.5), "categorical").otherwise("text"))
    return e.select("column", role.alias("role"))


def role_summary(roles):
    """Count, percent and columns of each role."""
    total = roles.count()
    return roles.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns")).withColumn(
        "percent", F.col("n") * (100.0 / max(total, 1)))


DATE_LIKE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}($|\s|T)"


def primitive_types(df):
    """number, date, boolean or string: the first kind that all non-empty values satisfy."""
    words = ["true", "false", "yes", "no", "0", "1", "y", "n"]
    full = lambda c: F.when(col(c).cast("string") != "", col(c).cast("string"))
    date = lambda s: s.try_cast("timestamp").isNotNull() & s.rlike(DATE_LIKE)
    t = metric_table(df, df.columns, {
        "n": lambda c: F.count(full(c)), "number": lambda c: F.bool_and(F.trim(full(c)).try_cast("double").isNotNull()),
        "date": lambda c: F.bool_and(date(full(c))), "boolean": lambda c: F.bool_and(F.lower(full(c)).isin(words))})
    return t.select("column", F.when(F.col("n") == 0, "string").when(F.col("number"), "number").when(F.col("date"), "date").when(F.col("boolean"), "boolean").otherwise("string").alias("type"))


def majority_types(df):
    """numeric, datetime, boolean or text: the most common kind of the values, ties in that order."""
    kinds = {f.name: f.dataType for f in df.schema}

    def kind(c):
        if is_numeric(df.schema[c]):
            return F.when(col(c).isNotNull(), "numeric")
        if isinstance(kinds[c], T.BooleanType):
            return F.when(col(c).isNotNull(), "boolean")
        s = col(c).cast("string")
        date = s.rlike(DATE_LIKE) & F.substring(F.replace(s, F.lit("/"), F.lit("-")), 1, 10).try_cast("date").isNotNull()
        return F.when(date, "datetime").when(F.trim(s).try_cast("double").isNotNull(), "numeric").when(s.isNotNull(), "text")

    order = ("numeric", "datetime", "boolean", "text")
    t = metric_table(df, df.columns, {k: (lambda c, k=k: F.count_if(kind(c) == k)) for k in order})
    top = F.greatest(*order)
    pick = F.when(top == 0, "text")
    for k in order:
        pick = pick.when(F.col(k) == top, k)
    return t.select("column", pick.alias("type"))
