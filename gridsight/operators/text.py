"""Text statistics, normalisation and rule-based tagging, all as column expressions."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vocab, wording
from .common import any_of, as_double, col, metric_table, small, text_metrics
from .profile import range_bounds, word_count


def tokens(df, c, pattern=wording.TOKEN):
    """One row per lower-case word."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(col(c)), F.lit(pattern), F.lit(0))).alias("word"))


def word_counts(df, c, top=20, stop_words=(), min_length=1, pattern=wording.TOKEN):
    """The most frequent words; ties in alphabetical order."""
    words = tokens(df, c, pattern).filter(F.length("word") >= min_length)
    if stop_words:
        words = words.filter(~F.col("word").isin(list(stop_words)))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(top)


def word_cloud(df, c, top=100):
    return word_counts(df, c, top, wording.CLOUD_STOP_WORDS, 2)


def common_words(df, c, top=5):
    """Top words with their percent of all counted words."""
    words = tokens(df, c).filter((F.length("word") > 2) & ~F.col("word").isin(wording.COMMON_STOP_WORDS))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.orderBy(F.desc("n"), "word").limit(top).withColumn("percent", F.col("n") * (100.0 / total))


def length_stats(df, cols):
    size = lambda c: F.length(col(c))
    words = lambda c: word_count(col(c))
    return text_metrics(df, cols, {
        "mean_length": lambda c: F.avg(size(c)), "std_length": lambda c: F.stddev_samp(size(c)), "min_length": lambda c: F.min(size(c)),
        "max_length": lambda c: F.max(size(c)), "mean_words": lambda c: F.avg(words(c)), "std_words": lambda c: F.stddev_samp(words(c))})


def length_shares(df, cols):
    """Percent of texts with at most 3 and with at least 50 words."""
    share = lambda cond: 100 * F.avg(cond.cast("double"))
    return text_metrics(df, cols, {"short_percent": lambda c: share(word_count(col(c)) <= 3), "long_percent": lambda c: share(word_count(col(c)) >= 50)})


def extract_range(df, c):
    lo, hi = range_bounds(c)
    return df.withColumns({"range_lo": lo, "range_hi": hi})


def range_widths(df, c):
    """Width statistics of interval text; consistent when at least 10 widths vary by less than 20%."""
    lo, hi = range_bounds(c)
    t = df.select((hi - lo).alias("w")).agg(
        F.count("w").alias("n"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"), F.min("w").alias("min"), F.max("w").alias("max"))
    return t.withColumn("consistent", F.coalesce((F.col("n") >= 10) & (F.col("std") / F.col("mean") < 0.2), F.lit(False)))


def gender_class(c):
    v = F.lower(F.trim(c))
    return F.when(v.isin(vocab.MALE_WORDS), "male").when(v.isin(vocab.FEMALE_WORDS), "female").when(v.isNotNull(), "other")


def gender_shares(df, c):
    """Counts and shares of male and female spellings, of other values, and the male to female ratio."""
    g = gender_class(col(c))
    n = lambda k: F.count_if(g == k)
    t = df.agg(n("male").alias("male"), n("female").alias("female"), n("other").alias("other"), F.count(F.lit(1)).alias("rows"))
    known = F.col("male") + F.col("female")
    pct = lambda x, whole: F.when(whole > 0, 100.0 * x / whole).otherwise(0.0)
    return t.select("male", "female", "other", pct(F.col("male"), known).alias("male_percent"), pct(F.col("female"), known).alias("female_percent"),
                    pct(F.col("other"), F.col("rows")).alias("other_percent"), F.when(F.col("female") > 0, F.col("male") / F.col("female")).alias("ratio"))


def display_name(c):
    """``order_total`` or ``orderTotal`` as ``Order Total``."""
    spaced = F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.initcap(F.trim(spaced))


def is_valid(c, kind):
    return c.rlike({"email": vocab.EMAIL, "phone": vocab.PHONE, "url": vocab.URL}[kind])


def digit_lengths(df, c):
    """Number of values per count of digits."""
    return df.filter(col(c).isNotNull()).groupBy(F.length(F.regexp_replace(col(c), r"\D", "")).alias("digits")).agg(F.count(F.lit(1)).alias("n"))


def parse_metadata(df, c, schema, name="metadata"):
    """JSON text as a struct; unreadable text gives a struct of nulls."""
    empty = F.from_json(F.lit("{}"), schema)
    return df.withColumn(name, F.coalesce(F.from_json(col(c), schema), empty))


def row_text(df, cols, preview=200):
    """``col: value, ...`` per row, cut to a preview that ends in dots when longer."""
    doc = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(col(c).cast("string"), F.lit("null"))) for c in cols])
    return df.withColumn("document", doc).withColumn(
        "preview", F.when(F.length("document") > preview, F.concat(F.substring("document", 1, preview), F.lit("..."))).otherwise(F.col("document")))


def phone_country(df, c, codes=None):
    """Country of a number written with a leading plus, by its longest known calling code."""
    codes = codes or wording.CALLING_CODES
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    digits = F.regexp_replace(F.regexp_extract(col(c), r"^\+([\d\s().-]+)", 1), r"\D", "")
    found = F.coalesce(*[F.try_element_at(table, F.substring(digits, 1, n)) for n in range(max(map(len, codes)), 0, -1)])
    return df.withColumn("country", F.coalesce(found, F.lit("Unknown")))


def bin_label(lo, hi):
    return F.format_string("%.2f - %.2f", lo, hi)


# ---- tagging


def _scores(text, intents):
    """Number of patterns found per intent."""
    return {k: sum((text.rlike(p).cast("int") for p in patterns[1:]), text.rlike(patterns[0]).cast("int")) for k, patterns in intents.items()}


def _first_best(df, names, default):
    """The name with the highest score column; ties go to the earlier name."""
    best = F.greatest(*[F.col(f"_s_{n}") for n in names])
    pick = F.when(best == 0, F.lit(default))
    for n in names:
        pick = pick.when(F.col(f"_s_{n}") == best, F.lit(n))
    return best, pick


def tag_intent(df, c):
    """Intent of a question and a confidence of 0.5 plus 0.1 per pattern found, at most 0.95."""
    text = F.lower(col(c))
    scored = df.withColumns({f"_s_{k}": v for k, v in _scores(text, wording.INTENTS).items()})
    best, pick = _first_best(scored, wording.INTENTS, "question")
    out = scored.withColumns({"intent": pick, "confidence": F.when(best > 0, F.least(0.5 + 0.1 * best, F.lit(0.95))).otherwise(0.4)})
    return out.drop(*[f"_s_{k}" for k in wording.INTENTS])


def mentioned_columns(df, c, columns):
    """Names from a known list that the text contains, in list order."""
    text = F.lower(col(c))
    return df.withColumn("mentioned", F.array_compact(F.array(*[F.when(text.contains(n.lower()), F.lit(n)) for n in columns])))


def _keyword(text, table):
    pick = None
    for name, words in table:
        hit = any_of([text.contains(w) for w in words])
        pick = F.when(hit, name) if pick is None else pick.when(hit, name)
    return pick


def tag_chart_type(df, c):
    return df.withColumn("chart_type", _keyword(F.lower(col(c)), wording.CHART_KEYWORDS.items()))


def choose_columns(df, c, roles):
    """Columns that suit the wording of a question; ``roles`` is {role: [columns]}."""
    num, dates, cats = (roles.get(k, []) for k in ("numeric", "datetime", "categorical"))
    text = F.lower(col(c))
    says = lambda *words: any_of([text.contains(w) for w in words])
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    fallback = (num[:2] if len(num) > 1 else num[:1] + (dates[:1] or cats[:1])) or [None]
    rules = []
    if dates and num:
        rules.append((says("time", "trend", "over time", "timeseries", "series"), names(dates[0], num[0])))
    if len(num) >= 2:
        rules.append((says("correlation", "relationship", "compare", "versus", "vs"), names(*num[:2])))
    if num:
        rules.append((says("distribution", "histogram", "frequency"), names(num[0])))
    otherwise = names(cats[0], num[0]) if cats and num else F.array_compact(names(*fallback))
    pick = otherwise
    for cond, value in reversed(rules):
        pick = F.when(cond, value).otherwise(pick)
    return df.withColumn("chosen", pick)


def intent_from_sql(df, question, sql):
    """Intent, operation, columns and chart type of a question with its SQL."""
    q, s = F.lower(col(question)), F.lower(col(sql))
    hit = lambda p: (q.rlike(p) | s.rlike(p)).cast("int")
    scored = df.withColumns({f"_s_{k}": sum((hit(p) for p in v[1:]), hit(v[0])) for k, v in wording.SQL_INTENTS.items()})
    _, intent = _first_best(scored, wording.SQL_INTENTS, "question")
    says = lambda w: q.contains(w)
    count = F.when(s.rlike(r"select\s+count\(") | says("how many"), "count").when(s.rlike(r"select\s+(avg|average|mean)\(") | says("average"), "average").when(
        s.rlike(r"select\s+sum\(") | says("sum") | says("total"), "sum").when(s.rlike(r"select\s+max\(") | says("maximum"), "max").when(
        s.rlike(r"select\s+min\(") | says("minimum"), "min").otherwise("query")
    study = F.when(s.contains("group by"), "group").when(s.contains("order by"), "sort").when(says("compare"), "compare").otherwise("analyze")
    i = F.col("intent")
    operation = F.when(i == "question", count).when(i == "visualization", "visualize").when(i == "analysis", study).when(i == "insight", "insight").otherwise("predict")
    found = F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in wording.SQL_COLUMNS])
    plain = F.transform(F.filter(found, lambda x: ~x.isin(wording.SQL_KEYWORDS)), lambda x: F.element_at(F.split(x, r"\."), -1))
    chart = F.when(i == "visualization", F.coalesce(_keyword(q, wording.SQL_CHARTS.items()), F.lit("bar")))
    out = scored.withColumn("intent", intent).withColumns({"operation": operation, "columns": F.array_sort(F.array_distinct(plain)), "chart_type": chart})
    return out.drop(*[f"_s_{k}" for k in wording.SQL_INTENTS])


def coarse_intent(df, label, text, mapping):
    """Map fine labels to coarse intents, with a chart type for visualization questions."""
    from .relational import map_labels
    out = map_labels(df, label, mapping, name="intent")
    chart = F.coalesce(_keyword(F.lower(col(text)), wording.LABEL_CHARTS), F.lit("bar"))
    return out.withColumn("chart_type", F.when(F.col("intent") == "visualization", chart))


def format_prompts(df):
    """Question and expected JSON reply of labelled rows (query, intent, entities, chart_type)."""
    reply = F.to_json(F.struct("intent", F.lit(0.9).alias("confidence"), "entities", F.when(F.col("intent") == "visualization", F.col("chart_type")).alias("visualization_type")))
    return df.withColumn("prompt", F.concat(F.lit("<user>\n"), F.col("query"), F.lit("\n</user>\n<assistant>\n"), reply, F.lit("\n</assistant>")))


def extract_commands(df, c, keep):
    """(keep..., type, tool, columns, chart_type): tool calls, chart requests, chart calls and insight calls in text."""
    text = col(c)
    nothing = F.lit(None).cast("string")
    params = lambda s, brk: F.transform(F.split(s, brk), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    make = lambda kind, tool, cols, chart: F.struct(kind.alias("type"), tool.alias("tool"), cols.alias("columns"), chart.alias("chart_type"))
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    action = lambda m: F.regexp_extract(m, r"Action: (\w+)", 1)
    kind = lambda a: F.when(a.isin(wording.CHART_ACTIONS), "visualization").when(a.isin(wording.INSIGHT_ACTIONS), "insight").otherwise("tool")
    given = lambda m: params(F.regexp_extract(m, r"(?s)Action Input: (.+)$", 1), ",")
    calls = F.transform(every("(?s)" + wording.ACTION, 0), lambda m: make(kind(action(m)), action(m), given(m), nothing))
    asks = [F.transform(every(p, 1), lambda m: make(F.lit("visualization"), nothing, params(m, wording.PARAMETER_BREAK), F.lit("auto"))) for p in wording.CHART_REQUESTS]
    charts = F.transform(every(wording.CHART_CALL, 0), lambda m: make(
        F.lit("visualization"), nothing, params(F.regexp_extract(m, r"\(\s*([^)]+)\)", 1), ","), F.lower(F.regexp_extract(m, r"^(\w+)", 1))))
    insights = F.transform(every(wording.INSIGHT_CALL, 1), lambda m: make(F.lit("insight"), nothing, F.when(m != "", params(m, ",")).otherwise(F.array().cast("array<string>")), nothing))
    return df.select(*keep, F.explode(F.concat(calls, *asks, charts, insights)).alias("_c")).select(*keep, "_c.*")


def parse_insight_blocks(df, c, keep):
    """(keep..., title, type, content, importance, columns) from blank-line separated TITLE / TYPE / CONTENT blocks."""
    blocks = df.select(*keep, F.explode(F.split(F.trim(col(c)), r"\n\n")).alias("_b"))
    field = lambda name: F.trim(F.regexp_extract("_b", rf"(?m)^{name}:(.*)$", 1))
    kind = F.upper(field("TYPE"))
    pick = None
    for t in wording.BLOCK_TYPES:
        pick = F.when(kind.contains(t), t.lower()) if pick is None else pick.when(kind.contains(t), t.lower())
    level = F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(field("IMPORTANCE").try_cast("int"), F.lit(5))))
    cols = F.when(field("COLUMNS") != "", F.transform(F.split(field("COLUMNS"), ","), lambda v: F.trim(v))).otherwise(F.array().cast("array<string>"))
    out = blocks.select(*keep, field("TITLE").alias("title"), pick.otherwise("summary").alias("type"), field("CONTENT").alias("content"), level.alias("importance"), cols.alias("columns"))
    return out.filter((F.col("title") != "") & (F.col("content") != ""))


def conversation_summary(df, conv, turn, role, text):
    """Messages per conversation and role, with the last message; one partial aggregate, no sorting."""
    return df.groupBy(conv).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(col(role) == "user").alias("user_messages"), F.count_if(col(role) == "assistant").alias("assistant_messages"),
        F.max(turn).alias("last_turn"), F.max_by(role, turn).alias("last_role"), F.max_by(text, turn).alias("last_message"))


def history(df, conv, turn, limit, offset=0):
    """Newest messages first within each conversation, a page of ``limit`` after ``offset``."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    ranked = df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= offset + limit)
    return ranked.filter(F.col("recency") > offset)
