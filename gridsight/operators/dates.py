"""Date parsing, calendar features and gap analysis."""
import itertools
import re

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocab import DATE_FORMATS, MONTH_NAMES
from .common import col, metric_table, small, union_all
from .ordered import over_rows, with_row_index
from .profile import gap_summary, part_counts

# Strptime directives, their Spark pattern letters and the shapes of text they accept (9 a digit, a a letter).
DIRECTIVES = {
    "%Y": ("yyyy", ["9999"]), "%y": ("yy", ["99"]), "%m": ("M", ["9", "99"]), "%d": ("d", ["9", "99"]),
    "%H": ("H", ["9", "99"]), "%M": ("m", ["9", "99"]), "%S": ("s", ["9", "99"]),
    "%b": ("MMM", ["aaa"]), "%B": ("MMMM", ["a" * n for n in range(3, 10)]),
}
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spark_pattern(fmt):
    out = fmt.replace("T%H", "'T'%H")
    for directive, (letters, _) in DIRECTIVES.items():
        out = out.replace(directive, letters)
    return out


def shapes(fmt):
    """Every shape that text in a format can have."""
    parts = re.split("(%[A-Za-z])", fmt.replace("T%H", "a%H"))
    return ["".join(p) for p in itertools.product(*[DIRECTIVES[p][1] if p in DIRECTIVES else [p] for p in parts])]


def shape(c):
    """Text with every digit as 9 and every Latin letter as a."""
    return F.translate(c, DIGITS + LETTERS, "9" * 10 + "a" * 52)


def parse_with(c, fmt, shaped):
    """Timestamp of text in one format, or null; the test of its ``shape`` (a column) avoids costly failed parses."""
    ts = F.try_to_timestamp(c, F.lit(spark_pattern(fmt)))
    if "%y" in fmt:
        # Two-digit years 69 to 99 belong to the last century: 36525 days earlier.
        ts = F.when(F.year(ts) >= 2069, F.timestamp_micros(F.unix_micros(ts) - F.lit(36525 * 86_400_000_000))).otherwise(ts)
    return F.when(shaped.isin(shapes(fmt)), ts)


def clean_date_string(c):
    """Trim, collapse spaces, month names to numbers, drop Vietnamese date words, unify separators."""
    c = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")
    for number in range(12, 0, -1):
        names = "|".join(sorted(MONTH_NAMES[number - 1], key=len, reverse=True))
        c = F.regexp_replace(c, rf"(?iu)(^|[^\p{{L}}])(?:{names})($|[^\p{{L}}\d])", f"$1{number}$2")
    for word in ("ngày", "tháng", "năm"):
        c = F.regexp_replace(c, rf"(?iu){word}\s+(\d+)", "$1")
    return F.regexp_replace(c, r"(\d+)[/.\-](\d+)[/.\-](\d+)", "$1-$2-$3")


def detect_date_format(df, cols):
    """(column, format, matches, total) for the best format of each text column; ``unix`` for epoch digits.

    A format needs 3 matches or half of the values; ties go to the earlier format.
    """
    long = df.select(*[F.trim(col(c).cast("string")).alias(c) for c in cols]).unpivot([], cols, "column", "value").filter(F.col("value").isNotNull())
    v = F.col("value")
    # Each distinct value is read once.
    long = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("_shape", shape(v))
    # One mark per format that reads the value, -1 for epoch digits, and -2 for every value.
    marks = [F.when(parse_with(v, f, F.col("_shape")).isNotNull(), i) for i, f in enumerate(DATE_FORMATS)] + [F.when(v.rlike(r"^\d{9,13}$"), -1), F.lit(-2)]
    counts = long.select("column", "n", F.explode(F.array_compact(F.array(*marks))).alias("i")).groupBy("column", "i").agg(F.sum("n").alias("n"))
    at = lambda i: F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0))
    names = F.array(*[F.lit(f) for f in DATE_FORMATS])
    best = F.max(F.when(F.col("i") >= 0, F.struct("n", (-F.col("i")).alias("rank"), F.get(names, F.greatest("i", F.lit(0))).alias("format"))))
    t = counts.groupBy("column").agg(at(-2).alias("total"), at(-1).alias("unix"), best.alias("_b"))
    unix = F.col("unix") > 0.7 * F.col("total")
    enough = (F.col("_b.n") >= 3) | (F.col("_b.n") > 0.5 * F.col("total"))
    return t.select(
        "column", F.when(unix, "unix").when(enough, F.col("_b.format")).alias("format"),
        F.when(unix, F.col("unix")).when(enough, F.col("_b.n")).otherwise(0).alias("matches"), "total")


# The format each order of day, month name and year stands for; M marks a month name.
MONTH_NAME_ORDERS = [("%d %b %Y", r"\d{1,2}\s+M\s+\d{4}"), ("%b %d %Y", r"M\s+\d{1,2}\s*,?\s+\d{4}"), ("%Y %b %d", r"\d{4}\s+M\s+\d{1,2}")]
DATE_DELIMITERS = ["-", "/", ".", " "]


def _text_values(df, cols):
    return df.select(*[F.trim(col(c).cast("string")).alias(c) for c in cols]).unpivot([], cols, "column", "value").filter("value <> ''")


def detect_by_month_names(df, cols):
    """(column, format, matches, total): the most frequent order of day, month name (English, Vietnamese, French) and year;
    ties go to the earlier order, and a column without month names has no format."""
    names = "|".join(sorted((n for months in MONTH_NAMES for n in months), key=lambda n: (-len(n), n)))
    marked = F.regexp_replace(F.lower("value"), rf"(^|[^\p{{L}}])(?:{names})(?=$|[^\p{{L}}])", "$1M")
    order = F.coalesce(*[F.when(F.col("m").rlike(pattern), i) for i, (_, pattern) in enumerate(MONTH_NAME_ORDERS)])
    seen = _text_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("m", marked)
    counts = seen.groupBy("column", order.alias("i")).agg(F.sum("n").alias("n"))
    best = F.max(F.when(F.col("i").isNotNull(), F.struct("n", (-F.col("i")).alias("rank"))))
    t = counts.groupBy("column").agg(best.alias("b"), F.sum("n").alias("total"))
    return t.select("column", F.get(F.array(*[F.lit(f) for f, _ in MONTH_NAME_ORDERS]), -F.col("b.rank")).alias("format"), F.coalesce("b.n", F.lit(0)).alias("matches"), "total")


def detect_by_delimiter(df, cols):
    """(column, format): order and delimiter of all-number dates. The delimiter must occur 0.7 times per value on average;
    days come first unless second numbers above 12, and no first ones, say otherwise."""
    v = F.col("value")
    part = lambda i: F.regexp_extract(v, r"^(\d{1,4})[-/. ](\d{1,2})[-/. ](\d{1,4})", i)
    marks = [F.sum(F.length(v) - F.length(F.translate(v, d, ""))).alias(f"d{i}") for i, d in enumerate(DATE_DELIMITERS)]
    t = _text_values(df, cols).groupBy("column").agg(
        *marks, F.count(F.lit(1)).alias("total"), F.count_if(part(1) != "").alias("read"), F.count_if(F.length(part(1)) == 4).alias("year_first"),
        F.count_if(F.length(part(3)) == 4).alias("year_last"), F.max(part(1).try_cast("int")).alias("a"), F.max(part(2).try_cast("int")).alias("b"))
    main = F.greatest(*[F.struct(F.col(f"d{i}").alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("mark")) for i, d in enumerate(DATE_DELIMITERS)])
    t = t.withColumn("main", main)
    year = F.when(F.col("year_last") > 0, "%Y").otherwise("%y")
    order = F.when(2 * F.col("year_first") > F.col("read"), F.array(F.lit("%Y"), F.lit("%m"), F.lit("%d"))).when(
        (F.col("b") > 12) & (F.col("a") <= 12), F.array(F.lit("%m"), F.lit("%d"), year)).otherwise(F.array(F.lit("%d"), F.lit("%m"), year))
    known = (F.col("main.n") >= 0.7 * F.col("total")) & (2 * F.col("read") > F.col("total"))
    return t.select("column", F.when(known, F.concat(F.get(order, F.lit(0)), F.col("main.mark"), F.get(order, F.lit(1)), F.col("main.mark"), F.get(order, F.lit(2)))).alias("format"), F.col("read").alias("matches"), "total")


def date_label(c):
    """Kind of date text: timestamp, iso, dmy, mdy, ymd or unknown. The patterns of the kinds."""
    c = F.trim(c)
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    valid = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    return (
        F.when(c.rlike(r"^\d{9,13}$"), "timestamp").when(iso & valid, "iso")
        .when(c.rlike(r"^\d{1,2}[/\s.\-](\d{1,2}|[a-zA-Z]{3,})[/\s.\-]\d{2,4}"), "dmy")
        .when(c.rlike(r"^(\d{1,2}|[a-zA-Z]{3,})[/\s.\-]\d{1,2}[/\s.\-]\d{2,4}"), "mdy")
        .when(c.rlike(r"^\d{4}[/\s.\-](\d{1,2}|[a-zA-Z]{3,})[/\s.\-]\d{1,2}"), "ymd")
        .otherwise("unknown"))


def majority_date_label(df, cols):
    """The label of more than half of a column's values, else ``mixed``."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), date_label(col(c)).alias("label"), col(c).isNotNull().alias("ok")) for c in cols])).alias("_s")).select("_s.*")
    counts = long.filter("ok").groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg"), "label")).alias("b"), F.sum("n").alias("total"))
    share = -F.col("b.neg") / F.col("total")
    return best.select("column", F.when(share > 0.5, F.col("b.label")).otherwise("mixed").alias("label"), share.alias("share"))


def epoch_timestamp(v):
    """Seconds, milli-, micro- or nanoseconds since 1970, told apart by size (largest unit first)."""
    micros = (F.when(v > 1e18, v / 1000).when(v > 1e15, v).when(v > 1e12, v * 1000).otherwise(v * 1000000)).cast("long")
    return F.timestamp_micros(micros)


def excel_timestamp(v):
    """Spreadsheet day number (0 to 60000); day 0 is 1899-12-30."""
    return F.timestamp_micros(((v - 25569) * F.lit(86400000000)).cast("long"))


def column_formats(df, cols):
    """{column: format} of text columns with a detected format: one job for all of them."""
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    found = detect_date_format(df, texts).collect() if texts else []
    return {r["column"]: r["format"] for r in found if r["format"] not in (None, "unix")}


def to_timestamp_smart(df, c, formats=None, first=None):
    """Replace a column with timestamps; values no rule reads become null.

    The column's own format is tried first (``first``; detected where neither it nor ``formats`` is given), so days up to 12
    are read like the others. Further formats only serve values which that one cannot read.
    """
    kind = df.schema[c].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(c, col(c).cast("timestamp"))
    if isinstance(kind, T.NumericType):
        v = col(c).cast("double")
        return df.withColumn(c, F.when(v.between(0, 60000), excel_timestamp(v)).otherwise(epoch_timestamp(v)))
    text = F.trim(col(c))
    digits = F.when(text.rlike(r"^\d{9,19}$"), epoch_timestamp(text.try_cast("double")))
    serial = F.when(text.rlike(r"^\d{5}(\.\d+)?$"), excel_timestamp(text.try_cast("double")))
    if formats is None and first is None:
        first = column_formats(df, [c]).get(c)
    order = [*([first] if first else []), *[f for f in (formats or DATE_FORMATS) if f != first]]
    parsed = [parse_with(text, f, F.col("_shape")) for f in order]
    return df.withColumn("_shape", shape(text)).withColumn(c, F.coalesce(digits, *parsed, serial)).drop("_shape")


def datetime_share(df, cols, threshold=0.85):
    """Share of non-null values that read as dates, and whether it reaches the threshold."""
    typed = {f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))}
    probe = df.select(*[col(c).alias(c) for c in cols])
    own = column_formats(probe, cols)
    for c in cols:
        probe = to_timestamp_smart(probe.withColumn(f"{c}__raw", col(c)), c, first=own.get(c, DATE_FORMATS[0]))
    t = metric_table(probe, cols, {
        "share": lambda c: F.when(F.count(col(f"{c}__raw")) > 0, F.lit(1.0) if c in typed else F.count(col(c)) / F.count(col(f"{c}__raw"))).otherwise(0.0)})
    return t.withColumn("is_datetime", F.col("share") >= threshold)


def calendar_features(df, c):
    """Year to weekday, ISO week, and period-edge flags. ``is_month_start`` covers the first 7 days."""
    ts = col(c)
    month_end = F.dayofmonth(ts) == F.dayofmonth(F.last_day(ts))
    return df.withColumns({
        f"{c}_year": F.year(ts), f"{c}_month": F.month(ts), f"{c}_day": F.dayofmonth(ts), f"{c}_dayofweek": F.weekday(ts),
        f"{c}_quarter": F.quarter(ts), f"{c}_weekofyear": F.weekofyear(ts), f"{c}_dayofyear": F.dayofyear(ts),
        f"{c}_is_weekend": (F.weekday(ts) >= 5).cast("int"), f"{c}_is_month_end": month_end.cast("int"),
        f"{c}_is_month_start": (F.dayofmonth(ts) <= 7).cast("int"),
        f"{c}_is_quarter_end": (month_end & F.month(ts).isin(3, 6, 9, 12)).cast("int"),
    })


def time_features(df, c):
    """Hour, minute, business hour and time of day; added only when some value has an hour."""
    ts = col(c)
    if df.filter(F.hour(ts) != 0).isEmpty():
        return df
    h = F.hour(ts)
    part = F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon").when((h >= 17) & (h < 22), "evening").when(h.isNotNull(), "night").otherwise("unknown")
    return df.withColumns({
        f"{c}_hour": h, f"{c}_minute": F.minute(ts), f"{c}_business_hour": ((h >= 8) & (h < 18)).cast("int"), f"{c}_time_of_day": part})


def holiday_flags(df, c, holidays):
    """On, before and after a holiday; ``holidays`` holds one column of dates supplied by the user."""
    day = holidays.columns[0]
    marks = union_all([
        holidays.select(F.date_sub(F.col(day), back).alias("_day"), *[F.lit(int(i == j)).alias(f"_h{j}") for j in range(3)])
        for i, back in enumerate((0, 1, -1))])
    marks = small(marks.groupBy("_day").agg(*[F.max(f"_h{j}").alias(f"_h{j}") for j in range(3)]))
    out = df.join(marks, F.to_date(col(c)) == F.col("_day"), "left")
    names = ("is_holiday", "is_before_holiday", "is_after_holiday")
    return out.withColumns({f"{c}_{n}": F.coalesce(F.col(f"_h{j}"), F.lit(0)) for j, n in enumerate(names)}).drop("_day", "_h0", "_h1", "_h2")


def cyclical_features(df, c):
    """Sine and cosine of month, weekday, day in month, day of year and (where present) hour."""
    ts = col(c)
    turns = {
        "month": F.month(ts) / 12, "dow": F.weekday(ts) / 7, "dom": F.dayofmonth(ts) / F.dayofmonth(F.last_day(ts)),
        "doy": F.dayofyear(ts) / 365}
    if not df.filter(F.hour(ts) != 0).isEmpty():
        turns["hour"] = F.hour(ts) / 24
    return df.withColumns({f"{c}_{k}_{fn}": getattr(F, fn)(2 * F.pi() * t) for k, t in turns.items() for fn in ("sin", "cos")})


def lag_features(df, cols, order, by=(), lags=(1, 7, 30)):
    """Earlier values of each column by row position; ``order`` ends in a tie key."""
    indexed = with_row_index(df, order, by)
    exprs = {f"{c}_lag_{k}": (lambda w, c=c, k=k: F.lag(col(c), k).over(w)) for c in cols for k in lags}
    return over_rows(indexed, exprs, by, before=max(lags)).drop("row_index")


def date_distribution(df, c):
    """Counts per year, month, weekday and hour with the range of the column."""
    ts = col(c)
    span = df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.date_diff(F.max(ts), F.min(ts)).alias("range_days")).withColumn("column", F.lit(c))
    return part_counts(df, [c]).join(F.broadcast(span), "column")


def gap_stats(df, c):
    """Gap statistics with coefficient of variation and regularity (1 is perfectly even)."""
    cv = F.col("gap_std_pop") / F.col("gap_mean")
    return gap_summary(df, c).select(
        "column", "gap_min", "gap_max", "gap_mean", "gap_median", F.col("gap_std_pop").alias("gap_std"), cv.alias("cv"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.least(F.lit(1.0), cv / 3))).alias("regularity"))


def frequency_name(seconds):
    """Name of the sampling frequency for a median gap in seconds."""
    hours, days = seconds / 3600, seconds / 86400
    months, years = days / 30.44, days / 365.25
    every = lambda n, unit: F.concat(F.round(n).cast("int").cast("string"), F.lit(unit))
    return (
        F.when(seconds <= 1, "secondly").when(seconds <= 60, "minutely").when(hours <= 1, "hourly")
        .when(hours.between(3.5, 4.5), "4-hourly").when(hours.between(5.5, 6.5), "6-hourly").when(hours.between(11.5, 12.5), "12-hourly")
        .when(hours <= 24, "hourly").when(days <= 1.5, "daily").when(days.between(6.5, 7.5), "weekly").when(days <= 7.5, every(days, "-daily"))
        .when(days.between(13, 16), "bi-weekly").when(days.between(29, 31), "monthly").when(days <= 31, every(days, "-daily"))
        .when(months <= 1.5, "monthly").when(months <= 3.5, every(months, "-monthly")).when(months.between(5.5, 6.5), "semi-annually")
        .when(months <= 12, every(months, "-monthly")).when(months.between(11.5, 12.5), "yearly")
        .when(years > 1, every(years, "-yearly")).otherwise(every(months, "-monthly")))


def count_seasonality(df, c):
    """Variation of row counts by weekday, month and quarter with peaks, and shares of special days."""
    ts = col(c)
    limits = {"day_of_week": (F.weekday(ts), 0.5, 2), "month": (F.month(ts), 0.3, 3), "quarter": (F.quarter(ts), 0.2, 2)}
    long = df.filter(ts.isNotNull()).select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), e.alias("value"), F.lit(limit).alias("cut"), F.lit(n).alias("peaks")) for k, (e, limit, n) in limits.items()])).alias("_s")).select("_s.*")
    counts = long.groupBy("part", "value", "cut", "peaks").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "value"))), F.lit(1), F.first("peaks")), lambda s: s["value"].cast("string"))
    g = counts.groupBy("part").agg((F.stddev_samp("n") / F.avg("n")).alias("variation"), F.first("cut").alias("cut"), ranked.alias("top"), F.count(F.lit(1)).alias("k"))
    cv = g.filter("k > 1").select("part", "variation", (F.col("variation") > F.col("cut")).alias("has_pattern"), F.array_join("top", ",").alias("peaks"))
    end = F.dayofmonth(ts) == F.dayofmonth(F.last_day(ts))
    mean = lambda cond: F.avg(cond.cast("double"))
    days = df.agg(mean(F.dayofmonth(ts) == 1).alias("start"), mean(end).alias("end"), mean(end & F.month(ts).isin(3, 6, 9, 12)).alias("quarter"))
    special = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(v).alias("variation"), (F.col(v) > cut).alias("has_pattern"), F.lit("").alias("peaks"))
                                  for k, v, cut in (("month_start", "start", 0.4), ("month_end", "end", 0.4), ("quarter_end", "quarter", 0.2))]))
    return cv.unionByName(days.select(special.alias("_s")).select("_s.*"))


def date_difference(df, a, b):
    """Hours from a to b, and whether they are consistent."""
    from .quantiles import median_table
    hours = df.select(((F.unix_micros(col(b).cast("timestamp")) - F.unix_micros(col(a).cast("timestamp"))) / 3.6e9).alias("hours"))
    t = hours.agg(F.avg("hours").alias("mean"), F.stddev_samp("hours").alias("std"), F.count("hours").alias("n")).withColumn("column", F.lit("hours"))
    t = t.join(F.broadcast(median_table(hours, ["hours"]).drop("n")), "column")
    even = (F.abs("std") < F.abs("mean") * 0.2) & (F.abs(F.col("mean") - F.col("median")) < F.abs("mean") * 0.1)
    return t.select("n", "mean", "median", "std", even.alias("consistent"))


def durations(df, start, end, group):
    """Task lengths in hours with the chart range (padded by 5%) and the task's group."""
    ms = lambda c: F.unix_micros(col(c).cast("timestamp"))
    span = df.agg(F.min(ms(start)).alias("lo"), F.max(ms(end)).alias("hi")).first()
    pad = int(((span["hi"] or 0) - (span["lo"] or 0)) * 0.05)
    edge = lambda v: F.timestamp_micros(F.lit(v))
    return df.withColumns({
        "duration_hours": (ms(end) - ms(start)) / 3.6e9, "group": F.coalesce(col(group).cast("string"), F.lit("Default")),
        "range_start": edge((span["lo"] or 0) - pad), "range_end": edge((span["hi"] or 0) + pad)})
