"""Queries for date and time operators."""
from pyspark.sql import functions as F

from . import query, table
from .planted import MIXED_SQL, mixed_dates
from .profiles import PARTS, gap_sql
from ..functions import vocab
from ..operators import dates as d
from ..operators.common import col, round_doubles

MIXED = f"(SELECT o_orderkey, o_orderdate, {MIXED_SQL} AS stamp FROM orders)"
WORDY = {
    "spark": """CASE o_orderkey % 4 WHEN 0 THEN concat('  ', date_format(o_orderdate,'d'), ' January   ', date_format(o_orderdate,'yyyy'), ' ')
      WHEN 1 THEN concat('ngày ', date_format(o_orderdate,'d'), ' tháng ', date_format(o_orderdate,'M'), ' năm ', date_format(o_orderdate,'yyyy'))
      WHEN 2 THEN concat(date_format(o_orderdate,'d'), ' Août ', date_format(o_orderdate,'yyyy')) ELSE date_format(o_orderdate,'dd/MM/yyyy') END""",
    "sql": """CASE o_orderkey % 4 WHEN 0 THEN concat('  ', day(o_orderdate), ' January   ', year(o_orderdate), ' ')
      WHEN 1 THEN concat('ngày ', day(o_orderdate), ' tháng ', month(o_orderdate), ' năm ', year(o_orderdate))
      WHEN 2 THEN concat(day(o_orderdate), ' Août ', year(o_orderdate)) ELSE strftime(o_orderdate,'%d/%m/%Y') END""",
}


@query(f"""SELECT o_orderkey, w AS raw, CASE o_orderkey % 4 WHEN 0 THEN concat(day(o_orderdate),' 1 ',year(o_orderdate)) WHEN 1 THEN concat(day(o_orderdate),' ',month(o_orderdate),' ',year(o_orderdate))
   WHEN 2 THEN concat(day(o_orderdate),' 8 ',year(o_orderdate)) ELSE strftime(o_orderdate,'%d-%m-%Y') END AS cleaned FROM (SELECT *, {WORDY['sql']} AS w FROM orders)""")
def d1_clean_date_string(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(WORDY["spark"]).alias("raw"))
    return o.withColumn("cleaned", d.clean_date_string(F.col("raw")))


def formatted(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("slash"),
        F.date_format("o_orderdate", "dd-MMM-yy").alias("short"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string").alias("epoch"),
        F.date_format("o_orderdate", "MMMM d yyyy").alias("long"), F.col("o_orderpriority").alias("other"))


FORMATTED = """(SELECT strftime(o_orderdate,'%Y-%m-%d') AS iso, strftime(o_orderdate,'%d/%m/%Y') AS slash, strftime(o_orderdate,'%d-%b-%y') AS short,
   CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS epoch, strftime(o_orderdate,'%B %-d %Y') AS long, o_orderpriority AS other FROM orders)"""


# Shapes as patterns, for the SQL side only.
SHAPE = {"%Y": "[0-9]{4}", "%y": "[0-9]{2}", "%m": "[0-9]{1,2}", "%d": "[0-9]{1,2}", "%H": "[0-9]{1,2}", "%M": "[0-9]{1,2}", "%S": "[0-9]{1,2}", "%b": "[A-Za-z]{3}", "%B": "[A-Za-z]{3,9}"}


def pattern(fmt):
    out = fmt.replace(".", "[.]")
    for k, v in SHAPE.items():
        out = out.replace(k, v)
    return out


def best_format(c):
    counts = " UNION ALL ".join(f"SELECT {i} AS i, '{f}' AS f, count(try_strptime({c}, '{f}')) FILTER (WHERE regexp_matches({c}, '^{pattern(f)}$')) AS n FROM {FORMATTED}" for i, f in enumerate(vocab.DATE_FORMATS))
    return f"""SELECT '{c}' AS "column", CASE WHEN u > 0.7*t THEN 'unix' WHEN n >= 3 THEN f END AS format, CASE WHEN u > 0.7*t THEN u WHEN n >= 3 THEN n ELSE 0 END AS matches, t AS total
      FROM (SELECT count(*) t, count(*) FILTER (WHERE regexp_matches({c}, '^[0-9]{{9,13}}$')) u FROM {FORMATTED}), (SELECT * FROM ({counts}) ORDER BY n DESC, i LIMIT 1)"""


@query(" UNION ALL ".join(best_format(c) for c in ("iso", "slash", "short", "epoch", "long", "other")))
def d2_detect_date_format(spark, sf):
    t = formatted(spark, sf)
    return d.detect_date_format(t, t.columns)


LABEL = "CASE o_orderkey % 5 WHEN 0 THEN 'iso' WHEN 1 THEN 'dmy' WHEN 2 THEN 'dmy' WHEN 3 THEN 'timestamp' ELSE 'unknown' END"


@query(f"SELECT o_orderkey, stamp, {LABEL} AS label FROM {MIXED}")
def d4_date_label(spark, sf):
    return mixed_dates(spark, sf).select("o_orderkey", "stamp", d.date_label(F.col("stamp")).alias("label"))


@query(f"""SELECT 'stamp' AS "column", CASE WHEN max(n)/sum(n) > 0.5 THEN 'dmy' ELSE 'mixed' END AS label, round(max(n)/sum(n),4) AS share FROM (SELECT {LABEL} l, count(*) n FROM orders GROUP BY 1)
   UNION ALL SELECT 'iso', 'iso', 1.0""")
def d5_majority_date_label(spark, sf):
    t = mixed_dates(spark, sf).withColumn("iso", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return round_doubles(d.majority_date_label(t, ["stamp", "iso"]))


@query(f"SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS stamp FROM {MIXED}")
def d6_to_timestamp_smart(spark, sf):
    return d.to_timestamp_smart(mixed_dates(spark, sf), "stamp").select("o_orderkey", "stamp")


@query("""SELECT 'en' AS "column", '%Y %b %d' AS format, count(*) AS matches, count(*) AS total FROM orders UNION ALL SELECT 'vi', '%b %d %Y', count(*) FILTER (WHERE o_orderkey % 4 <> 0), count(*) FROM orders
   UNION ALL SELECT 'fr', '%d %b %Y', count(*), count(*) FROM orders UNION ALL SELECT 'none', NULL, 0, count(*) FROM orders""")
def d3_detect_by_month_names(spark, sf):
    vi, fr = ["tháng một", "tháng mười hai", "th3"], ["janvier", "août", "déc"]
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 3).cast("int"))
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    t = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy MMMM d").alias("en"), F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.concat_ws(" ", pick(vi), F.concat(day, F.lit(",")), year)).alias("vi"),
        F.concat_ws(" ", day, pick(fr), year).alias("fr"), F.lit("no month here").alias("none"))
    return d.detect_by_month_names(t, ["en", "vi", "fr", "none"])


@query("""SELECT c AS "column", f AS format, CASE WHEN f IS NULL THEN 0 ELSE n END AS matches, n AS total
   FROM (VALUES ('dmy', '%d/%m/%Y'), ('mdy', '%m-%d-%y'), ('ymd', '%Y.%m.%d'), ('word', NULL)) v(c, f), (SELECT count(*) AS n FROM orders)""")
def d3_detect_by_delimiter(spark, sf):
    t = table(spark, sf, "orders").select(*[F.date_format("o_orderdate", f).alias(c) for c, f in (("dmy", "d/M/yyyy"), ("mdy", "MM-dd-yy"), ("ymd", "yyyy.MM.dd"))], F.lit("x").alias("word"))
    return d.detect_by_delimiter(t, ["dmy", "mdy", "ymd", "word"])


@query("SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS stamp FROM orders")
def d6_ambiguous_dates(spark, sf):
    """Month-first dates, also of days up to 12."""
    t = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("stamp"))
    return d.to_timestamp_smart(t, "stamp")


@query("""SELECT event_id, date_trunc('second', ts) AS s, date_trunc('millisecond', ts) AS ms, ts AS us, CAST(date_trunc('day', ts) AS TIMESTAMP) AS serial FROM events""")
def d6_epoch_and_serial_numbers(spark, sf):
    ts = F.col("ts").cast("timestamp")
    t = table(spark, sf, "events").select("event_id", F.unix_seconds(ts).alias("s"), F.unix_millis(ts).alias("ms"), F.unix_micros(ts).alias("us"),
                                          F.datediff(ts, F.lit("1899-12-30").cast("date")).alias("serial"))
    for c in ("s", "ms", "us", "serial"):
        t = d.to_timestamp_smart(t, c)
    return t


@query("""SELECT 'iso' AS "column", 1.0::DOUBLE AS share, true AS is_datetime UNION ALL SELECT 'partial', round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END),4), avg(CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END) >= 0.85 FROM orders
   UNION ALL SELECT 'o_orderdate', 1.0, true""")
def d7_datetime_share(spark, sf):
    o = table(spark, sf, "orders")
    t = o.select("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("partial"))
    return round_doubles(d.datetime_share(t, ["iso", "partial", "o_orderdate"]))


@query("""SELECT o_orderkey, CAST(year(t) AS INTEGER) AS t_year, CAST(month(t) AS INTEGER) AS t_month, CAST(day(t) AS INTEGER) AS t_day, CAST(isodow(t)-1 AS INTEGER) AS t_dayofweek, CAST(quarter(t) AS INTEGER) AS t_quarter,
   CAST(week(t) AS INTEGER) AS t_weekofyear, CAST(dayofyear(t) AS INTEGER) AS t_dayofyear, CAST(isodow(t)>=6 AS INTEGER) AS t_is_weekend, CAST(day(t)=day(last_day(t)) AS INTEGER) AS t_is_month_end,
   CAST(day(t)<=7 AS INTEGER) AS t_is_month_start, CAST(day(t)=day(last_day(t)) AND month(t) IN (3,6,9,12) AS INTEGER) AS t_is_quarter_end FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)""")
def d8_calendar_features(spark, sf):
    return d.calendar_features(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("t")), "t").drop("t")


@query("""SELECT event_id, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(minute(ts) AS INTEGER) AS ts_minute, CAST(hour(ts) BETWEEN 8 AND 17 AS INTEGER) AS ts_business_hour,
   CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS ts_time_of_day FROM events""")
def d9_time_features(spark, sf):
    return d.time_features(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@query("""WITH h AS (SELECT DISTINCT CAST(ts AS DATE) d FROM events WHERE event_type = 'purchase' AND value > 150)
   SELECT event_id, CAST(CAST(ts AS DATE) IN (SELECT d FROM h) AS INTEGER) AS ts_is_holiday, CAST(CAST(ts AS DATE)+1 IN (SELECT d FROM h) AS INTEGER) AS ts_is_before_holiday, CAST(CAST(ts AS DATE)-1 IN (SELECT d FROM h) AS INTEGER) AS ts_is_after_holiday FROM events""")
def d10_holiday_flags(spark, sf):
    e = table(spark, sf, "events")
    days = e.filter("event_type = 'purchase' AND value > 150").select(F.to_date("ts").alias("day")).distinct()
    return d.holiday_flags(e.select("event_id", "ts"), "ts", days).drop("ts")


TURN = {"month": "month(ts)/12", "dow": "(isodow(ts)-1)/7", "dom": "day(ts)/day(last_day(ts))", "doy": "dayofyear(ts)/365", "hour": "hour(ts)/24"}


@query("SELECT event_id, " + ", ".join(f"round({f}(2*pi()*{e}),4)+0.0 AS ts_{k}_{f}" for k, e in TURN.items() for f in ("sin", "cos")) + " FROM events")
def d11_cyclical_features(spark, sf):
    return round_doubles(d.cyclical_features(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts"))


@query("SELECT event_id, value, " + ", ".join(f"lag(value,{k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag_{k}" for k in (1, 7, 30)) + " FROM events")
def d12_lag_features(spark, sf):
    t = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return d.lag_features(t, ["value"], ["ts", "event_id"], ["user_id"]).select("event_id", "value", "value_lag_1", "value_lag_7", "value_lag_30")


@query(f"""SELECT 'o_orderdate' AS "column", part, value, n, s.* FROM ({PARTS('o_orderdate', 'orders')}), (SELECT CAST(min(o_orderdate) AS TIMESTAMP) AS min_ts, CAST(max(o_orderdate) AS TIMESTAMP) AS max_ts, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS range_days FROM orders) s""")
def d13_date_distribution(spark, sf):
    return d.date_distribution(table(spark, sf, "orders"), "o_orderdate")


@query(f"""SELECT 'o_orderdate' AS "column", min(g) AS gap_min, max(g) AS gap_max, round(avg(g),4) AS gap_mean, median(g) AS gap_median, round(stddev_pop(g),4) AS gap_std, round(stddev_pop(g)/avg(g),4) AS cv,
   round(greatest(0, least(1, 1-least(1, stddev_pop(g)/avg(g)/3))),4) AS regularity FROM {gap_sql('o_orderdate', 'orders')}""")
def d14_gap_stats(spark, sf):
    return round_doubles(d.gap_stats(table(spark, sf, "orders"), "o_orderdate"))


LADDER = """CASE WHEN s <= 1 THEN 'secondly' WHEN s <= 60 THEN 'minutely' WHEN s <= 3600 THEN 'hourly' WHEN s/3600 BETWEEN 3.5 AND 4.5 THEN '4-hourly' WHEN s/3600 BETWEEN 5.5 AND 6.5 THEN '6-hourly'
  WHEN s/3600 BETWEEN 11.5 AND 12.5 THEN '12-hourly' WHEN s <= 86400 THEN 'hourly' WHEN s/86400 <= 1.5 THEN 'daily' WHEN s/86400 BETWEEN 6.5 AND 7.5 THEN 'weekly' WHEN s/86400 <= 7.5 THEN concat(CAST(round(s/86400) AS INT),'-daily')
  WHEN s/86400 BETWEEN 13 AND 16 THEN 'bi-weekly' WHEN s/86400 BETWEEN 29 AND 31 THEN 'monthly' WHEN s/86400 <= 31 THEN concat(CAST(round(s/86400) AS INT),'-daily') WHEN s/86400/30.44 <= 1.5 THEN 'monthly'
  WHEN s/86400/30.44 <= 3.5 THEN concat(CAST(round(s/86400/30.44) AS INT),'-monthly') WHEN s/86400/30.44 BETWEEN 5.5 AND 6.5 THEN 'semi-annually' WHEN s/86400/30.44 <= 12 THEN concat(CAST(round(s/86400/30.44) AS INT),'-monthly')
  WHEN s/86400/30.44 BETWEEN 11.5 AND 12.5 THEN 'yearly' WHEN s/86400/365.25 > 1 THEN concat(CAST(round(s/86400/365.25) AS INT),'-yearly') ELSE concat(CAST(round(s/86400/30.44) AS INT),'-monthly') END"""


@query(f"SELECT user_id, round(s,4) AS median_gap, {LADDER} AS frequency FROM (SELECT user_id, median(g) s FROM (SELECT user_id, (epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts))/1e6 g FROM events) GROUP BY 1) WHERE s IS NOT NULL")
def d15_frequency_name(spark, sf):
    from ..operators.ordered import gaps
    from ..operators.quantiles import median_table
    m = median_table(gaps(table(spark, sf, "events"), "ts", ["user_id"]), ["gap_seconds"], ["user_id"])
    return round_doubles(m.select("user_id", F.col("median").alias("median_gap"), d.frequency_name(F.col("median")).alias("frequency")))


def season(part, expr, cut, peaks):
    return f"""SELECT '{part}' AS part, round(stddev_samp(n)/avg(n),4) AS variation, stddev_samp(n)/avg(n) > {cut} AS has_pattern, array_to_string((SELECT list(v) FROM (SELECT {expr} v FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {peaks})),',') AS peaks
      FROM (SELECT {expr}, count(*) n FROM orders GROUP BY 1) HAVING count(*) > 1"""


def special(part, cond, cut):
    return f"SELECT '{part}', round(avg(CAST({cond} AS INT)),4), avg(CAST({cond} AS INT)) > {cut}, '' FROM orders"


END = "day(o_orderdate) = day(last_day(o_orderdate))"


@query(" UNION ALL ".join([season("day_of_week", "isodow(o_orderdate)-1", 0.5, 2), season("month", "month(o_orderdate)", 0.3, 3), season("quarter", "quarter(o_orderdate)", 0.2, 2),
                           special("month_start", "day(o_orderdate)=1", 0.4), special("month_end", END, 0.4), special("quarter_end", f"({END} AND month(o_orderdate) IN (3,6,9,12))", 0.2)]))
def d16_count_seasonality(spark, sf):
    return round_doubles(d.count_seasonality(table(spark, sf, "orders"), "o_orderdate"))


@query("""SELECT count(h) AS n, round(avg(h),4) AS mean, round(median(h),4) AS median, round(stddev_samp(h),4) AS std, stddev_samp(h) < abs(avg(h))*0.2 AND abs(avg(h)-median(h)) < abs(avg(h))*0.1 AS consistent
   FROM (SELECT date_diff('second', o_orderdate, l_shipdate)/3600 AS h FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""")
def d17_date_difference(spark, sf):
    t = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return round_doubles(d.date_difference(t, "o_orderdate", "l_shipdate"))


GANTT = "(SELECT user_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)"


@query(f"""SELECT user_id, a, b, event_type, coalesce(event_type,'Default') AS "group", round((epoch_us(b)-epoch_us(a))/3.6e9,4) AS duration_hours, make_timestamp(lo - pad) AS range_start, make_timestamp(hi + pad) AS range_end
   FROM {GANTT}, (SELECT epoch_us(min(a)) lo, epoch_us(max(b)) hi, CAST(floor((epoch_us(max(b))-epoch_us(min(a)))*0.05) AS BIGINT) pad FROM {GANTT})""")
def d18_durations(spark, sf):
    e = table(spark, sf, "events").withColumn("event_type", F.when(F.col("user_id") % 7 == 0, None).otherwise(F.col("event_type")))
    t = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return round_doubles(d.durations(t, "a", "b", "event_type"))
