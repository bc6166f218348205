"""Queries for live metrics. The streams read the supplied events as files and run until they are used up."""
from pyspark.sql import functions as F

from . import query, table
from ..operators.common import round_doubles
from ..sources.io import scratch_folder
from ..streaming import metrics as m


def event_stream(spark, sf):
    """The events table as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


W1 = """SELECT date_trunc('hour', ts) AS window_start, event_type AS key, count(*) AS requests, round(100.0*count(*) FILTER (WHERE value < 50)/count(*),4) AS success_rate, round(avg(value),4) AS mean_latency,
   quantile_disc(value, .5) AS p50, quantile_disc(value, .95) AS p95 FROM events GROUP BY 1, 2"""


@query(W1)
def w1_window_metrics(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return round_doubles(m.stream_metrics(e, "ts", "event_type", F.col("value") < 50, "value"))


# The stream closes a window once the watermark (2 hours behind the last event) has passed its end.
@query(f"SELECT * FROM ({W1}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def w1_window_metrics_streamed(spark, sf):
    out = m.stream_metrics(event_stream(spark, sf), "ts", "event_type", F.col("value") < 50, "value")
    path = scratch_folder(spark)
    return round_doubles(m.run_to_table(out, f"{path}/out", f"{path}/state"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch_us(ts)/1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT user_id, event_id, i, s AS start, 1 AS used FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.s >= r.start + 86400 THEN e.s ELSE r.start END, CASE WHEN e.s >= r.start + 86400 THEN 1 ELSE r.used + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
  SELECT user_id AS user, event_id AS request, used <= 3 AS allowed, CAST(greatest(0, 3 - used) AS BIGINT) AS remaining FROM r""")
def w2_rate_limit_streamed(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", m.ROCKSDB)
    out = m.stream_rate_limit(event_stream(spark, sf), "user_id", "ts", "event_id", limit=3, window=86_400, watermark="1 day")
    path = scratch_folder(spark)
    return m.run_to_table(out, f"{path}/out", f"{path}/state").drop("at")


MEAN = "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),4) AS value_mean FROM events"


@query(MEAN)
def w3_moving_mean(spark, sf):
    return round_doubles(m.moving_mean(table(spark, sf, "events"), "value", ["ts", "event_id"], ["event_type"]).select("event_id", "value_mean"))


@query(MEAN.replace("event_id, round", "event_id AS request, round").replace("AS value_mean", "AS mean"))
def w3_moving_mean_streamed(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", m.ROCKSDB)
    path = scratch_folder(spark)
    out = m.stream_moving_mean(event_stream(spark, sf), "event_type", "value", "ts", "event_id")
    return round_doubles(m.run_to_table(out, f"{path}/out", f"{path}/state").select("request", "mean"))


@query("SELECT request, mean FROM (" + MEAN.replace("event_id, round", "event_id AS request, ts, round").replace("AS value_mean", "AS mean") + ") WHERE epoch_us(ts)/1e6 < floor((SELECT max(epoch_us(ts)) FROM events)/1000)/1000 - 86400")
def w3_ordered_mean_streamed(spark, sf):
    """Means in the order of event time; rows of the last day still wait for the watermark when the stream ends."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", m.ROCKSDB)
    path = scratch_folder(spark)
    out = m.stream_ordered_mean(event_stream(spark, sf), "event_type", "value", "ts", "event_id", watermark="1 day")
    return round_doubles(m.run_to_table(out, f"{path}/out", f"{path}/state").select("request", "mean"))


def streamed_profile(spark, sf):
    path = scratch_folder(spark)
    m.stream_profile(event_stream(spark, sf), f"{path}/out", ["value"], ["event_type"], f"{path}/state").awaitTermination()
    return m.read_profile(spark, f"{path}/out")


@query("""SELECT 'value' AS "column", count(*) AS n, round(avg(value),4) AS mean, round(stddev_pop(value),4) AS std, min(value) AS min, max(value) AS max FROM events""")
def w4_profile_streamed(spark, sf):
    return round_doubles(streamed_profile(spark, sf)[0])


@query("""SELECT 'event_type' AS "column", event_type AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank, first_value(event_type) OVER (ORDER BY count(*) DESC, event_type) AS mode FROM events GROUP BY 2""")
def w4_profile_counts_streamed(spark, sf):
    return streamed_profile(spark, sf)[1]


@query("""SELECT 'event_type' AS "column", event_type AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank, (SELECT count(DISTINCT event_type) FROM events) AS distinct_values, (SELECT count(value) FROM events) AS numbers FROM events GROUP BY 2""")
def w4_sketches_streamed(spark, sf):
    """Frequent values and distinct counts merged from the sketches of a stream's micro-batches."""
    path = scratch_folder(spark)
    m.stream_sketches(event_stream(spark, sf), f"{path}/out", ["value"], ["event_type"], f"{path}/state").awaitTermination()
    facts, top = m.read_sketches(spark, f"{path}/out")
    sizes = facts.groupBy().agg(F.max(F.when(F.col("column") == "event_type", F.col("distinct_values"))).alias("distinct_values"), F.max(F.when(F.col("column") == "value", F.col("n"))).alias("numbers"))
    return top.crossJoin(F.broadcast(sizes))
