"""Feed, retention, windows and streams over the event log."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from matchlake.operators import evaluate, feed
from matchlake.plans.common import query, table
from matchlake.streaming import feed as stream


@query("recent_distinct", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def recent_distinct(spark, sf_dir):
    return feed.recent_distinct(table(spark, sf_dir, "events"), "user_id", 12)


@query("retention_prune", "SELECT event_id, user_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_prune(spark, sf_dir):
    return feed.retained(table(spark, sf_dir, "events"), days=7).select("event_id", "user_id", "ts")


USERS = "u AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)"


@query("feed_enriched", f"WITH {USERS} SELECT user_id, last, c_name FROM u JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'MACHINERY' ORDER BY last DESC, user_id LIMIT 12")
def feed_enriched(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"), "c_name")
    return feed.feed(table(spark, sf_dir, "events"), known, "user_id", 12)


@query("feed_over_fetched", f"WITH {USERS}, t AS (SELECT * FROM u ORDER BY last DESC, user_id LIMIT 24) SELECT user_id, last, c_name FROM t JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'MACHINERY' ORDER BY last DESC, user_id LIMIT 12")
def feed_over_fetched(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"), "c_name")
    return feed.feed(table(spark, sf_dir, "events"), known, "user_id", 12, over_fetch=2)


def events_stream(spark, sf_dir):
    """The events file as a stream: its folder, filtered to its name."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def checkpoint(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("stream_recent", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1")
def stream_recent(spark, sf_dir):
    rows = stream.recent(events_stream(spark, sf_dir), "user_id")
    return stream.drain(rows, f"recent_{uuid.uuid4().hex}", checkpoint(spark)).select("user_id", F.col("last").cast("timestamp_ntz").alias("last"))


@query("stream_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    rows = stream.windowed(events_stream(spark, sf_dir), "1 day", late="40 days")
    return stream.drain(rows, f"windows_{uuid.uuid4().hex}", checkpoint(spark)).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "events")


@query("event_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "events", "total")


@query(
    "event_sessions",
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS events FROM b GROUP BY user_id, s""",
)
def event_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feed.sessions(rows, "user_id", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("latency_percentiles", "SELECT event_type, count(*) AS samples, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return evaluate.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("mode_summary_pivot", "SELECT c_mktsegment, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + " FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def mode_summary_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return evaluate.status_pivot(rows, "c_mktsegment", "o_orderstatus", ["F", "O", "P"])


@query(
    "longest_runs",
    """WITH a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
b AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, value > 10 ORDER BY event_id) AS i FROM a) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM b WHERE value > 10 GROUP BY user_id, i""",
)
def longest_runs(spark, sf_dir):
    return evaluate.runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") > 10)


@query(
    "moving_average",
    "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM events",
)
def moving_average(spark, sf_dir):
    from pyspark.sql import Window as W

    by = W.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.avg("value").over(by.rowsBetween(-2, 2)), 4).alias("smooth"), F.round(F.sum("value").over(by.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"))
