"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame
from ..streaming import streams
from . import fixtures as fx
from .fixtures import r6


def _stream(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of files."""
    schema = fx.table(spark, sf_dir, name).schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet{_below(spark, sf_dir, name)}")
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def _below(spark, sf_dir, name):
    # a stream reads folders: a single file is found by a pattern that only it meets
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return "" if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory() else "*"


def _events(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_projection(spark, sf_dir):
    """Every vector, as it comes, onto the frame of those before 2000."""
    at = frame.frame_at(fx.entity(spark, sf_dir), 2000, width=fx.WIDTH)
    s = _stream(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 1.1).alias("v"))
    out = streams.run_available(streams.project(s, at).select("vec_id", "assigned_community", "distance", "in_basin"), "projection")
    return out.select("vec_id", "assigned_community", r6("distance").alias("distance"), "in_basin")


def stream_window_rate(spark, sf_dir):
    s = streams.windowed_rate(_stream(spark, sf_dir, "events"), "ts", F.col("event_type") == "error", "6 hours", late="10 days")
    out = streams.run_available(s, "rate", "complete")
    return out.select(F.unix_seconds("start").alias("start"), "n", "k", r6("rate").alias("rate"))


def stream_sliding_rate(spark, sf_dir):
    s = streams.windowed_rate(_stream(spark, sf_dir, "events"), "ts", F.col("value") > 50, "1 day", "12 hours", late="10 days", by=["event_type"])
    out = streams.run_available(s, "sliding", "complete")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", "k", r6("rate").alias("rate"))


def stream_births(spark, sf_dir):
    s = streams.births(_stream(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    out = streams.run_available(s, "births", "update")
    last = out.groupBy("key").agg(F.min(F.struct("ts", "id")).alias("s"))
    return last.select(F.col("key").alias("user_id"), F.unix_micros("s.ts").alias("ts"), F.col("s.id").alias("event_id"))


def batch_births(spark, sf_dir):
    out = streams.births(_events(spark, sf_dir), "user_id", "ts", "event_id")
    return out.select(F.col("key").alias("user_id"), F.unix_micros("ts").alias("ts"), F.col("id").alias("event_id"))


def stream_bursts(spark, sf_dir):
    s = streams.bursts(_stream(spark, sf_dir, "events"), "user_id", "ts", "30 minutes", late="10 days")
    out = streams.run_available(s, "bursts", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


_E = fx.ENTITY
_BIRTH = "SELECT user_id, epoch_us(first(ts ORDER BY ts, event_id)) AS ts, first(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY user_id"
SQL = {
    "stream_projection": fx.sql(_E, "train AS (SELECT * FROM fx_entity WHERE year <= 2000 AND community >= 0)", fx.centres("train"), fx.members("train"), "lim AS (SELECT community, quantile_cont(d, 0.95) AS t FROM members GROUP BY community)", "pb AS (SELECT vec_id, list_transform(v, lambda x: x * 1.1::DOUBLE) AS u FROM fx_entity)", fx.nearest("pb", "centres", "u"), select="SELECT vec_id, assigned_community, round(distance, 6) AS distance, distance <= t AS in_basin FROM projected p JOIN lim l ON p.assigned_community = l.community"),
    "stream_window_rate": "SELECT epoch(w)::BIGINT AS start, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS k, round(avg((event_type = 'error')::INT::DOUBLE), 6) AS rate FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS w FROM events) GROUP BY w",
    "stream_sliding_rate": "SELECT epoch(w)::BIGINT AS start, event_type, count(*) AS n, sum((value > 50)::INT)::BIGINT AS k, round(avg((value > 50)::INT::DOUBLE), 6) AS rate FROM (SELECT *, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 12 HOURS AS w FROM events, (SELECT unnest([0, 1]) AS o)) GROUP BY ALL",
    "stream_births": _BIRTH,
    "batch_births": _BIRTH,
    "stream_bursts": "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, b",
}

QUERIES = {f.__name__: f for f in (stream_projection, stream_window_rate, stream_sliding_rate, stream_births, batch_births, stream_bursts)}
