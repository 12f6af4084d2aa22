"""Batch forms of the streaming queries, with SQL; the streams themselves are held against them in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.plans._register import Register
from trackloom.sources.rides import table
from trackloom.streaming import live

R = Register()
QUERIES, SQL, query = R.queries, R.sql, R.query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("q_sampled_windows", """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS worst FROM events GROUP BY 1""")
def sampled_windows(spark, sf_dir):
    s = live.sampled(events(spark, sf_dir), "ts", "1 hour")
    return s.select(F.unix_micros("start").alias("start_us"), "n", F.round("mean", 6).alias("mean"), "worst")


@query("q_session_windows", """WITH a AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours', true) THEN 1 ELSE 0 END AS n FROM events),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM b GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    s = live.passes(events(spark, sf_dir), "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
