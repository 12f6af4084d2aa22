"""The driver's events as vehicle rides, in whole millimetres so that every engine agrees to the last digit.

A user is a ride, an event a step: value / 10 is its length in metres, k - 50 the turn in degrees, and the place in
the ride a one-second clock. Rides begin 60 m apart on a grid 64 wide, so that more rides cover more ground. Errors are steps without satellite fixes, purchases are landmark hits. The rides are a
stand-in for recorded ones: they exercise the operators, and drift figures from them say nothing about navigation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_ride(*order: str) -> Window:
    return Window.partitionBy("ride_id").orderBy(*(order or ("seq",)))


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ride_id, seq, event_id, ts, kind, value, k, head_deg, dx_mm, dy_mm, step_mm, x_mm, y_mm, d_mm, gnss_ok, hit."""
    w = by_ride("ts", "event_id")
    run = by_ride().rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ride_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    a = e.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
    b = a.withColumn("head_deg", F.sum(F.col("k") - 50).over(run))
    c = b.withColumn("dx_mm", F.round(F.col("value") * 100 * F.cos(F.radians("head_deg"))).cast("long"))
    c = c.withColumn("dy_mm", F.round(F.col("value") * 100 * F.sin(F.radians("head_deg"))).cast("long")).withColumn("step_mm", F.round(F.col("value") * 100).cast("long"))
    return c.select(
        "*",
        (F.sum("dx_mm").over(run) + F.pmod("ride_id", F.lit(64)) * 60000).alias("x_mm"),
        (F.sum("dy_mm").over(run) + F.floor(F.col("ride_id") / 64) * 60000).alias("y_mm"),
        F.sum("step_mm").over(run).alias("d_mm"),
        (F.col("kind") != "error").alias("gnss_ok"),
        (F.col("kind") == "purchase").alias("hit"),
    )


#: The same rides in SQL: WITH clauses that end in `r`.
RIDES_SQL = """
ra AS (SELECT user_id AS ride_id, event_id, ts, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
rb AS (SELECT *, CAST(sum(k - 50) OVER (PARTITION BY ride_id ORDER BY seq) AS BIGINT) AS head_deg FROM ra),
rc AS (SELECT *, CAST(round(value * 100 * cos(radians(head_deg))) AS BIGINT) AS dx_mm, CAST(round(value * 100 * sin(radians(head_deg))) AS BIGINT) AS dy_mm,
              CAST(round(value * 100) AS BIGINT) AS step_mm FROM rb),
r AS (SELECT *, CAST(sum(dx_mm) OVER w + (ride_id % 64) * 60000 AS BIGINT) AS x_mm, CAST(sum(dy_mm) OVER w + (ride_id // 64) * 60000 AS BIGINT) AS y_mm, CAST(sum(step_mm) OVER w AS BIGINT) AS d_mm,
             kind <> 'error' AS gnss_ok, kind = 'purchase' AS hit FROM rc WINDOW w AS (PARTITION BY ride_id ORDER BY seq))
"""
