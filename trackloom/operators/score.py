"""Scores of predictions: drift over the distance travelled without satellites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import CIRCLE_90

LIMIT_PCT = 10.0


def score(predicted: DataFrame, distances: DataFrame, keys: list[str]) -> DataFrame:
    """predicted (predict.*) and distances(ride_id, target, i0, i1, d0, d1) -> a row per outage and predictor.

    distance_m, duration_s, mean_kmph, final_drift_m, drift_pct, ate_m, max_err_m, cep50_m, cep95_m, passes,
    gate_50m, gate_1km (null outside their ranges), coverage_90.
    """
    p = predicted.withColumn("e2", F.pow(F.col("x") - F.col("x_mm"), 2) + F.pow(F.col("y") - F.col("y_mm"), 2))
    p = p.withColumn("e", F.sqrt("e2") / 1000.0)
    g = p.groupBy(*keys, "predictor").agg(
        F.max_by("e", "seq").alias("final_drift_m"),
        (F.sqrt(F.avg("e2")) / 1000.0).alias("ate_m"),
        F.max("e").alias("max_err_m"),
        F.percentile("e", 0.5).alias("cep50_m"),
        F.percentile("e", 0.95).alias("cep95_m"),
        F.avg((F.col("e") <= CIRCLE_90 * F.col("sigma") / 1000.0).cast("double")).alias("coverage_90"),
    )
    s = g.join(distances.select(*keys, "d0", "d1"), keys)
    distance, duration, drift = (F.col("d1") - F.col("d0")) / 1000.0, (F.col("i1") - F.col("i0")).cast("double"), F.col("final_drift_m")
    s = s.withColumn("distance_m", distance).withColumn("duration_s", duration)
    s = s.withColumn("mean_kmph", F.when(duration > 0, distance / duration * 3.6).otherwise(0.0))
    s = s.withColumn("drift_pct", F.when(distance > 1e-6, drift / distance * 100.0).otherwise(float("inf")))
    s = s.withColumn("passes", F.col("drift_pct") < LIMIT_PCT)
    s = s.withColumn("gate_50m", F.when(F.col("distance_m").between(40, 60) & (F.col("duration_s") < 60), drift < 5.0))
    return s.withColumn("gate_1km", F.when(F.col("distance_m").between(900, 1100), drift < 100.0)).drop("d0", "d1")


def summarise(scores: DataFrame, *by: str) -> DataFrame:
    """n, mean, median, p90 and worst drift_pct, mean ate_m, pass rate and gate rates over the outages that have them."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("drift_pct").alias("mean_pct"),
        F.percentile("drift_pct", 0.5).alias("median_pct"),
        F.percentile("drift_pct", 0.9).alias("p90_pct"),
        F.max("drift_pct").alias("worst_pct"),
        F.avg("ate_m").alias("ate_mean_m"),
        rate("passes").alias("pass_rate"),
        rate("gate_50m").alias("gate_50m_rate"),
        rate("gate_1km").alias("gate_1km_rate"),
    )


def verdict(denied_m: Column, drift_pct: Column) -> Column:
    """What the phone shows: nothing can be said below 20 m."""
    return F.when(denied_m < 20, "NOT SCORABLE").when(drift_pct < LIMIT_PCT, "PASS").otherwise("FAIL")


def outcome(deviated_at: Column, alarm_at: Column, early: float = 0.0) -> Column:
    """Wrong-turn alarms against the truth, from two places that may be null."""
    return (
        F.when(deviated_at.isNull() & alarm_at.isNull(), "quiet")
        .when(deviated_at.isNull(), "false alarm")
        .when(alarm_at.isNull(), "missed")
        .when(alarm_at < deviated_at - early, "early")
        .otherwise("caught")
    )


def fit_spread(e: Column, d: Column, least_distance: float = 20.0, least_pairs: int = 10, default: float = 0.19) -> Column:
    """Aggregate: k with sigma = k * distance, from errors e at distances d."""
    far = d > least_distance
    return F.when(F.count_if(far) >= least_pairs, F.sqrt(F.avg(F.when(far, F.pow(e / d, 2))) / 2.0)).otherwise(F.lit(default))


def run_summary(track: DataFrame, ends: DataFrame, key: str = "ride_id", seq: str = "seq") -> DataFrame:
    """key, fixes, distance_m, final_error_m, drift_pct, mean_speed, radius_m, verdict: what a phone says of a ride without a laptop.

    track(key, seq, x, y, cut): fixes in metres and where the denied stretch begins; ends(key, px, py, seconds, denied_s): the last dead-reckoned place, how
    long the ride and the stretch lasted. Steps of 15 m/s or more, by the ride's mean interval, are no movement.
    """
    w = Window.partitionBy(key).orderBy(seq)
    t = track.withColumn("__step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).withColumn("__n", F.row_number().over(w) - 1).join(ends, key)
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    t = t.withColumn("__ok", (F.col("__n") >= F.greatest("cut", F.lit(1))) & (F.col("__step") < 15.0 * F.greatest(F.col("seconds") / size, F.lit(0.2))))
    g = t.groupBy(key).agg(F.count(F.lit(1)).alias("fixes"), F.coalesce(F.sum(F.when(F.col("__ok"), F.col("__step"))), F.lit(0.0)).alias("distance_m"), F.hypot(F.max_by("x", seq) - F.max("px"), F.max_by("y", seq) - F.max("py")).alias("final_error_m"), F.max("denied_s").alias("denied_s"))
    d, e = F.col("distance_m"), F.col("final_error_m")
    drift = F.when(d > 1, e / d * 100).otherwise(0.0)
    said = F.when(d < 20, "NOT SCORABLE").when((d > 1) & (drift < 10), "PASS").otherwise("FAIL")
    return g.select(key, "fixes", "distance_m", "final_error_m", drift.alias("drift_pct"), F.when(F.col("denied_s") > 0, d / F.col("denied_s")).otherwise(0.0).alias("mean_speed"), (2.146 * F.greatest(0.19 * d, F.lit(2.0))).alias("radius_m"), said.alias("verdict"))


def drift_series(errors: DataFrame, warm_up: float = 200.0) -> DataFrame:
    """errors(..., gone, err in metres) from warm_up on, with drift_pct: before that, a share of the distance says nothing."""
    return errors.where(F.col("gone") >= warm_up).withColumn("drift_pct", F.col("err") / F.col("gone") * 100)
