"""Queries of outages, predictors and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import outage as O
from trackloom.operators import predict as P
from trackloom.operators import score as C
from trackloom.plans._register import Register
from trackloom.sources.rides import RIDES_SQL, by_ride, rides
from trackloom.sources.shared import materialize

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query

TARGETS, STRIDE = [50000, 100000, 200000], 25000

OUTAGES_SQL = """, tot AS (SELECT ride_id, max(d_mm) AS total FROM r GROUP BY ride_id),
st AS (SELECT ride_id, target, unnest(generate_series(0, total - target, 25000)) AS start FROM tot, (SELECT unnest([50000, 100000, 200000])::BIGINT AS target) WHERE total * 10 >= target * 11),
o0 AS (SELECT st.*, r.seq AS i0 FROM st ASOF JOIN r ON st.ride_id = r.ride_id AND st.start <= r.d_mm),
o1 AS (SELECT o0.ride_id, o0.target, o0.start, o0.i0, r.seq AS i1 FROM o0 ASOF JOIN r ON o0.ride_id = r.ride_id AND o0.start + o0.target <= r.d_mm),
o AS (SELECT * FROM o1 WHERE i1 - i0 >= 5)
"""


def outages(spark, sf_dir):
    """The rides, written once for all their uses, and their outages."""
    r = materialize(rides(spark, sf_dir), "rides")
    return r, materialize(O.by_distance(r, TARGETS, STRIDE), "outages")


@query("q_outages_by_distance", OUTAGES_SQL + "SELECT ride_id, target, CAST(start AS BIGINT) AS start, i0, i1 FROM o")
def outages_by_distance(spark, sf_dir):
    return outages(spark, sf_dir)[1]


@query("q_outages_spread", """, tot AS (SELECT ride_id, max(d_mm) AS total FROM r GROUP BY ride_id),
st AS (SELECT ride_id, target, generate_series(0, total - target, 2000) AS s FROM tot, (SELECT 50000::BIGINT AS target) WHERE total * 10 >= target * 11),
pk AS (SELECT ride_id, target, CASE WHEN len(s) > 40 THEN list_transform(generate_series(0, 39), lambda i: s[CAST(floor(i * (len(s) - 1) / 39.0::DOUBLE) AS BIGINT) + 1]) ELSE s END AS s FROM st),
sx AS (SELECT ride_id, target, unnest(s) AS start FROM pk),
o0 AS (SELECT sx.*, r.seq AS i0 FROM sx ASOF JOIN r ON sx.ride_id = r.ride_id AND sx.start <= r.d_mm),
o1 AS (SELECT o0.ride_id, o0.target, o0.start, o0.i0, r.seq AS i1 FROM o0 ASOF JOIN r ON o0.ride_id = r.ride_id AND o0.start + o0.target <= r.d_mm)
SELECT ride_id, target, CAST(start AS BIGINT) AS start, i0, i1 FROM o1 WHERE i1 - i0 >= 5""")
def outages_spread(spark, sf_dir):
    """At most 40 evenly spaced starts."""
    return O.by_distance(rides(spark, sf_dir), [50000], 2000, most=40)


@query("q_outages_by_duration", """, tot AS (SELECT ride_id, max(seq) AS total FROM r GROUP BY ride_id)
SELECT ride_id, target, i0, i0 + target AS i1 FROM (SELECT ride_id, target, CAST(unnest(generate_series(0, total - target, 20)) AS BIGINT) AS i0 FROM tot, (SELECT unnest([30, 60])::BIGINT AS target) WHERE total * 10 >= target * 11) WHERE target >= 5""")
def outages_by_duration(spark, sf_dir):
    return O.by_duration(rides(spark, sf_dir), [30, 60], 20)


@query("q_snap_to_fixes", OUTAGES_SQL + """, f AS (SELECT ride_id, seq AS fix FROM r WHERE hit),
a AS (SELECT o.ride_id, o.target, o.i1, f.fix AS j0 FROM o ASOF JOIN f ON o.ride_id = f.ride_id AND o.i0 <= f.fix),
b AS (SELECT a.ride_id, a.target, a.j0, f.fix AS j1 FROM a ASOF JOIN f ON a.ride_id = f.ride_id AND a.i1 + 1 <= f.fix)
SELECT ride_id, min(target) AS target, j0 AS i0, j1 AS i1 FROM b WHERE j1 > j0 GROUP BY ride_id, j0, j1""")
def snap_to_fixes(spark, sf_dir):
    r, o = outages(spark, sf_dir)
    return O.snap_to_fixes(o, r.where("hit"))


@query("q_moving_only", OUTAGES_SQL + "SELECT o.ride_id, o.target, CAST(o.start AS BIGINT) AS start, o.i0, o.i1 FROM o JOIN r a ON a.ride_id = o.ride_id AND a.seq = o.i0 JOIN r b ON b.ride_id = o.ride_id AND b.seq = o.i1 WHERE b.d_mm - a.d_mm >= 5000 * (o.i1 - o.i0)")
def moving_only(spark, sf_dir):
    r, o = outages(spark, sf_dir)
    return O.moving_only(o, r, 5000)


@query("q_initial_state", """SELECT ride_id, seq, x_mm AS x0, y_mm AS y0,
 CASE WHEN seq > 5 THEN (x_mm - lag(x_mm, 5) OVER w) / 5.0::DOUBLE ELSE coalesce((x_mm - lag(x_mm) OVER w)::DOUBLE, 0) END AS vx,
 CASE WHEN seq > 5 THEN (y_mm - lag(y_mm, 5) OVER w) / 5.0::DOUBLE ELSE coalesce((y_mm - lag(y_mm) OVER w)::DOUBLE, 0) END AS vy
FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq)""")
def initial_state(spark, sf_dir):
    return O.initial_state(rides(spark, sf_dir))


SCORES_SQL = OUTAGES_SQL + """, od AS (SELECT DISTINCT ride_id, target, i0, i1 FROM o),
ini AS (SELECT ride_id, seq, x_mm AS x0, y_mm AS y0,
 CASE WHEN seq > 5 THEN (x_mm - lag(x_mm, 5) OVER w) / 5.0::DOUBLE ELSE coalesce((x_mm - lag(x_mm) OVER w)::DOUBLE, 0) END AS vx,
 CASE WHEN seq > 5 THEN (y_mm - lag(y_mm, 5) OVER w) / 5.0::DOUBLE ELSE coalesce((y_mm - lag(y_mm) OVER w)::DOUBLE, 0) END AS vy
 FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
pr AS (SELECT od.*, p.predictor, r.seq, r.x_mm, r.y_mm, i.x0 + p.m * i.vx * (r.seq - od.i0) AS x, i.y0 + p.m * i.vy * (r.seq - od.i0) AS y, 1000.0::DOUBLE + p.m * 500.0::DOUBLE * (r.seq - od.i0) AS sigma
 FROM od JOIN ini i ON i.ride_id = od.ride_id AND i.seq = od.i0 JOIN r ON r.ride_id = od.ride_id AND r.seq BETWEEN od.i0 AND od.i1,
 (VALUES ('frozen', 0), ('constant_velocity', 1)) p(predictor, m)),
er AS (SELECT *, pow(x - x_mm, 2) + pow(y - y_mm, 2) AS e2, sqrt(pow(x - x_mm, 2) + pow(y - y_mm, 2)) / 1000.0::DOUBLE AS e FROM pr),
g AS (SELECT ride_id, target, i0, i1, predictor, arg_max(e, seq) AS final_drift_m, sqrt(avg(e2)) / 1000.0::DOUBLE AS ate_m, max(e) AS max_err_m, quantile_cont(e, 0.5) AS cep50_m, quantile_cont(e, 0.95) AS cep95_m,
 avg(CASE WHEN e <= 2.1460::DOUBLE * sigma / 1000.0::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS coverage_90 FROM er GROUP BY ALL),
sc AS (SELECT g.*, (b.d_mm - a.d_mm) / 1000.0::DOUBLE AS distance_m, (g.i1 - g.i0)::DOUBLE AS duration_s, final_drift_m / ((b.d_mm - a.d_mm) / 1000.0::DOUBLE) * 100 AS drift_pct
 FROM g JOIN r a ON a.ride_id = g.ride_id AND a.seq = g.i0 JOIN r b ON b.ride_id = g.ride_id AND b.seq = g.i1),
s AS (SELECT *, distance_m / duration_s * 3.6 AS mean_kmph, drift_pct < 10 AS passes, CASE WHEN distance_m BETWEEN 40 AND 60 AND duration_s < 60 THEN final_drift_m < 5 END AS gate_50m, CASE WHEN distance_m BETWEEN 900 AND 1100 THEN final_drift_m < 100 END AS gate_1km FROM sc)
"""
DOUBLES = ["distance_m", "duration_s", "mean_kmph", "final_drift_m", "drift_pct", "ate_m", "max_err_m", "cep50_m", "cep95_m", "coverage_90"]


def scores(spark, sf_dir):
    r, o = outages(spark, sf_dir)
    o = o.select("ride_id", "target", "i0", "i1").distinct()
    return C.score(P.predict_closed(o, r, O.initial_state(r)), O.with_distance(o, r), ["ride_id", "target", "i0", "i1"])


@query("q_drift_per_outage", SCORES_SQL + "SELECT ride_id, target, i0, i1, predictor, passes, gate_50m, gate_1km, " + ", ".join(f"round({c}, 6) AS {c}" for c in DOUBLES) + " FROM s")
def drift_per_outage(spark, sf_dir):
    return scores(spark, sf_dir).select("ride_id", "target", "i0", "i1", "predictor", "passes", "gate_50m", "gate_1km", *[F.round(c, 6).alias(c) for c in DOUBLES])


@query("q_drift_summary", SCORES_SQL + """SELECT predictor, target, count(*) AS n, round(avg(drift_pct), 6) AS mean_pct, round(quantile_cont(drift_pct, 0.5), 6) AS median_pct, round(quantile_cont(drift_pct, 0.9), 6) AS p90_pct,
round(max(drift_pct), 6) AS worst_pct, round(avg(ate_m), 6) AS ate_mean_m, round(avg(passes::INT), 6) AS pass_rate, round(avg(gate_50m::INT), 6) AS gate_50m_rate, round(avg(gate_1km::INT), 6) AS gate_1km_rate FROM s GROUP BY predictor, target""")
def drift_summary(spark, sf_dir):
    g = C.summarise(scores(spark, sf_dir), "predictor", "target")
    return g.select("predictor", "target", "n", *[F.round(c, 6).alias(c) for c in g.columns if c not in ("predictor", "target", "n")])


@query("q_fit_k", SCORES_SQL + "SELECT predictor, round(CASE WHEN count(*) FILTER (WHERE d > 20) >= 10 THEN sqrt(avg(CASE WHEN d > 20 THEN pow(e / d, 2) END) / 2) ELSE 0.19 END, 6) AS k FROM (SELECT predictor, final_drift_m AS e, distance_m AS d FROM s) GROUP BY predictor")
def fit_k(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("predictor").agg(F.round(C.fit_spread(F.col("final_drift_m"), F.col("distance_m")), 6).alias("k"))


@query("q_calibration_curve", SCORES_SQL + """, lv AS (SELECT unnest([0.5, 0.68, 0.9, 0.95, 0.99])::DOUBLE AS p)
SELECT predictor, p, round(avg(CASE WHEN e <= greatest(0.19::DOUBLE * d, 2) * sqrt(-2 * ln(1 - p)) THEN 1.0::DOUBLE ELSE 0 END), 6) AS covered, round(avg(pow(e / greatest(0.19::DOUBLE * d, 2), 2) / 2), 6) AS anees
FROM (SELECT predictor, final_drift_m AS e, distance_m AS d FROM s), lv GROUP BY predictor, p""")
def calibration_curve(spark, sf_dir):
    levels = F.explode(F.array(*[F.lit(p) for p in (0.5, 0.68, 0.9, 0.95, 0.99)])).alias("p")
    s = scores(spark, sf_dir).select("predictor", F.col("final_drift_m").alias("e"), F.col("distance_m").alias("d"), levels)
    sigma = F.greatest(F.lit(0.19) * F.col("d"), F.lit(2.0))
    within = (F.col("e") <= sigma * F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - F.col("p")))).cast("double")
    return s.groupBy("predictor", "p").agg(F.round(F.avg(within), 6).alias("covered"), F.round(F.avg(F.pow(F.col("e") / sigma, 2) / 2.0), 6).alias("anees"))


@query("q_drift_bins", SCORES_SQL + "SELECT predictor, CAST(round(distance_m / 10) * 10 AS BIGINT) AS bin_m, count(*) AS n, round(quantile_cont(final_drift_m, 0.5), 6) AS median_m FROM s GROUP BY ALL")
def drift_bins(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("bin_m", (F.round(F.col("distance_m") / 10) * 10).cast("long"))
    return s.groupBy("predictor", "bin_m").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("final_drift_m", 0.5), 6).alias("median_m"))


@query("q_model_nearest_median", SCORES_SQL + """, m AS (SELECT target, quantile_cont(drift_pct, 0.5) AS med FROM s GROUP BY target)
SELECT s.target, arg_min(s.ride_id, (round(abs(s.drift_pct - m.med), 6), s.ride_id, s.i0, s.predictor)) AS ride_id FROM s JOIN m USING (target) GROUP BY s.target""")
def model_nearest_median(spark, sf_dir):
    s = scores(spark, sf_dir)
    m = s.groupBy("target").agg(F.percentile("drift_pct", 0.5).alias("med"))
    return s.join(m, "target").groupBy("target").agg(F.min_by("ride_id", F.struct(F.round(F.abs(F.col("drift_pct") - F.col("med")), 6), "ride_id", "i0", "predictor")).alias("ride_id"))


@query("q_run_verdict", SCORES_SQL + "SELECT ride_id, target, i0, i1, predictor, CASE WHEN distance_m < 20 THEN 'NOT SCORABLE' WHEN drift_pct < 10 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN final_drift_m < 25 THEN 'tight' WHEN final_drift_m < 75 THEN 'medium' ELSE 'loose' END AS band FROM s")
def run_verdict(spark, sf_dir):
    from trackloom.functions.text import confidence_band

    return scores(spark, sf_dir).select("ride_id", "target", "i0", "i1", "predictor", C.verdict(F.col("distance_m"), F.col("drift_pct")).alias("verdict"), confidence_band(F.col("final_drift_m")).alias("band"))


@query("q_integrate_predictor", SCORES_SQL + """, ac AS (SELECT ride_id, seq, x_mm, y_mm, k, (step_mm - coalesce(lag(step_mm) OVER (PARTITION BY ride_id ORDER BY seq), step_mm))::DOUBLE AS a FROM r),
iv AS (SELECT od.*, ac.seq, ac.x_mm, ac.y_mm, i.x0, i.y0, greatest(sqrt(pow(i.vx, 2) + pow(i.vy, 2)) + sum(ac.a) OVER w, 0) AS v, CASE WHEN sqrt(pow(i.vx, 2) + pow(i.vy, 2)) > 100 THEN atan2(i.vy, i.vx) ELSE 0 END + radians(sum((ac.k - 50)::DOUBLE) OVER w) AS h
 FROM od JOIN ini i ON i.ride_id = od.ride_id AND i.seq = od.i0 JOIN ac ON ac.ride_id = od.ride_id AND ac.seq BETWEEN od.i0 AND od.i1 WINDOW w AS (PARTITION BY od.ride_id, od.target, od.i0, od.i1 ORDER BY ac.seq)),
ie AS (SELECT *, sqrt(pow(x0 + sum(v * cos(h)) OVER w - x_mm, 2) + pow(y0 + sum(v * sin(h)) OVER w - y_mm, 2)) / 1000.0::DOUBLE AS e FROM iv WINDOW w AS (PARTITION BY ride_id, target, i0, i1 ORDER BY seq)),
ig AS (SELECT ride_id, target, i0, i1, arg_max(e, seq) AS final_drift_m, sqrt(avg(e * e)) AS ate_m, max(e) AS max_err_m FROM ie GROUP BY ALL)
SELECT ig.ride_id, target, i0, i1, round(final_drift_m, 4) AS final_drift_m, round(ate_m, 4) AS ate_m, round(max_err_m, 4) AS max_err_m, round(final_drift_m / ((b.d_mm - a.d_mm) / 1000.0::DOUBLE) * 100, 3) AS drift_pct FROM ig JOIN r a ON a.ride_id = ig.ride_id AND a.seq = i0 JOIN r b ON b.ride_id = ig.ride_id AND b.seq = i1""")
def integrate_predictor(spark, sf_dir):
    """Naive integration of acceleration and turns."""
    r, o = outages(spark, sf_dir)
    r = r.withColumn("accel", (F.col("step_mm") - F.coalesce(F.lag("step_mm").over(by_ride()), F.col("step_mm"))).cast("double")).withColumn("turn", (F.col("k") - 50).cast("double"))
    o = o.select("ride_id", "target", "i0", "i1").distinct()
    p = P.integrate(o, r, O.initial_state(r), "accel", "turn")
    s = C.score(p, O.with_distance(o, r), ["ride_id", "target", "i0", "i1"])
    return s.select("ride_id", "target", "i0", "i1", *[F.round(c, 4).alias(c) for c in ("final_drift_m", "ate_m", "max_err_m")], F.round("drift_pct", 3).alias("drift_pct"))


@query("q_predictor_contract", SCORES_SQL + "SELECT predictor, CASE seq % 5 WHEN 1 THEN 'x' WHEN 2 THEN 'y' WHEN 3 THEN 'sigma' WHEN 4 THEN 'x,sigma' ELSE '' END AS problems, count(*) AS n FROM pr GROUP BY ALL")
def predictor_contract(spark, sf_dir):
    r, o = outages(spark, sf_dir)
    """Predictions of which four of five rows are spoilt: no number, none at all, negative, infinite."""
    p = P.predict_closed(o.select("ride_id", "target", "i0", "i1").distinct(), r, O.initial_state(r))
    fault = F.col("seq") % 5
    p = p.withColumn("x", F.when(fault == 1, float("nan")).when(fault == 4, float("inf")).otherwise(F.col("x"))).withColumn("y", F.when(fault != 2, F.col("y")))
    p = p.withColumn("sigma", F.when(fault == 3, -1.0).when(fault == 4, float("-inf")).otherwise(F.col("sigma")))
    return P.problems(p, all_rows=True).groupBy("predictor", F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@query("q_run_summary", """, c AS (SELECT ride_id, max(seq) AS last, count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS cut FROM r GROUP BY ride_id),
s AS (SELECT r.*, last, cut, n, sqrt(pow(x_mm - lag(x_mm) OVER w, 2) + pow(y_mm - lag(y_mm) OVER w, 2)) / 1000.0::DOUBLE AS step FROM r JOIN c USING (ride_id) WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
g AS (SELECT ride_id, any_value(n) AS fixes, any_value(last - cut) AS denied_s, coalesce(sum(step) FILTER (WHERE seq >= greatest(cut, 1) AND step < 15.0::DOUBLE * greatest(last / n::DOUBLE, 0.2)), 0) AS dist, sqrt(pow(arg_max(x_mm, seq) - arg_max(x_mm, seq) FILTER (WHERE seq <= cut), 2) + pow(arg_max(y_mm, seq) - arg_max(y_mm, seq) FILTER (WHERE seq <= cut), 2)) / 1000.0::DOUBLE AS err FROM s GROUP BY ride_id)
SELECT ride_id, fixes, round(dist, 3) AS distance_m, round(err, 3) AS final_error_m, round(CASE WHEN dist > 1 THEN err / dist * 100 ELSE 0 END, 3) AS drift_pct, round(CASE WHEN denied_s > 0 THEN dist / denied_s ELSE 0 END, 4) AS mean_speed, round(2.146::DOUBLE * greatest(0.19::DOUBLE * dist, 2), 3) AS radius_m,
 CASE WHEN dist < 20 THEN 'NOT SCORABLE' WHEN dist > 1 AND err / dist * 100 < 10 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""")
def run_summary(spark, sf_dir):
    """What the phone says at the end of a ride whose last four fifths had no fixes and whose dot stood still."""
    w = Window.partitionBy("ride_id")
    r = rides(spark, sf_dir).select("ride_id", "seq", (F.col("x_mm") / 1000).alias("x"), (F.col("y_mm") / 1000).alias("y"), F.ceil(F.count(F.lit(1)).over(w) * 0.2).alias("cut"), F.max("seq").over(w).alias("last"))
    ends = r.groupBy("ride_id").agg((F.max("last") - F.max("cut")).alias("denied_s"), F.max("last").cast("double").alias("seconds"), *[F.max_by(F.when(F.col("seq") <= F.col("cut"), F.col(c)), F.when(F.col("seq") <= F.col("cut"), F.col("seq"))).alias(f"p{c}") for c in "xy"])
    s = C.run_summary(r, ends)
    return s.select("ride_id", "fixes", *[F.round(c, 3).alias(c) for c in ("distance_m", "final_error_m", "drift_pct")], F.round("mean_speed", 4).alias("mean_speed"), F.round("radius_m", 3).alias("radius_m"), "verdict")


@query("q_drift_series", """, b AS (SELECT *, sum(step_mm) OVER (PARTITION BY ride_id ORDER BY seq) / 1000.0::DOUBLE AS gone, sqrt(pow(sum(value * 100 * cos(radians(head_deg::DOUBLE + 2))) OVER w - (x_mm - first_value(x_mm) OVER w), 2) + pow(sum(value * 100 * sin(radians(head_deg::DOUBLE + 2))) OVER w - (y_mm - first_value(y_mm) OVER w), 2)) / 1000.0::DOUBLE AS err FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq))
SELECT ride_id, seq, round(err / gone * 100, 4) AS drift_pct FROM b WHERE gone >= 200""")
def drift_series(spark, sf_dir):
    """Drift along a ride whose heading is two degrees off, from 200 m on."""
    w = by_ride().rowsBetween(Window.unboundedPreceding, 0)
    h = F.radians(F.col("head_deg").cast("double") + 2)
    off = lambda c, f: F.sum(F.col("value") * 100 * f(h)).over(w) - (F.col(c) - F.first(c).over(w))
    b = rides(spark, sf_dir).select("ride_id", "seq", (F.sum("step_mm").over(w) / 1000).alias("gone"), (F.sqrt(F.pow(off("x_mm", F.cos), 2) + F.pow(off("y_mm", F.sin), 2)) / 1000).alias("err"))
    return C.drift_series(b).select("ride_id", "seq", F.round("drift_pct", 4).alias("drift_pct"))
