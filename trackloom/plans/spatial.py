"""Queries of the spatial joins, aggregates over landmarks, set operations and place search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geo as G
from trackloom.functions import text as T
from trackloom.operators import series as S
from trackloom.operators import spatial as P
from trackloom.plans._register import Register
from trackloom.sources.rides import RIDES_SQL, by_ride, rides, table
from trackloom.sources.shared import materialize

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query


@query("q_grid_radius_join", """, h AS (SELECT event_id, ride_id, x_mm, y_mm FROM r WHERE hit)
SELECT a.event_id, count(*) AS near, CAST(min((a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm)) AS BIGINT) AS least_d2
FROM h a JOIN h b ON a.event_id <> b.event_id AND (a.x_mm - b.x_mm) * (a.x_mm - b.x_mm) + (a.y_mm - b.y_mm) * (a.y_mm - b.y_mm) <= 12000 * 12000::BIGINT GROUP BY a.event_id""")
def grid_radius_join(spark, sf_dir):
    h = rides(spark, sf_dir).where("hit")
    a = h.select("event_id", F.col("x_mm").alias("px"), F.col("y_mm").alias("py"))
    b = h.select(F.col("event_id").alias("other"), "x_mm", "y_mm")
    pairs = P.within_radius(a, b, 12000, "px", "py", "x_mm", "y_mm").where("event_id <> other")
    return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("near"), F.min("d2").alias("least_d2"))


@query("q_nearest_segment", """, sg AS (SELECT ride_id AS way, seq AS seg, x_mm AS ax, y_mm AS ay, lead(x_mm) OVER w AS bx, lead(y_mm) OVER w AS by_ FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
pt AS (SELECT event_id, ride_id AS own, x_mm AS px, y_mm AS py FROM r),
c AS (SELECT pt.*, sg.*, (bx - ax)::DOUBLE AS dx, (by_ - ay)::DOUBLE AS dy, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS l2 FROM pt JOIN sg ON own <> way AND bx IS NOT NULL AND px BETWEEN least(ax, bx) - 20000 AND greatest(ax, bx) + 20000 AND py BETWEEN least(ay, by_) - 20000 AND greatest(ay, by_) + 20000),
u AS (SELECT *, least(greatest(CASE WHEN l2 > 0 THEN ((px - ax) * dx + (py - ay) * dy) / l2 ELSE 0 END, 0), 1) AS u FROM c),
d AS (SELECT *, (ax + u * dx - px) * (ax + u * dx - px) + (ay + u * dy - py) * (ay + u * dy - py) AS d2 FROM u),
b AS (SELECT event_id, arg_min({'way': way, 'seg': seg, 'u': u, 'd2': d2}, (round(d2), way, seg)) AS b FROM d WHERE d2 <= 20000.0::DOUBLE * 20000 GROUP BY event_id)
SELECT event_id, b.way AS way, b.seg AS seg, round(b.u, 4) AS u, CAST(round(b.d2 / 1000) AS BIGINT) AS d2k FROM b""")
def nearest_segment(spark, sf_dir):
    """Of every point the nearest segment of another ride within 20 m."""
    r = materialize(rides(spark, sf_dir).select("event_id", "ride_id", "seq", "x_mm", "y_mm"), "rides")
    segs = P.segments(r, "ride_id", "seq", "x_mm", "y_mm").withColumnRenamed("ride_id", "way")
    points = r.select("event_id", F.col("ride_id").alias("own"), F.col("x_mm").alias("px"), F.col("y_mm").alias("py"))
    b = P.nearest_segment(points, segs, 20000, ["event_id"], "px", "py", lambda d: materialize(d, "nearest"), but="own")
    return b.select("event_id", "way", "seg", F.round("u", 4).alias("u"), F.round(F.col("d2") / 1000).cast("long").alias("d2k"))


CROSS_SQL = """, mk AS (SELECT event_id AS mark_id, x_mm AS mx, y_mm AS my FROM r WHERE hit),
nr AS (SELECT r.ride_id, r.seq, mk.mark_id, (x_mm - mx) * (x_mm - mx) + (y_mm - my) * (y_mm - my) AS d2 FROM r JOIN mk ON abs(x_mm - mx) <= 12000 AND abs(y_mm - my) <= 12000 AND (x_mm - mx) * (x_mm - mx) + (y_mm - my) * (y_mm - my) <= 144000000),
ps AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ride_id, mark_id ORDER BY seq) AS BIGINT) AS pass FROM (SELECT *, CASE WHEN coalesce(seq - lag(seq) OVER (PARTITION BY ride_id, mark_id ORDER BY seq) > 8, true) THEN 1 ELSE 0 END AS n FROM nr)),
cr AS (SELECT ride_id, mark_id, pass, arg_min(seq, (d2, seq)) AS closest_t, min(d2) AS d2, count(*) AS n FROM ps GROUP BY ALL)
"""


def _crossings(spark, sf_dir):
    r = rides(spark, sf_dir)
    marks = r.where("hit").select(F.col("event_id").alias("mark_id"), F.col("x_mm").alias("mx"), F.col("y_mm").alias("my"))
    return r, marks, P.crossings(r.select("ride_id", "seq", "x_mm", "y_mm"), marks, 12000, 8)


@query("q_landmark_crossings", CROSS_SQL + "SELECT * FROM cr")
def landmark_crossings(spark, sf_dir):
    return _crossings(spark, sf_dir)[2]


@query("q_found_and_passed", CROSS_SQL + "SELECT mark_id, count(DISTINCT ride_id) AS runs, 1 - pow(0.5::DOUBLE, count(DISTINCT ride_id)) AS confidence FROM cr GROUP BY mark_id HAVING count(DISTINCT ride_id) >= 2")
def found_and_passed(spark, sf_dir):
    """Marks that two rides or more have passed, with the confidence that gives."""
    c = _crossings(spark, sf_dir)[2]
    runs = F.count_distinct("ride_id")
    return c.groupBy("mark_id").agg(runs.alias("runs"), (1 - F.pow(F.lit(0.5), runs)).alias("confidence")).where("runs >= 2")


@query("q_found_against_passed", CROSS_SQL + """, fd AS (SELECT DISTINCT r.ride_id, mark_id FROM r JOIN mk ON hit AND k % 2 = 0 AND (x_mm - mx) * (x_mm - mx) + (y_mm - my) * (y_mm - my) <= 225000000),
pd AS (SELECT DISTINCT ride_id, mark_id FROM cr)
SELECT ride_id, count(*) AS passed, count(fd.mark_id) AS found, count(*) - count(fd.mark_id) AS missed FROM pd LEFT JOIN fd USING (ride_id, mark_id) GROUP BY ride_id""")
def found_against_passed(spark, sf_dir):
    """Of the marks that a ride passed within 12 m those that it detected within 15 m; every second hit is a detection."""
    r, marks, crossed = _crossings(spark, sf_dir)
    hits = P.within_radius(r.where("hit and k % 2 = 0").select("ride_id", "x_mm", "y_mm"), marks, 15000, "x_mm", "y_mm", "mx", "my").select("ride_id", "mark_id").distinct().withColumn("found", F.lit(1))
    passed = crossed.select("ride_id", "mark_id").distinct()
    n = passed.join(hits, ["ride_id", "mark_id"], "left").groupBy("ride_id").agg(F.count(F.lit(1)).alias("passed"), F.count("found").alias("found"))
    return n.withColumn("missed", F.col("passed") - F.col("found"))


@query("q_candidates", """SELECT x_mm // 12000 AS cx, y_mm // 12000 AS cy, count(*) AS n, count(DISTINCT ride_id) AS runs, (list(what ORDER BY same DESC, what))[1] AS kind, CAST(sum(x_mm) AS DOUBLE) / count(*) AS x, CAST(sum(y_mm) AS DOUBLE) / count(*) AS y
FROM (SELECT *, count(*) OVER (PARTITION BY fx, fy, what) AS same FROM (SELECT *, (['bump', 'hump', 'table'])[k % 3 + 1] AS what, floor(x_mm / 12000.0::DOUBLE) AS fx, floor(y_mm / 12000.0::DOUBLE) AS fy FROM r WHERE hit)) GROUP BY 1, 2 HAVING count(DISTINCT ride_id) >= 2""".replace("x_mm // 12000 AS cx, y_mm // 12000 AS cy", "CAST(fx AS BIGINT) AS cx, CAST(fy AS BIGINT) AS cy"))
def candidates(spark, sf_dir):
    """Clusters that two rides or more have hit, with the kind that most of the hits had (of equals the first by name)."""
    what = F.element_at(F.array(*map(F.lit, ("bump", "hump", "table"))), (F.col("k") % 3 + 1).cast("int"))
    g = P.clusters(rides(spark, sf_dir).where("hit").withColumn("what", what), 12000)
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ride_id").alias("runs"), F.mode("what", True).alias("kind"), F.avg("x_mm").alias("x"), F.avg("y_mm").alias("y")).where("runs >= 2")


@query("q_weighted_centroid", """, w AS (SELECT ride_id, x_mm, y_mm, 1.0::DOUBLE / (k + 1) AS w FROM r WHERE hit),
c AS (SELECT ride_id, sum(w * x_mm) / sum(w) AS x, sum(w * y_mm) / sum(w) AS y, count(*) AS n FROM w GROUP BY ride_id)
SELECT ride_id, round(c.x, 4) AS x, round(c.y, 4) AS y, c.n, round(sqrt(avg(pow(w.x_mm - c.x, 2) + pow(w.y_mm - c.y, 2))), 4) AS spread FROM w JOIN c USING (ride_id) GROUP BY ride_id, c.x, c.y, c.n""")
def weighted_centroid(spark, sf_dir):
    w = rides(spark, sf_dir).where("hit").select("ride_id", "x_mm", "y_mm", (F.lit(1.0) / (F.col("k") + 1)).alias("w"))
    c = w.groupBy("ride_id").agg((F.sum(F.col("w") * F.col("x_mm")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y_mm")) / F.sum("w")).alias("y"), F.count(F.lit(1)).alias("n"))
    s = w.join(c, "ride_id").groupBy("ride_id", "x", "y", "n").agg(F.sqrt(F.avg(F.pow(F.col("x_mm") - F.col("x"), 2) + F.pow(F.col("y_mm") - F.col("y"), 2))).alias("spread"))
    return s.select("ride_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "n", F.round("spread", 4).alias("spread"))


@query("q_mad_threshold", """, m AS (SELECT ride_id, quantile_cont(step_mm, 0.5) AS med FROM r GROUP BY ride_id), d AS (SELECT ride_id, 1.4826::DOUBLE * quantile_cont(abs(step_mm - med), 0.5) AS mad FROM r JOIN m USING (ride_id) GROUP BY ride_id)
SELECT r.ride_id, round(d.mad, 6) AS noise, count(*) FILTER (WHERE r.step_mm > m.med + 4 * d.mad) AS events FROM r JOIN m USING (ride_id) JOIN d USING (ride_id) GROUP BY r.ride_id, d.mad""")
def mad_threshold(spark, sf_dir):
    r = rides(spark, sf_dir)
    m = r.groupBy("ride_id").agg(F.percentile("step_mm", 0.5).alias("med"))
    x = r.join(m, "ride_id")
    d = x.groupBy("ride_id").agg((F.lit(1.4826) * F.percentile(F.abs(F.col("step_mm") - F.col("med")), 0.5)).alias("mad"))
    return x.join(d, "ride_id").groupBy("ride_id", "mad").agg(F.count_if(F.col("step_mm") > F.col("med") + 4 * F.col("mad")).alias("events")).select("ride_id", F.round("mad", 6).alias("noise"), "events")


@query("q_circular_mean", "SELECT ride_id, round(degrees(atan2(avg(sin(radians(head_deg))), avg(cos(radians(head_deg))))), 6) AS mean_deg, round(sqrt(pow(avg(cos(radians(head_deg))), 2) + pow(avg(sin(radians(head_deg))), 2)), 6) AS concentration FROM r GROUP BY ride_id HAVING count(*) >= 30")
def circular_mean(spark, sf_dir):
    a = F.radians("head_deg")
    g = rides(spark, sf_dir).groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sin(a)).alias("s"), F.avg(F.cos(a)).alias("c")).where("n >= 30")
    return g.select("ride_id", F.round(F.degrees(F.atan2("s", "c")), 6).alias("mean_deg"), F.round(F.sqrt(F.pow("c", F.lit(2)) + F.pow("s", F.lit(2))), 6).alias("concentration"))


@query("q_yaw_grid_corr", """, f AS (SELECT ride_id, dx_mm::DOUBLE AS ax, dy_mm::DOUBLE AS ay, step_mm - lag(step_mm) OVER (PARTITION BY ride_id ORDER BY seq) AS af FROM r),
m AS (SELECT ride_id, covar_pop(ax, af) AS cxf, covar_pop(ay, af) AS cyf, var_pop(ax) AS vx, var_pop(ay) AS vy, covar_pop(ax, ay) AS cxy, var_pop(af) AS vf FROM f WHERE af IS NOT NULL GROUP BY ride_id HAVING count(*) >= 20),
g AS (SELECT m.*, t * 0.5::DOUBLE AS yaw_deg, cos(radians(t * 0.5::DOUBLE)) AS c, sin(radians(t * 0.5::DOUBLE)) AS s FROM m, (SELECT unnest(generate_series(0, 720)) AS t)),
k AS (SELECT *, round((c * cxf + s * cyf) / sqrt((c * c * vx + 2 * c * s * cxy + s * s * vy) * vf), 6) AS corr FROM g)
SELECT ride_id, max(corr) AS corr FROM k GROUP BY ride_id""")
def yaw_grid_corr(spark, sf_dir):
    """Best correlation of the levelled acceleration with the forward one over 721 yaw angles, from five second moments."""
    r = rides(spark, sf_dir)
    f = r.select("ride_id", F.col("dx_mm").cast("double").alias("ax"), F.col("dy_mm").cast("double").alias("ay"), (F.col("step_mm") - F.lag("step_mm").over(by_ride())).cast("double").alias("af")).where("af is not null")
    m = f.groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ax", "af").alias("cxf"), F.covar_pop("ay", "af").alias("cyf"), F.var_pop("ax").alias("vx"), F.var_pop("ay").alias("vy"), F.covar_pop("ax", "ay").alias("cxy"), F.var_pop("af").alias("vf")).where("n >= 20")
    g = m.withColumn("yaw_deg", F.explode(F.transform(F.sequence(F.lit(0), F.lit(720)), lambda t: t * F.lit(0.5))))
    c, s = F.cos(F.radians("yaw_deg")), F.sin(F.radians("yaw_deg"))
    corr = (c * F.col("cxf") + s * F.col("cyf")) / F.sqrt((c * c * F.col("vx") + 2 * c * s * F.col("cxy") + s * s * F.col("vy")) * F.col("vf"))
    return g.groupBy("ride_id").agg(F.max(F.round(corr, 6)).alias("corr"))


@query("q_regression_origin", """, p AS (SELECT ride_id, dx_mm::DOUBLE AS x, step_mm::DOUBLE AS y FROM r),
a AS (SELECT ride_id, sum(x * y) / sum(x * x) AS b FROM p GROUP BY ride_id),
d AS (SELECT p.*, y - b * x AS res FROM p JOIN a USING (ride_id)), s AS (SELECT ride_id, stddev_pop(res) AS sd FROM d GROUP BY ride_id)
SELECT d.ride_id, round(sum(x * y) / sum(x * x), 6) AS slope, count(*) AS kept, round(corr(x, y), 6) AS r FROM d JOIN s USING (ride_id) WHERE abs(res) < 2.5 * sd GROUP BY d.ride_id""")
def regression_origin(spark, sf_dir):
    """Through the origin, fitted again without residuals beyond 2.5 deviations."""
    p = rides(spark, sf_dir).select("ride_id", F.col("dx_mm").cast("double").alias("x"), F.col("step_mm").cast("double").alias("y"))
    slope = F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))
    d = p.join(p.groupBy("ride_id").agg(slope.alias("b")), "ride_id").withColumn("res", F.col("y") - F.col("b") * F.col("x"))
    kept = d.join(d.groupBy("ride_id").agg(F.stddev_pop("res").alias("sd")), "ride_id").where("abs(res) < 2.5 * sd")
    return kept.groupBy("ride_id").agg(F.round(slope, 6).alias("slope"), F.count(F.lit(1)).alias("kept"), F.round(F.corr("x", "y"), 6).alias("r"))


@query("q_scale_and_offset", "SELECT ride_id, round(regr_slope(d_mm, seq), 4) AS scale, round(regr_intercept(d_mm, seq), 4) AS offset_mm FROM r GROUP BY ride_id")
def scale_and_offset(spark, sf_dir):
    return rides(spark, sf_dir).groupBy("ride_id").agg(F.round(F.regr_slope("d_mm", "seq"), 4).alias("scale"), F.round(F.regr_intercept("d_mm", "seq"), 4).alias("offset_mm"))


@query("q_vehicle_gate", """SELECT ride_id, CASE WHEN max(seq) < 45 THEN 'unknown' WHEN avg(CASE WHEN step_mm > 2500 THEN 1.0::DOUBLE ELSE 0 END) < 0.35 AND quantile_cont(step_mm, 0.5) < 2500 THEN 'pedestrian' WHEN round(stddev_pop(k), 6) > 28.5 THEN 'two_wheeler' ELSE 'car' END AS vehicle FROM r GROUP BY ride_id""")
def vehicle_gate(spark, sf_dir):
    g = rides(spark, sf_dir).groupBy("ride_id").agg(F.max("seq").alias("t"), F.avg((F.col("step_mm") > 2500).cast("double")).alias("moving"), F.percentile("step_mm", 0.5).alias("med"), F.round(F.stddev_pop("k"), 6).alias("shake"))
    return g.select("ride_id", F.when(F.col("t") < 45, "unknown").when((F.col("moving") < 0.35) & (F.col("med") < 2500), "pedestrian").when(F.col("shake") > 28.5, "two_wheeler").otherwise("car").alias("vehicle"))


@query("q_outcome_counts", """, a AS (SELECT ride_id, min(CASE WHEN abs(head_deg) > 300 THEN d_mm END) AS dev, min(CASE WHEN abs(head_deg) > 350 OR kind = 'error' AND k > 90 THEN d_mm END) AS al, min(k) % 3 AS mount FROM r GROUP BY ride_id),
o AS (SELECT *, CASE WHEN dev IS NULL AND al IS NULL THEN 'quiet' WHEN dev IS NULL THEN 'false alarm' WHEN al IS NULL THEN 'missed' WHEN al < dev THEN 'early' ELSE 'caught' END AS outcome FROM a)
SELECT CAST(mount AS BIGINT) AS mount, outcome, count(*) AS n, round(quantile_cont(al - dev, 0.5), 6) AS median_delay, CAST(max(al - dev) AS BIGINT) AS worst_delay FROM o GROUP BY ALL""")
def outcome_counts(spark, sf_dir):
    from trackloom.operators.score import outcome

    a = rides(spark, sf_dir).groupBy("ride_id").agg(F.min(F.when(F.abs("head_deg") > 300, F.col("d_mm"))).alias("dev"), F.min(F.when((F.abs("head_deg") > 350) | ((F.col("kind") == "error") & (F.col("k") > 90)), F.col("d_mm"))).alias("al"), (F.min("k") % 3).alias("mount"))
    o = a.withColumn("outcome", outcome(F.col("dev"), F.col("al"))).withColumn("delay", F.col("al") - F.col("dev"))
    return o.groupBy("mount", "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("delay", 0.5), 6).alias("median_delay"), F.max("delay").alias("worst_delay"))


@query("q_perf_by_flag", "SELECT hit AS ai_active, count(*) AS n, round(avg(value), 6) AS mean_ms, max(value) AS worst_ms, round(quantile_cont(value, 0.5), 6) AS median_mb, arg_min(k, event_id) AS first_pct, arg_max(k, event_id) AS last_pct FROM r GROUP BY hit")
def perf_by_flag(spark, sf_dir):
    return rides(spark, sf_dir).groupBy(F.col("hit").alias("ai_active")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"), F.max("value").alias("worst_ms"), F.round(F.percentile("value", 0.5), 6).alias("median_mb"), F.min_by("k", "event_id").alias("first_pct"), F.max_by("k", "event_id").alias("last_pct"))


@query("q_channel_stats", "SELECT ride_id, round(avg(dx_mm), 6) AS mean_x, round(stddev_pop(dx_mm) + 1e-6, 4) AS std_x, round(avg(dy_mm), 6) AS mean_y, round(stddev_pop(dy_mm) + 1e-6, 4) AS std_y FROM r GROUP BY ride_id")
def channel_stats(spark, sf_dir):
    g = rides(spark, sf_dir).groupBy("ride_id")
    return g.agg(*[x for c in "xy" for x in (F.round(F.avg(f"d{c}_mm"), 6).alias(f"mean_{c}"), F.round(F.stddev_pop(f"d{c}_mm") + 1e-6, 4).alias(f"std_{c}"))])


@query("q_turn_density", "SELECT ride_id, round(CAST(sum(abs(k - 50)) AS DOUBLE) / (max(d_mm) / 1000000.0::DOUBLE), 4) AS deg_per_km FROM r GROUP BY ride_id")
def turn_density(spark, sf_dir):
    return rides(spark, sf_dir).groupBy("ride_id").agg(F.round(F.sum(F.abs(F.col("k") - 50)).cast("double") / (F.max("d_mm") / 1000000.0), 4).alias("deg_per_km"))


@query("q_class_weights", "SELECT event_type, count(*) AS n, round(greatest(sqrt(1.0::DOUBLE / (count(*)::DOUBLE / sum(count(*)) OVER ())), 0.15), 6) AS weight FROM events GROUP BY event_type", ctes=False)
def class_weights(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", "n", F.round(F.greatest(F.sqrt(F.lit(1.0) / (F.col("n") / F.sum("n").over(Window.partitionBy()))), F.lit(0.15)), 6).alias("weight"))


@query("q_detection_f1", """, c AS (SELECT count(*) FILTER (WHERE hit AND k > 60) AS tp, count(*) FILTER (WHERE NOT hit AND k > 60) AS fp, count(*) FILTER (WHERE hit AND k <= 60) AS fn FROM r)
SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(tp::DOUBLE / (tp + fp), 6) AS precision_, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def detection_f1(spark, sf_dir):
    hit, said = F.col("hit"), F.col("k") > 60
    c = rides(spark, sf_dir).agg(F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"), F.count_if(hit & ~said).alias("fn"))
    return c.select("tp", "fp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision_"), F.round(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


@query("q_speed_calibration", """, m AS (SELECT ride_id, max(seq) // 2 AS cut FROM r GROUP BY ride_id),
s AS (SELECT r.ride_id, sum(step_mm) FILTER (WHERE seq >= cut - 20 AND seq < cut) AS gps, sum(k * 100) FILTER (WHERE seq >= cut - 20 AND seq < cut) AS ai FROM r JOIN m USING (ride_id) GROUP BY r.ride_id)
SELECT ride_id, round(CASE WHEN ai > 50000 THEN least(greatest(gps::DOUBLE / ai, 0.8), 1.25) ELSE 1 END, 6) AS scale FROM s""")
def speed_calibration(spark, sf_dir):
    r = rides(spark, sf_dir)
    x = r.join(r.groupBy("ride_id").agg(F.floor(F.max("seq") / 2).alias("cut")), "ride_id").where("seq >= cut - 20 and seq < cut")
    g = x.groupBy("ride_id").agg(F.sum("step_mm").alias("gps"), F.sum(F.col("k") * 100).alias("ai"))
    return g.select("ride_id", F.round(F.when(F.col("ai") > 50000, F.least(F.greatest(F.col("gps") / F.col("ai"), F.lit(0.8)), F.lit(1.25))).otherwise(1.0), 6).alias("scale"))


@query("q_clean_steps", """, b AS (SELECT ride_id, seq, x_mm, y_mm, coalesce(pow(x_mm - lag(x_mm) OVER w, 2) + pow(y_mm - lag(y_mm) OVER w, 2) > pow(15000.0::DOUBLE * (seq - lag(seq) OVER w), 2), false) AS bad FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq))
SELECT ride_id, count(*) AS fixes, count(*) FILTER (WHERE bad) AS spikes FROM b GROUP BY ride_id""")
def clean_steps(spark, sf_dir):
    """One pass of the speed-spike filter: later ends of steps over 15 m/s."""
    w = by_ride()
    far = F.pow(F.col("x_mm") - F.lag("x_mm").over(w), 2) + F.pow(F.col("y_mm") - F.lag("y_mm").over(w), 2) > F.pow(F.lit(15000.0) * (F.col("seq") - F.lag("seq").over(w)), 2)
    return rides(spark, sf_dir).withColumn("bad", F.coalesce(far, F.lit(False))).groupBy("ride_id").agg(F.count(F.lit(1)).alias("fixes"), F.count_if("bad").alias("spikes"))


@query("q_coverage_gate", """, z AS (SELECT ride_id, quantile_cont(step_mm, 0.9) / 100.0::DOUBLE AS p90, max(step_mm) / 100.0::DOUBLE AS top, count(*) AS n FROM r GROUP BY ride_id)
SELECT ride_id, CASE WHEN n < 10 THEN 'SKIP' WHEN p90 > 150 OR top > 300 THEN 'FAIL' WHEN p90 > 80 OR top > 150 THEN 'WARN' ELSE 'OK' END AS gate FROM z""")
def coverage_gate(spark, sf_dir):
    z = rides(spark, sf_dir).groupBy("ride_id").agg((F.percentile("step_mm", 0.9) / 100.0).alias("p90"), (F.max("step_mm") / 100.0).alias("top"), F.count(F.lit(1)).alias("n"))
    return z.select("ride_id", F.when(F.col("n") < 10, "SKIP").when((F.col("p90") > 150) | (F.col("top") > 300), "FAIL").when((F.col("p90") > 80) | (F.col("top") > 150), "WARN").otherwise("OK").alias("gate"))


@query("q_outside_blackouts", """, i AS (SELECT ride_id, min(seq) AS i0, max(seq) AS i1 FROM (SELECT *, sum(n) OVER (PARTITION BY ride_id ORDER BY seq) AS g FROM (SELECT *, CASE WHEN lag(gnss_ok) OVER (PARTITION BY ride_id ORDER BY seq) IS NOT DISTINCT FROM gnss_ok THEN 0 ELSE 1 END AS n FROM r)) WHERE NOT gnss_ok GROUP BY ride_id, g)
SELECT h.ride_id, h.seq FROM r h WHERE hit AND NOT EXISTS (SELECT 1 FROM i WHERE i.ride_id = h.ride_id AND h.seq BETWEEN i.i0 - 1 AND i.i1 + 1)""")
def outside_blackouts(spark, sf_dir):
    """Landmark hits that no outage, widened by a second, covers: an anti-join on intervals."""
    r = rides(spark, sf_dir)
    i = S.islands(r, F.col("gnss_ok"), "ride_id", "seq").where("not gnss_ok").groupBy("ride_id", "island").agg(F.min("seq").alias("i0"), F.max("seq").alias("i1"))
    h = r.where("hit").select("ride_id", "seq")
    return h.join(i.withColumnRenamed("ride_id", "of"), (F.col("ride_id") == F.col("of")) & F.col("seq").between(F.col("i0") - 1, F.col("i1") + 1), "left_anti")


@query("q_offroute_two_in_a_row", """, f AS (SELECT ride_id, seq, step_mm > 4000 AND step_mm > k * 50 AS off, max(CASE WHEN step_mm <= 2500 THEN 1 ELSE 0 END) OVER (PARTITION BY ride_id ORDER BY seq) = 1 AS joined FROM r),
g AS (SELECT *, joined AND off AND coalesce(lag(joined AND off) OVER (PARTITION BY ride_id ORDER BY seq), false) AS alarm FROM f)
SELECT ride_id, min(seq) FILTER (WHERE alarm) AS first_alarm, count(*) FILTER (WHERE alarm) AS alarms FROM g GROUP BY ride_id""")
def offroute_two_in_a_row(spark, sf_dir):
    """Off the route for two fixes in a row once it was joined; step stands for the distance off, k for the accuracy."""
    w = by_ride()
    joined = F.max(F.when(F.col("step_mm") <= 2500, 1).otherwise(0)).over(w) == 1
    r = rides(spark, sf_dir).withColumn("off", joined & (F.col("step_mm") > 4000) & (F.col("step_mm") > F.col("k") * 50))
    r = r.withColumn("alarm", F.col("off") & F.coalesce(F.lag("off").over(w), F.lit(False)))
    return r.groupBy("ride_id").agg(F.min(F.when(F.col("alarm"), F.col("seq"))).alias("first_alarm"), F.count_if("alarm").alias("alarms"))


@query("q_holdout_split", "SELECT ride_id, count(*) AS n FROM r WHERE ride_id NOT IN (SELECT ride_id FROM r GROUP BY ride_id HAVING max(seq) >= 70) GROUP BY ride_id")
def holdout_split(spark, sf_dir):
    r = rides(spark, sf_dir)
    held = r.groupBy("ride_id").agg(F.max("seq").alias("m")).where("m >= 70")
    return r.join(held, "ride_id", "left_anti").groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"))


@query("q_set_operations", "SELECT ride_id, 'both' AS side FROM ((SELECT DISTINCT ride_id FROM r WHERE hit AND k > 70) INTERSECT (SELECT DISTINCT ride_id FROM r WHERE NOT gnss_ok AND k > 70)) UNION ALL SELECT ride_id, 'hit only' FROM ((SELECT DISTINCT ride_id FROM r WHERE hit AND k > 95) EXCEPT (SELECT DISTINCT ride_id FROM r WHERE NOT gnss_ok AND k > 95))")
def set_operations(spark, sf_dir):
    r = rides(spark, sf_dir)
    ids = lambda cond: r.where(cond).select("ride_id")
    both = ids("hit and k > 70").intersect(ids("not gnss_ok and k > 70")).withColumn("side", F.lit("both"))
    return both.unionByName(ids("hit and k > 95").subtract(ids("not gnss_ok and k > 95")).withColumn("side", F.lit("hit only")))


@query("q_loro_pairs", ", n AS (SELECT ride_id, count(*) AS n FROM r GROUP BY ride_id) SELECT ride_id AS held_out, CAST((SELECT sum(n) FROM n) - n AS BIGINT) AS rows_learned, (SELECT count(*) FROM n) - 1 AS rides_learned FROM n")
def loro_pairs(spark, sf_dir):
    """Leave one ride out: what is left to learn from is all less the ride's own, so no pair of rides is formed."""
    r = rides(spark, sf_dir).groupBy("ride_id").agg(F.count(F.lit(1)).alias("n"))
    every = r.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("rides"))
    return r.crossJoin(F.broadcast(every)).select(F.col("ride_id").alias("held_out"), (F.col("rows") - F.col("n")).alias("rows_learned"), (F.col("rides") - 1).alias("rides_learned"))  # one row


@query("q_projection_round_trip", "SELECT event_id, CAST(round(x_mm) AS BIGINT) AS x_mm, CAST(round(y_mm) AS BIGINT) AS y_mm, true AS same FROM r")
def projection_round_trip(spark, sf_dir):
    r = rides(spark, sf_dir)
    lat, lon = G.from_enu(F.col("x_mm") / 1000, F.col("y_mm") / 1000, 15.36, 75.12)
    x, y = G.to_enu(F.col("lat"), F.col("lon"), 15.36, 75.12)
    back = r.select("event_id", "x_mm", "y_mm", lat.alias("lat"), lon.alias("lon")).select("event_id", "x_mm", "y_mm", x.alias("x"), y.alias("y"))
    return back.select("event_id", F.round(F.col("x") * 1000).cast("long").alias("x_mm"), F.round(F.col("y") * 1000).cast("long").alias("y_mm"), (F.hypot(F.col("x") * 1000 - F.col("x_mm"), F.col("y") * 1000 - F.col("y_mm")) < 0.01).alias("same"))


@query("q_display_text", """SELECT event_id, CASE WHEN value < 1000 THEN CAST(CAST(round(value / 10) * 10 AS BIGINT) AS VARCHAR) || ' m' ELSE printf('%.1f km', value / 1000) END AS distance,
CASE WHEN k < 20 THEN 'hairpin' WHEN k < 60 THEN 'sharp' ELSE 'bend' END AS turn,
CASE WHEN abs(k - 50) * 4 >= 165 THEN 'Make a U-turn' ELSE (CASE WHEN abs(k - 50) * 4 >= 140 THEN 'Turn sharp ' WHEN abs(k - 50) * 4 >= 50 THEN 'Turn ' ELSE 'Keep ' END) || CASE WHEN k - 50 > 0 THEN 'left' ELSE 'right' END END AS say FROM r""")
def display_text(spark, sf_dir):
    r = rides(spark, sf_dir)
    return r.select("event_id", T.distance_text(F.col("value")).alias("distance"), T.turn_kind(F.col("k")).alias("turn"), T.maneuver_text((F.col("k") - 50) * 4).alias("say"))


@query("q_place_search", """WITH q AS (SELECT unnest(['small', 'bol']) AS t, unnest([1, 2]) AS i),
p AS (SELECT p_partkey, p_name, list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM part),
m AS (SELECT p_partkey, len(w) AS n, i, max(CASE WHEN x = t THEN 2 WHEN i = 2 AND starts_with(x, t) THEN 1 WHEN length(t) >= 4 AND levenshtein(x, t) <= 1 THEN 1 ELSE 0 END) AS best FROM (SELECT p_partkey, w, unnest(w) AS x FROM p), q GROUP BY p_partkey, n, i)
SELECT p_partkey, CAST(sum(best) + CASE WHEN any_value(n) = 2 THEN 1 ELSE 0 END AS INT) AS score FROM m GROUP BY p_partkey HAVING min(best) > 0 ORDER BY score DESC, p_partkey LIMIT 8""", ctes=False)
def place_search(spark, sf_dir):
    """The eight best matches of a typed query among names."""
    p = table(spark, sf_dir, "part").select("p_partkey", T.search_score(["small", "bol"], [T.tokens(F.col("p_name"))]).alias("score")).where("score is not null")
    return p.orderBy(F.desc("score"), "p_partkey").limit(8)
