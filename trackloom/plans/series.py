"""Queries of the series operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.operators import series as S
from trackloom.plans._register import Register
from trackloom.sources.rides import RIDES_SQL, by_ride, rides

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query


@query("q_path_length", "SELECT ride_id, seq, step_mm, d_mm, step_mm - coalesce(lag(step_mm) OVER (PARTITION BY ride_id ORDER BY seq), step_mm) AS change_mm FROM r")
def path_length(spark, sf_dir):
    r = rides(spark, sf_dir)
    return r.select("ride_id", "seq", "step_mm", "d_mm", S.difference(F.col("step_mm"), by_ride()).alias("change_mm"))


@query("q_rolling_median5", "SELECT ride_id, seq, round(quantile_cont(step_mm, 0.5) OVER (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median_mm FROM r")
def rolling_median5(spark, sf_dir):
    return rides(spark, sf_dir).select("ride_id", "seq", F.round(S.rolling(F.col("step_mm"), by_ride(), 2, 2, "median"), 6).alias("median_mm"))


@query("q_rolling_mean_centred", "SELECT ride_id, seq, round(sum(step_mm) OVER w / count(*) OVER w, 6) AS mean_mm, max(step_mm) OVER w AS envelope_mm FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def rolling_mean_centred(spark, sf_dir):
    w = by_ride()
    return rides(spark, sf_dir).select("ride_id", "seq", F.round(S.rolling(F.col("step_mm"), w, 4, 4, "mean"), 6).alias("mean_mm"), S.rolling(F.col("step_mm"), w, 4, 4, "max").alias("envelope_mm"))


@query("q_rolling_mean_trailing81", "SELECT ride_id, seq, round(sum(step_mm) OVER w / count(*) OVER w, 6) AS mean_mm FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 80 PRECEDING AND CURRENT ROW)")
def rolling_mean_trailing81(spark, sf_dir):
    return rides(spark, sf_dir).select("ride_id", "seq", F.round(S.rolling(F.col("step_mm"), by_ride(), 80, 0, "mean"), 6).alias("mean_mm"))


@query("q_smooth_padded", """, p AS (
  SELECT ride_id, seq, x_mm, o, coalesce(lag(x_mm, -o) OVER w, 0) AS dummy FROM r, (SELECT 0 AS o) WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
n AS (SELECT ride_id, max(seq) AS hi FROM r GROUP BY ride_id)
SELECT a.ride_id, a.seq, round(sum(b.x_mm) / 6.0::DOUBLE, 6) AS smooth_mm
FROM r a JOIN n USING (ride_id), (SELECT unnest([-3, -2, -1, 0, 1, 2]) AS o) k, r b
WHERE b.ride_id = a.ride_id AND b.seq = least(greatest(a.seq + k.o, 0), n.hi) GROUP BY a.ride_id, a.seq""")
def smooth_padded(spark, sf_dir):
    whole = Window.partitionBy("ride_id")
    return rides(spark, sf_dir).select("ride_id", "seq", F.round(S.padded_mean(F.col("x_mm"), by_ride(), whole, 3, 2), 6).alias("smooth_mm"))


@query("q_central_gradient", "SELECT ride_id, seq, round(coalesce((lead(x_mm) OVER w - lag(x_mm) OVER w) / 2.0::DOUBLE, (lead(x_mm) OVER w - x_mm)::DOUBLE, (x_mm - lag(x_mm) OVER w)::DOUBLE, 0), 6) AS vx FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq)")
def central_gradient(spark, sf_dir):
    return rides(spark, sf_dir).select("ride_id", "seq", F.round(S.gradient(F.col("x_mm"), by_ride()), 6).alias("vx"))


@query("q_unwrap_heading", """, w1 AS (SELECT ride_id, seq, head_deg, CASE WHEN ((head_deg % 360) + 360) % 360 > 180 THEN ((head_deg % 360) + 360) % 360 - 360 ELSE ((head_deg % 360) + 360) % 360 END AS wrapped FROM r),
w2 AS (SELECT *, wrapped - lag(wrapped) OVER (PARTITION BY ride_id ORDER BY seq) AS d FROM w1),
w3 AS (SELECT *, CASE WHEN (((d + 180) % 360) + 360) % 360 - 180 = -180 AND d > 0 THEN 180 ELSE (((d + 180) % 360) + 360) % 360 - 180 END AS y FROM w2),
w4 AS (SELECT *, coalesce(CASE WHEN abs(d) < 180 THEN 0 ELSE y - d END, 0) AS c FROM w3)
SELECT ride_id, seq, wrapped, CAST(wrapped + sum(c) OVER (PARTITION BY ride_id ORDER BY seq) AS BIGINT) AS unwrapped FROM w4""")
def unwrap_heading(spark, sf_dir):
    r = rides(spark, sf_dir).select("ride_id", "seq", S.wrap_degrees(F.col("head_deg")).alias("wrapped"))
    return S.with_unwrapped(r, "wrapped", "unwrapped", "ride_id", "seq")


@query("q_asof_last_fix", """, f AS (SELECT ride_id, seq AS fix_t, x_mm AS fix_x, y_mm AS fix_y FROM r WHERE gnss_ok)
SELECT r.ride_id, r.seq, f.fix_t AS right_t, f.fix_x, f.fix_y FROM r ASOF LEFT JOIN f ON r.ride_id = f.ride_id AND r.seq >= f.fix_t""")
def asof_last_fix(spark, sf_dir):
    r = rides(spark, sf_dir)
    fixes = r.where("gnss_ok").select("ride_id", "seq", F.col("x_mm").alias("fix_x"), F.col("y_mm").alias("fix_y"))
    return S.asof(r.select("ride_id", "seq"), fixes, "ride_id", "seq", ["fix_x", "fix_y"])


@query("q_asof_fresh", """, f AS (SELECT ride_id, seq AS fix_t, step_mm AS speed FROM r WHERE hit)
SELECT r.ride_id, r.seq, CASE WHEN r.seq - f.fix_t <= 3 THEN f.fix_t END AS right_t, CASE WHEN r.seq - f.fix_t <= 3 THEN f.speed END AS speed FROM r ASOF LEFT JOIN f ON r.ride_id = f.ride_id AND r.seq >= f.fix_t""")
def asof_fresh(spark, sf_dir):
    r = rides(spark, sf_dir)
    return S.asof(r.select("ride_id", "seq"), r.where("hit").select("ride_id", "seq", F.col("step_mm").alias("speed")), "ride_id", "seq", ["speed"], 3)


@query("q_interp_grid", """, s AS (SELECT ride_id, seq * 2 AS t2, d_mm FROM r WHERE gnss_ok), g AS (SELECT ride_id, unnest(generate_series(0, max(seq) * 2)) AS t2 FROM r GROUP BY ride_id),
lo AS (SELECT g.ride_id, g.t2, s.t2 AS t0, s.d_mm AS v0 FROM g ASOF LEFT JOIN s ON g.ride_id = s.ride_id AND g.t2 >= s.t2),
hi AS (SELECT lo.*, s.t2 AS t1, s.d_mm AS v1 FROM lo ASOF LEFT JOIN s ON lo.ride_id = s.ride_id AND lo.t2 <= s.t2)
SELECT ride_id, t2, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t2 - t0)::DOUBLE / (t1 - t0) END, 6) AS d_mm FROM hi""")
def interp_grid(spark, sf_dir):
    r = rides(spark, sf_dir)
    grid = r.groupBy("ride_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("seq") * 2)).alias("t2"))
    samples = r.where("gnss_ok").select("ride_id", (F.col("seq") * 2).alias("t2"), "d_mm")
    return S.interpolate(grid, samples, "ride_id", "t2", "d_mm").select("ride_id", "t2", F.round(F.col("d_mm").cast("double"), 6).alias("d_mm"))


@query("q_nearest_time", """, s AS (SELECT ride_id, seq AS t, x_mm FROM r WHERE hit),
lo AS (SELECT r.ride_id, r.seq, s.t AS t0, s.x_mm AS v0 FROM r ASOF LEFT JOIN s ON r.ride_id = s.ride_id AND r.seq >= s.t),
hi AS (SELECT lo.*, s.t AS t1, s.x_mm AS v1 FROM lo ASOF LEFT JOIN s ON lo.ride_id = s.ride_id AND lo.seq <= s.t)
SELECT ride_id, seq, CASE WHEN coalesce(seq - t0 <= t1 - seq, t1 IS NULL) THEN t0 ELSE t1 END AS near_t, CASE WHEN coalesce(seq - t0 <= t1 - seq, t1 IS NULL) THEN v0 ELSE v1 END AS x_mm FROM hi""")
def nearest_time(spark, sf_dir):
    r = rides(spark, sf_dir)
    return S.nearest(r.select("ride_id", "seq"), r.where("hit").select("ride_id", "seq", "x_mm"), "ride_id", "seq", "x_mm")


@query("q_searchsorted_distance", """, m AS (SELECT ride_id, max(d_mm) AS total FROM r GROUP BY ride_id),
g AS (SELECT ride_id, unnest(generate_series(0, total, 25000)) AS target FROM m)
SELECT g.ride_id, CAST(g.target AS BIGINT) AS target, r.seq AS i FROM g ASOF JOIN r ON g.ride_id = r.ride_id AND g.target <= r.d_mm""")
def searchsorted_distance(spark, sf_dir):
    r = rides(spark, sf_dir)
    from trackloom.operators.outage import first_at_or_after

    targets = r.groupBy("ride_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("d_mm"), F.lit(25000).cast("long"))).alias("target"))
    return first_at_or_after(targets, r.select("ride_id", "seq", "d_mm"), "ride_id", "target", "d_mm", "seq", "i")


@query("q_islands_turns", """, s AS (SELECT ride_id, seq, k, sign(k - 50) AS sg FROM r),
b AS (SELECT *, CASE WHEN lag(sg) OVER (PARTITION BY ride_id ORDER BY seq) IS NOT DISTINCT FROM sg THEN 0 ELSE 1 END AS n FROM s),
i AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ride_id ORDER BY seq) AS BIGINT) AS island FROM b)
SELECT ride_id, island, min(seq) AS i0, max(seq) AS i1, CAST(sum(k - 50) AS BIGINT) AS angle_deg, arg_max(seq, (abs(k - 50), -seq)) AS apex FROM i WHERE sg <> 0 GROUP BY ride_id, island HAVING count(*) >= 2""")
def islands_turns(spark, sf_dir):
    r = rides(spark, sf_dir).select("ride_id", "seq", "k", F.signum(F.col("k") - 50).alias("sg"))
    runs = S.islands(r, F.col("sg"), "ride_id", "seq").where("sg <> 0")
    g = runs.groupBy("ride_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("i0"), F.max("seq").alias("i1"), F.sum(F.col("k") - 50).alias("angle_deg"), F.max_by("seq", F.struct(F.abs(F.col("k") - 50), -F.col("seq"))).alias("apex"))
    return g.where("n >= 2").drop("n")


@query("q_first_sustained", """, m AS (SELECT ride_id, seq, step_mm > 3000 AS fast FROM r),
b AS (SELECT *, CASE WHEN lag(fast) OVER (PARTITION BY ride_id ORDER BY seq) IS NOT DISTINCT FROM fast THEN 0 ELSE 1 END AS n FROM m),
i AS (SELECT *, sum(n) OVER (PARTITION BY ride_id ORDER BY seq) AS run FROM b),
h AS (SELECT *, seq - min(seq) OVER (PARTITION BY ride_id, run) AS held FROM i)
SELECT ride_id, min(CASE WHEN fast AND held >= 3 THEN seq END) AS seq FROM h GROUP BY ride_id""")
def first_sustained(spark, sf_dir):
    return S.first_sustained(rides(spark, sf_dir), F.col("step_mm") > 3000, "ride_id", "seq", 3)


@query("q_sessions_gap", """, f AS (SELECT ride_id, seq, lag(seq) OVER (PARTITION BY ride_id ORDER BY seq) AS before FROM r WHERE hit),
s AS (SELECT *, CAST(sum(CASE WHEN coalesce(seq - before > 8, true) THEN 1 ELSE 0 END) OVER (PARTITION BY ride_id ORDER BY seq) AS BIGINT) AS session FROM f)
SELECT ride_id, session, min(seq) AS t0, max(seq) AS t1, count(*) AS hits FROM s GROUP BY ride_id, session""")
def sessions_gap(spark, sf_dir):
    hits = rides(spark, sf_dir).where("hit")
    s = S.sessions(hits, F.col("seq") - F.lag("seq").over(by_ride()) > 8, "ride_id", "seq")
    return s.groupBy("ride_id", "session").agg(F.min("seq").alias("t0"), F.max("seq").alias("t1"), F.count(F.lit(1)).alias("hits"))


@query("q_windows_stride", """, w AS (SELECT ride_id, seq, list(step_mm) OVER (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS v, d_mm, lead(d_mm, 19) OVER (PARTITION BY ride_id ORDER BY seq) AS d1 FROM r)
SELECT ride_id, seq, d1 - d_mm AS label_mm, CAST(list_sum(v) AS BIGINT) AS total_mm, list_max(v) AS top_mm FROM w WHERE seq % 8 = 0 AND len(v) = 20""")
def windows_stride(spark, sf_dir):
    r = rides(spark, sf_dir).withColumn("label_mm", F.lead("d_mm", 19).over(by_ride()) - F.col("d_mm"))
    w = S.trailing_windows(r, "step_mm", "ride_id", "seq", 20, 8).join(r.select("ride_id", "seq", "label_mm"), ["ride_id", "seq"])
    return w.select("ride_id", "seq", "label_mm", F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_mm"), F.array_max("window").alias("top_mm"))


@query("q_decimate", "SELECT ride_id, seq, x_mm, y_mm FROM r WHERE seq % 5 = 0")
def decimate(spark, sf_dir):
    return S.decimate(rides(spark, sf_dir), "seq", 5).select("ride_id", "seq", "x_mm", "y_mm")


@query("q_held_speed", """, w AS (SELECT ride_id, seq, list(step_mm) FILTER (WHERE gnss_ok AND step_mm > 1500) OVER (PARTITION BY ride_id ORDER BY seq RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS v, gnss_ok AS ok FROM r)
SELECT ride_id, seq, last_value(CASE WHEN ok THEN {'h': list_sort(v)[len(v) // 2 + 1]} END IGNORE NULLS) OVER (PARTITION BY ride_id ORDER BY seq).h AS held_mm FROM w""")
def held_speed(spark, sf_dir):
    """The upper median of good fixes' speeds in the trailing 30 seconds; during a blackout that of its start."""
    fast = F.when(F.col("gnss_ok") & (F.col("step_mm") > 1500), F.col("step_mm"))
    found = F.sort_array(F.collect_list(fast).over(by_ride().rangeBetween(-30, 0)))
    r = rides(spark, sf_dir).select("ride_id", "seq", F.when(F.col("gnss_ok"), F.struct(F.get(found, (F.size(found) / 2).cast("int")).alias("held_mm"))).alias("h"))
    return r.select("ride_id", "seq", F.last("h", True).over(by_ride().rowsBetween(Window.unboundedPreceding, 0))["held_mm"].alias("held_mm"))


@query("q_course_over_ground", """, s AS (SELECT ride_id, seq, lag(seq) OVER w AS s0, x_mm - lag(x_mm) OVER w AS dx, y_mm - lag(y_mm) OVER w AS dy FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq))
SELECT ride_id, seq, (seq + s0) / 2.0::DOUBLE AS t_mid, CAST(round(degrees(atan2(dy, dx)) * 1000) AS BIGINT) AS course_mdeg FROM s WHERE dx * dx + dy * dy >= 4000000""")
def course_over_ground(spark, sf_dir):
    w = by_ride()
    s = rides(spark, sf_dir).select("ride_id", "seq", F.lag("seq").over(w).alias("s0"), (F.col("x_mm") - F.lag("x_mm").over(w)).alias("dx"), (F.col("y_mm") - F.lag("y_mm").over(w)).alias("dy"))
    return s.where("dx * dx + dy * dy >= 4000000").select("ride_id", "seq", ((F.col("seq") + F.col("s0")) / 2.0).alias("t_mid"), F.round(F.degrees(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double"))) * 1000).cast("long").alias("course_mdeg"))


@query("q_dwell_islands", """, m AS (SELECT ride_id, seq, x_mm, quantile_cont(step_mm, 0.5) OVER (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) < 3000 AS slow FROM r),
b AS (SELECT *, CASE WHEN lag(slow) OVER (PARTITION BY ride_id ORDER BY seq) IS NOT DISTINCT FROM slow THEN 0 ELSE 1 END AS n FROM m),
i AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ride_id ORDER BY seq) AS BIGINT) AS island FROM b)
SELECT ride_id, island, min(seq) AS i0, max(seq) AS i1, max(x_mm) - min(x_mm) AS spread_mm FROM i WHERE slow GROUP BY ride_id, island HAVING max(seq) - min(seq) >= 5""")
def dwell_islands(spark, sf_dir):
    r = rides(spark, sf_dir).withColumn("slow", S.rolling(F.col("step_mm"), by_ride(), 2, 2, "median") < 3000)
    g = S.islands(r, F.col("slow"), "ride_id", "seq").where("slow").groupBy("ride_id", "island")
    return g.agg(F.min("seq").alias("i0"), F.max("seq").alias("i1"), (F.max("x_mm") - F.min("x_mm")).alias("spread_mm")).where("i1 - i0 >= 5")
