"""Queries of the evaluations: predictors by gyro, cuts on roads, resets at landmarks, the route guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import evaluate as E
from trackloom.operators import outage as O
from trackloom.operators import predict as P
from trackloom.operators import roads as W
from trackloom.plans._register import Register
from trackloom.plans.roads import AT_SQL, road_of
from trackloom.plans.scoring import OUTAGES_SQL, SCORES_SQL, outages
from trackloom.sources.rides import RIDES_SQL, rides
from trackloom.sources.shared import materialize

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query
KEYS = ["ride_id", "target", "i0", "i1"]

GYRO_SQL = SCORES_SQL + """, gy AS (SELECT od.*, r.seq, r.x_mm, r.y_mm, r.step_mm, r.k, i.x0, i.y0, sqrt(pow(i.vx, 2) + pow(i.vy, 2)) AS held, CASE WHEN sqrt(pow(i.vx, 2) + pow(i.vy, 2)) > 100 THEN atan2(i.vy, i.vx) ELSE 0 END + radians(sum((r.k - 50)::DOUBLE) OVER (PARTITION BY od.ride_id, od.target, od.i0, od.i1 ORDER BY r.seq)) AS h
 FROM od JOIN ini i ON i.ride_id = od.ride_id AND i.seq = od.i0 JOIN r ON r.ride_id = od.ride_id AND r.seq BETWEEN od.i0 AND od.i1)
"""


def _drift(p):
    e = F.hypot(F.col("x") - F.col("x_mm"), F.col("y") - F.col("y_mm")) / 1000
    return p.groupBy(*KEYS).agg(F.max_by(e, "seq").alias("drift_m"))


@query("q_heading_predictors", GYRO_SQL + """, en AS (SELECT ride_id, target, i0, i1, any_value(x0) + sum(step_mm * cos(h)) AS ox, any_value(y0) + sum(step_mm * sin(h)) AS oy, any_value(x0) + sum(CASE WHEN seq > i0 THEN held * cos(h) ELSE 0 END) AS fx, any_value(y0) + sum(CASE WHEN seq > i0 THEN held * sin(h) ELSE 0 END) AS fy, arg_max(x_mm, seq) AS tx, arg_max(y_mm, seq) AS ty FROM gy GROUP BY ALL)
SELECT ride_id, target, i0, i1, 'oracle_speed' AS predictor, round(sqrt(pow(ox - tx, 2) + pow(oy - ty, 2)) / 1000, 4) AS drift_m, NULL::DOUBLE AS sigma_m FROM en
UNION ALL SELECT ride_id, target, i0, i1, 'fake_model', round(sqrt(pow(fx - tx, 2) + pow(fy - ty, 2)) / 1000, 4), round(1 + 0.08::DOUBLE * pow(i1 - i0, 1.5), 4) FROM en""")
def heading_predictors(spark, sf_dir):
    """Perfect speed with the gyro's heading, and a wrong model of the right shape: held speed, sigma of 1 m and 0.08 t^1.5."""
    r, o = outages(spark, sf_dir)
    o, r = o.select(*KEYS).distinct(), r.withColumn("turn", F.col("k") - 50)
    init = O.initial_state(r)
    oracle = _drift(E.by_gyro(o, r, init, "step_mm", "turn")).select(*KEYS, F.lit("oracle_speed").alias("predictor"), F.round("drift_m", 4).alias("drift_m"), F.lit(None).cast("double").alias("sigma_m"))
    fake = _drift(E.by_gyro(o, r, init, "held", "turn", from_next=True))
    return oracle.unionByName(fake.select(*KEYS, F.lit("fake_model").alias("predictor"), F.round("drift_m", 4).alias("drift_m"), F.round(1 + 0.08 * F.pow((F.col("i1") - F.col("i0")).cast("double"), F.lit(1.5)), 4).alias("sigma_m")))


@query("q_error_curves", SCORES_SQL + "SELECT er.ride_id, target, i0, i1, predictor, er.seq - i0 AS n, r.d_mm - a.d_mm AS along_mm, round(e, 4) AS err_m FROM er JOIN r ON r.ride_id = er.ride_id AND r.seq = er.seq JOIN r a ON a.ride_id = er.ride_id AND a.seq = er.i0 WHERE (er.seq - i0) % 10 = 0")
def error_curves(spark, sf_dir):
    """The error of each prediction against the distance since the cut, at every tenth row."""
    r, o = outages(spark, sf_dir)
    p = P.predict_closed(o.select(*KEYS).distinct(), r, O.initial_state(r)).where((F.col("seq") - F.col("i0")) % 10 == 0)
    p = p.join(r.select("ride_id", "seq", "d_mm"), ["ride_id", "seq"]).join(r.select("ride_id", F.col("seq").alias("i0"), F.col("d_mm").alias("d0")), ["ride_id", "i0"])
    return p.select(*KEYS, "predictor", (F.col("seq") - F.col("i0")).alias("n"), (F.col("d_mm") - F.col("d0")).alias("along_mm"), F.round(F.sqrt(F.pow(F.col("x") - F.col("x_mm"), 2) + F.pow(F.col("y") - F.col("y_mm"), 2)) / 1000, 4).alias("err_m"))


@query("q_free_heading", """, t0 AS (SELECT ride_id, seq, x_mm, y_mm, d_mm - first_value(d_mm) OVER w AS c, first_value(x_mm) OVER w AS ox, first_value(y_mm) OVER w AS oy, (radians((k - 50)::DOUBLE) + 0.01::DOUBLE) * CASE WHEN ride_id % 2 = 0 THEN 1 ELSE -1 END AS w,
 atan2(coalesce((lead(y_mm) OVER w - lag(y_mm) OVER w) / 2, lead(y_mm) OVER w - y_mm, y_mm - lag(y_mm) OVER w, 0), coalesce((lead(x_mm) OVER w - lag(x_mm) OVER w) / 2, lead(x_mm) OVER w - x_mm, x_mm - lag(x_mm) OVER w, 0)) AS hd FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
t1 AS (SELECT *, coalesce(c - lag(c) OVER (PARTITION BY ride_id ORDER BY seq), 0) AS v FROM t0),
g AS (SELECT ride_id, coalesce(arg_min(x_mm, seq) FILTER (WHERE c >= 15000), arg_max(x_mm, seq)) - any_value(ox) AS dx, coalesce(arg_min(y_mm, seq) FILTER (WHERE c >= 15000), arg_max(y_mm, seq)) - any_value(oy) AS dy, CASE WHEN count(*) FILTER (WHERE v < 1500) > 5 THEN quantile_cont(w, 0.5) FILTER (WHERE v < 1500) END AS b, arg_max(x_mm, seq) AS ex, arg_max(y_mm, seq) AS ey FROM t1 GROUP BY ride_id),
tr AS (SELECT ride_id, atan2(dy, dx) AS psi0, ex, ey, bias, sign FROM (SELECT *, unnest([0.0::DOUBLE, b]) AS bias FROM g), (SELECT unnest([1, -1]) AS sign) WHERE bias IS NOT NULL),
x AS (SELECT t1.*, tr.*, psi0 + sign * sum(w - bias) OVER (PARTITION BY t1.ride_id, bias, sign ORDER BY seq) AS psi FROM t1 JOIN tr ON t1.ride_id = tr.ride_id),
ea AS (SELECT ride_id, bias, sign, quantile_cont(abs(atan2(sin(psi - hd), cos(psi - hd))), 0.5) FILTER (WHERE c > 10000) AS he, sqrt(pow(any_value(ox) + sum(v * cos(psi)) - any_value(ex), 2) + pow(any_value(oy) + sum(v * sin(psi)) - any_value(ey), 2)) AS err FROM x GROUP BY ride_id, bias, sign),
ob AS (SELECT ride_id, bias, arg_min({'sign': sign, 'he': he, 'err': err}, (round(he, 9), -sign)) AS m FROM ea WHERE he IS NOT NULL GROUP BY ride_id, bias),
bb AS (SELECT ride_id, arg_min({'bias': bias, 'm': m}, (round(m.err, 3), abs(bias))) AS m FROM ob GROUP BY ride_id)
SELECT ride_id, round(degrees(m.bias), 4) AS bias_deg, m.m.sign AS sign, round(degrees(m.m.he), 4) AS heading_err_deg, round(m.m.err / 1000, 3) AS end_err_m FROM bb""")
def free_heading(spark, sf_dir):
    """Free dead reckoning in its best case: a gyro with a bias, mounted upside down on every second ride."""
    r = rides(spark, sf_dir)
    w = (F.radians((F.col("k") - 50).cast("double")) + 0.01) * F.when(F.col("ride_id") % 2 == 0, 1).otherwise(-1)
    b = E.best_case_heading(r.select("ride_id", "seq", "x_mm", "y_mm", "d_mm", "step_mm", w.alias("w")), least_still=5, still_mm=1500.0)
    return b.select("ride_id", F.round(F.degrees("bias"), 4).alias("bias_deg"), "sign", F.round(F.degrees("heading_err"), 4).alias("heading_err_deg"), F.round(F.col("end_err_mm") / 1000, 3).alias("end_err_m"))


@query("q_walk_replay", """, cu AS (SELECT ride_id, unnest([20, 40])::BIGINT AS cut FROM (SELECT ride_id, max(seq) AS m FROM r GROUP BY ride_id)),
sp AS (SELECT cu.ride_id, cut, list_sort(list(step_mm) FILTER (WHERE seq BETWEEN cut - 9 AND cut))[count(*) FILTER (WHERE seq BETWEEN cut - 9 AND cut) // 2 + 1] AS held, max(step_mm) FILTER (WHERE seq = cut) AS last, max(x_mm) FILTER (WHERE seq = cut) AS x0, max(y_mm) FILTER (WHERE seq = cut) AS y0, max(head_deg) FILTER (WHERE seq = cut) AS h0 FROM cu JOIN r USING (ride_id) GROUP BY cu.ride_id, cut),
va AS (SELECT ride_id, cut, x0, y0, h0, speed, CASE WHEN speed = 'held' THEN held ELSE last END AS v, sign FROM sp, (SELECT unnest(['held', 'last']) AS speed), (SELECT unnest([1, -1]) AS sign) WHERE x0 IS NOT NULL),
wk AS (SELECT va.*, r.seq, r.x_mm, r.y_mm, radians(h0 + sign * (r.head_deg - h0)) AS h FROM va JOIN r ON r.ride_id = va.ride_id AND r.seq > cut AND r.seq <= cut + 20)
SELECT ride_id, cut, speed, sign, count(*) AS n, round(sqrt(pow(any_value(x0) + sum(v * cos(h)) - arg_max(x_mm, seq), 2) + pow(any_value(y0) + sum(v * sin(h)) - arg_max(y_mm, seq), 2)) / 1000, 4) AS err_m FROM wk GROUP BY ride_id, cut, speed, sign""")
def walk_replay(spark, sf_dir):
    """Cuts of twenty seconds: held speed (upper median of ten) against that of the last fix, with both signs of the gyro."""
    r = rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm", "step_mm", "head_deg")
    cuts = r.select("ride_id").distinct().withColumn("cut", F.explode(F.array(F.lit(20).cast("long"), F.lit(40).cast("long"))))
    at = cuts.join(r, (r["ride_id"] == cuts["ride_id"]) & r["seq"].between(cuts["cut"] - 9, cuts["cut"] + 20)).select(cuts["ride_id"], "cut", "seq", "x_mm", "y_mm", "step_mm", "head_deg")
    own = lambda c: F.max(F.when(F.col("seq") == F.col("cut"), F.col(c)))
    before = F.sort_array(F.collect_list(F.when(F.col("seq") <= F.col("cut"), F.col("step_mm"))))
    sp = at.groupBy("ride_id", "cut").agg(before.alias("b"), own("step_mm").alias("last"), own("x_mm").alias("x0"), own("y_mm").alias("y0"), own("head_deg").alias("h0")).where("x0 is not null")
    sp = sp.withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("speed"), F.lit(s).alias("sign"), v.alias("v")) for n, v in (("held", F.get("b", F.floor(F.size("b") / 2).cast("int"))), ("last", F.col("last"))) for s in (1, -1)])))
    h = F.radians(F.col("h0") + F.col("v.sign") * (F.col("head_deg") - F.col("h0")))
    w = at.where("seq > cut").join(sp.select("ride_id", "cut", "x0", "y0", "h0", "v"), ["ride_id", "cut"]).withColumn("h", h)
    ex = F.first("x0") + F.sum(F.col("v.v") * F.cos("h")) - F.max_by("x_mm", "seq")
    ey = F.first("y0") + F.sum(F.col("v.v") * F.sin("h")) - F.max_by("y_mm", "seq")
    return w.groupBy("ride_id", "cut", F.col("v.speed").alias("speed"), F.col("v.sign").alias("sign")).agg(F.count(F.lit(1)).alias("n"), F.round(F.hypot(ex, ey) / 1000, 4).alias("err_m"))


#: Speed of the stand-in model: k tenths of a metre a second.
VARIANTS_SQL = OUTAGES_SQL + """, od AS (SELECT DISTINCT o.ride_id, target, i0, i1 FROM o JOIN r a ON a.ride_id = o.ride_id AND a.seq = i0 JOIN r b ON b.ride_id = o.ride_id AND b.seq = i1 WHERE b.d_mm - a.d_mm >= 1389 * (i1 - i0)),
mo AS (SELECT od.*, coalesce(sum(r.k * 100) FILTER (WHERE r.seq >= i0 - 20 AND r.seq < i0), 0) AS ai, sum(r.step_mm) FILTER (WHERE r.seq >= i0 - 20 AND r.seq < i0) AS gps, sum(r.k * 100) FILTER (WHERE r.seq > i0 AND r.seq <= i1) AS went, any_value(r.d_mm) FILTER (WHERE r.seq = i0) AS d0, any_value(r.d_mm) FILTER (WHERE r.seq = i1) AS d1 FROM od JOIN r ON r.ride_id = od.ride_id AND r.seq BETWEEN i0 - 20 AND i1 GROUP BY ALL),
va AS (SELECT mo.*, v AS variant, CAST(CASE v WHEN 'frozen' THEN d0 WHEN 'perfect_road' THEN d1 WHEN 'model_road' THEN d0 + went ELSE round(d0 + went * CASE WHEN ai > 50000 THEN least(greatest(gps::DOUBLE / ai, 0.8), 1.25) ELSE 1 END) END AS BIGINT) AS s FROM mo, (SELECT unnest(['frozen', 'model_road', 'calibrated_road', 'perfect_road']) AS v)),
g AS (SELECT * FROM va), """


@query("q_drive_evaluation", VARIANTS_SQL + AT_SQL + """, dr AS (SELECT pl.target, pl.variant, sqrt(pow(x - e.x_mm, 2) + pow(y - e.y_mm, 2)) / (d1 - d0) * 100 AS pct FROM pl JOIN r e ON e.ride_id = pl.ride_id AND e.seq = pl.i1)
, gy AS (SELECT mo.ride_id, target, i0, i1, any_value(d1 - d0) AS went, sum(r.k * 100 * cos(radians(r.head_deg + 0.1::DOUBLE * (r.seq - i0)))) AS dx, sum(r.k * 100 * sin(radians(r.head_deg + 0.1::DOUBLE * (r.seq - i0)))) AS dy FROM mo JOIN r ON r.ride_id = mo.ride_id AND r.seq > i0 AND r.seq <= i1 GROUP BY ALL)
SELECT target, variant, count(*) AS n, round(quantile_cont(pct, 0.5), 4) AS median_pct, round(avg(CASE WHEN pct < 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_rate FROM (SELECT target, variant, pct FROM dr UNION ALL
 SELECT gy.target, 'model_gyro', sqrt(pow(a.x_mm + dx - b.x_mm, 2) + pow(a.y_mm + dy - b.y_mm, 2)) / went * 100 FROM gy JOIN r a ON a.ride_id = gy.ride_id AND a.seq = i0 JOIN r b ON b.ride_id = gy.ride_id AND b.seq = i1) GROUP BY target, variant""")
def drive_evaluation(spark, sf_dir):
    """Outages of moving rides: frozen, the model's speed along a heading that drifts by a degree in ten seconds, and on the road with the model's
    speed, the calibrated one and the true one."""
    r, o = outages(spark, sf_dir)
    o = O.with_distance(O.moving_only(o.select(*KEYS).distinct(), r, 1389), r)
    s = E.calibrated(o, r, F.col("step_mm"), F.col("k") * 100)
    went = s.withColumn("seq", F.explode(F.sequence(F.col("i0") + 1, F.col("i1")))).join(r.select("ride_id", "seq", "k"), ["ride_id", "seq"]).groupBy(*s.columns).agg(F.sum(F.col("k") * 100).alias("went"))
    places = {"frozen": F.col("d0"), "model_road": F.col("d0") + F.col("went"), "calibrated_road": F.round(F.col("d0") + F.col("went") * F.col("scale")).cast("long"), "perfect_road": F.col("d1")}
    v = went.withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("s")) for n, c in places.items()]))).select(*KEYS, "d0", "d1", "v.*")
    at = W.at(v.select("ride_id", "s").distinct(), road_of(r))
    end = r.select("ride_id", F.col("seq").alias("i1"), "x_mm", "y_mm")
    off = lambda x, y: F.hypot(x - F.col("x_mm"), y - F.col("y_mm")) / (F.col("d1") - F.col("d0")) * 100
    d = v.join(at, ["ride_id", "s"]).join(end, ["ride_id", "i1"]).select("target", "variant", off(F.col("x"), F.col("y")).alias("pct"))
    h = F.radians(F.col("head_deg") + F.lit(0.1) * (F.col("seq") - F.col("i0")))
    steps = s.select(*KEYS, "d0", "d1", F.explode(F.sequence(F.col("i0") + 1, F.col("i1"))).alias("seq")).join(r.select("ride_id", "seq", "k", "head_deg"), ["ride_id", "seq"])
    free = steps.groupBy(*KEYS, "d0", "d1").agg(F.sum(F.col("k") * 100 * F.cos(h)).alias("dx"), F.sum(F.col("k") * 100 * F.sin(h)).alias("dy"))
    start = r.select("ride_id", F.col("seq").alias("i0"), F.col("x_mm").alias("ax"), F.col("y_mm").alias("ay"))
    free = free.join(start, ["ride_id", "i0"]).join(end, ["ride_id", "i1"]).select("target", F.lit("model_gyro").alias("variant"), off(F.col("ax") + F.col("dx"), F.col("ay") + F.col("dy")).alias("pct"))
    d = d.unionByName(free)
    return d.groupBy("target", "variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("pct", 0.5), 4).alias("median_pct"), F.round(F.avg((F.col("pct") < 10).cast("double")), 6).alias("pass_rate"))


@query("q_cut_evaluation", """, cu AS (SELECT ride_id, 20::BIGINT AS i0, 50::BIGINT AS i1 FROM r GROUP BY ride_id HAVING max(seq) >= 50),
rr AS (SELECT r.*, cu.i0, cu.i1 FROM r JOIN cu USING (ride_id)),
a AS (SELECT * FROM rr WHERE seq = i0), e AS (SELECT * FROM rr WHERE seq = i1),
sp AS (SELECT ride_id, speed, seq, CASE WHEN speed = 'model' THEN k * 100 ELSE step_mm END AS v, radians(head_deg::DOUBLE) AS h FROM rr, (SELECT unnest(['model', 'perfect']) AS speed) WHERE seq > i0 AND seq <= i1),
fr AS (SELECT ride_id, speed, sum(v * cos(h)) AS fx, sum(v * sin(h)) AS fy, CAST(sum(v) AS BIGINT) AS went FROM sp GROUP BY ride_id, speed),
ps AS (SELECT ride_id, seq, x_mm + ((k * 74) % 21 - 10) * 100 AS x, y_mm + ((k * 159) % 21 - 10) * 100 AS y FROM r),
pc AS (SELECT *, coalesce(sum(CAST(round(l) AS BIGINT)) OVER (PARTITION BY ride_id ORDER BY seq), 0) AS s FROM (SELECT *, coalesce(sqrt((pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2))::DOUBLE), 0) AS l FROM ps WINDOW w AS (PARTITION BY ride_id ORDER BY seq))),
s0 AS (SELECT a.ride_id, arg_min(pc.s, ((pc.x - a.x_mm) * (pc.x - a.x_mm) + (pc.y - a.y_mm) * (pc.y - a.y_mm), pc.seq)) AS s FROM a JOIN pc USING (ride_id) GROUP BY a.ride_id),
g AS (SELECT fr.ride_id, speed, CAST(s0.s + went AS BIGINT) AS s FROM fr JOIN s0 USING (ride_id)),
lo AS (SELECT g.*, pc.s AS t0, pc.x AS x0, pc.y AS y0 FROM g ASOF LEFT JOIN pc ON g.ride_id = pc.ride_id AND g.s >= pc.s),
hi AS (SELECT lo.*, pc.s AS t1, pc.x AS x1, pc.y AS y1 FROM lo ASOF LEFT JOIN pc ON lo.ride_id = pc.ride_id AND lo.s <= pc.s),
le AS (SELECT ride_id, speed, CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL THEN x0 WHEN t0 = t1 THEN x0 ELSE x0 + (x1 - x0) * ((s - t0)::DOUBLE / (t1 - t0)) END AS x, CASE WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL THEN y0 WHEN t0 = t1 THEN y0 ELSE y0 + (y1 - y0) * ((s - t0)::DOUBLE / (t1 - t0)) END AS y FROM hi),
al AS (SELECT fr.ride_id, 'none' AS state, speed, a.x_mm + fx AS x, a.y_mm + fy AS y FROM fr JOIN a USING (ride_id) UNION ALL SELECT ride_id, 'learned', speed, x, y FROM le)
SELECT al.ride_id, state, speed, round(100 * sqrt(pow(x - e.x_mm, 2) + pow(y - e.y_mm, 2)) / (e.d_mm - a.d_mm), 4) AS drift_pct FROM al JOIN a ON a.ride_id = al.ride_id JOIN e ON e.ride_id = al.ride_id""")
def cut_evaluation(spark, sf_dir):
    """Satellites cut from 20 to 50 s: without a map, and on a road learned from another pass, with the model's speed and the true one."""
    from pyspark.sql import Window

    r = materialize(rides(spark, sf_dir), "rides")
    long_ones = r.groupBy("ride_id").agg(F.max("seq").alias("m")).where("m >= 50").select("ride_id")
    rr = r.join(long_ones, "ride_id", "left_semi")
    a, e = rr.where("seq = 20"), rr.where("seq = 50")
    speeds = F.explode(F.array(F.struct(F.lit("model").alias("speed"), (F.col("k") * 100).alias("v")), F.struct(F.lit("perfect").alias("speed"), F.col("step_mm").alias("v")))).alias("p")
    went = rr.where("seq > 20 and seq <= 50").select("ride_id", F.radians(F.col("head_deg").cast("double")).alias("h"), speeds).select("ride_id", "h", "p.*")
    went = went.groupBy("ride_id", "speed").agg(F.sum(F.col("v") * F.cos("h")).alias("fx"), F.sum(F.col("v") * F.sin("h")).alias("fy"), F.sum("v").alias("went"))
    start = a.select("ride_id", F.col("x_mm").alias("ax"), F.col("y_mm").alias("ay"), F.col("d_mm").alias("ad"))
    free = went.join(start, "ride_id").select("ride_id", F.lit("none").alias("state"), "speed", (F.col("ax") + F.col("fx")).alias("x"), (F.col("ay") + F.col("fy")).alias("y"))
    w = Window.partitionBy("ride_id").orderBy("seq")
    off = lambda n: ((F.col("k") * n) % 21 - 10) * 100
    ps = r.select("ride_id", "seq", (F.col("x_mm") + off(74)).alias("x"), (F.col("y_mm") + off(159)).alias("y"))
    ps = ps.withColumn("l", F.round(F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))).cast("long")).withColumn("s", F.sum("l").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d2 = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
    s0 = ps.join(start, "ride_id").groupBy("ride_id").agg(F.min(F.struct(d2.alias("d"), "seq", "s")).alias("m")).select("ride_id", F.col("m.s").alias("s0"))
    g = went.join(s0, "ride_id").select("ride_id", "speed", (F.col("s0") + F.col("went")).alias("s"))
    on = g.join(W.at(g.select("ride_id", "s").distinct(), ps), ["ride_id", "s"]).select("ride_id", F.lit("learned").alias("state"), "speed", "x", "y")
    end = e.select("ride_id", F.col("x_mm").alias("ex"), F.col("y_mm").alias("ey"), F.col("d_mm").alias("ed"))
    found = free.unionByName(on).join(start, "ride_id").join(end, "ride_id")
    return found.select("ride_id", "state", "speed", F.round(100 * F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) / (F.col("ed") - F.col("ad")), 4).alias("drift_pct"))


@query("q_landmark_resets")
def landmark_resets(spark, sf_dir):
    """The whole system along a road: the model's speed, and a reset at every landmark hit that a mark within 80 m explains."""
    r = materialize(rides(spark, sf_dir), "rides")
    marks = r.where("seq % 10 = 0").select("ride_id", F.col("seq").alias("i"), (F.col("d_mm") / 1000).alias("place_m"))
    track = r.select("ride_id", "seq", (F.col("k") / 10).alias("v"), F.col("hit").alias("seen"), (F.col("d_mm") / 1000).alias("place_m"))
    return E.with_resets(track, marks, 80.0, 2000.0).select("ride_id", "seq", F.round("s", 4).alias("s"))


SQL["q_landmark_resets"] = f"""WITH RECURSIVE {RIDES_SQL}, mk AS MATERIALIZED (SELECT ride_id, seq AS i, d_mm / 1000.0::DOUBLE AS place FROM r WHERE seq % 10 = 0), st AS MATERIALIZED (SELECT ride_id, seq, k / 10.0::DOUBLE AS v, hit FROM r),
f(ride_id, seq, s, nxt) AS (
  SELECT ride_id, -1::BIGINT, 0.0::DOUBLE, 0::BIGINT FROM r GROUP BY ride_id
  UNION ALL
  SELECT ride_id, seq, coalesce(CASE WHEN hit THEN m.place END, arc), coalesce(CASE WHEN hit THEN m.i + 1 END, nxt) FROM (
    SELECT f.ride_id, st.seq, any_value(st.hit) AS hit, any_value(f.s + st.v) AS arc, any_value(f.nxt) AS nxt, arg_min({{'i': mk.i, 'place': mk.place}}, (abs(mk.place - (f.s + st.v)), mk.i)) FILTER (WHERE mk.i IS NOT NULL) AS m
    FROM f JOIN st ON st.ride_id = f.ride_id AND st.seq = f.seq + 1 LEFT JOIN mk ON mk.ride_id = f.ride_id AND mk.i >= f.nxt AND abs(mk.place - (f.s + st.v)) <= 80 GROUP BY f.ride_id, st.seq))
SELECT ride_id, seq, round(s, 4) AS s FROM f WHERE seq >= 0"""


GUARD_SQL = """, tk AS (SELECT ride_id, seq, d_mm::DOUBLE AS s, head_deg::DOUBLE AS deg FROM r), rt AS (SELECT ride_id, d_mm::DOUBLE - 30000 AS s, head_deg::DOUBLE AS deg FROM r),
t1 AS (SELECT *, 15000 + 0.08::DOUBLE * s AS tol, 2 * (15000 + 0.08::DOUBLE * s) + 20000 AS win FROM tk),
t2 AS (SELECT t1.*, t1.s - win AS b, b.deg AS d0 FROM t1 ASOF JOIN tk b ON t1.ride_id = b.ride_id AND t1.s - win <= b.s WHERE t1.s >= win),
ln AS (SELECT ride_id, max(s) AS len FROM rt GROUP BY ride_id),
t3 AS (SELECT t2.*, o, round(-1 + o * 0.1::DOUBLE, 1) AS sh, len FROM t2 JOIN ln USING (ride_id), (SELECT unnest(range(21)) AS o)),
t4 AS (SELECT ride_id, seq, deg, d0, o, e, least(greatest(s + sh * tol - e * win, 0), len) AS s FROM t3, (SELECT unnest([0, 1]) AS e)),
lo AS (SELECT t4.*, rt.s AS t0, rt.deg AS v0 FROM t4 ASOF LEFT JOIN rt ON t4.ride_id = rt.ride_id AND t4.s >= rt.s),
hi AS (SELECT lo.*, rt.s AS t1, rt.deg AS v1 FROM lo ASOF LEFT JOIN rt ON lo.ride_id = rt.ride_id AND lo.s <= rt.s),
va AS (SELECT *, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (s - t0) / (t1 - t0) END AS v FROM hi),
mm AS (SELECT ride_id, seq, o, any_value(deg) - any_value(d0) - sum(CASE WHEN e = 0 THEN v ELSE -v END) AS d FROM va GROUP BY ride_id, seq, o),
mi AS (SELECT ride_id, seq, min(abs(degrees(atan2(sin(radians(d)), cos(radians(d)))))) AS m FROM mm GROUP BY ride_id, seq),
ms AS (SELECT tk.ride_id, tk.seq, coalesce(m, 0) AS mismatch FROM tk LEFT JOIN mi USING (ride_id, seq))
"""


@query("q_route_guard_mismatch", GUARD_SQL + "SELECT ride_id, seq, round(mismatch, 4) AS mismatch FROM ms")
def route_guard_mismatch(spark, sf_dir):
    """How far a ride's turn over the last stretch is from what its route, thirty metres on, explains."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "d_mm", "head_deg"), "rides")
    track = r.select("ride_id", "seq", F.col("d_mm").alias("s"), F.col("head_deg").cast("double").alias("deg"))
    m = E.mismatch(track, track.select("ride_id", (F.col("s") - 30000).alias("s"), "deg"), "ride_id", "seq", 15000.0, 0.08, 20000.0)
    return m.select("ride_id", "seq", F.round("mismatch", 4).alias("mismatch"))


@query("q_route_guard", GUARD_SQL + """, ru AS (SELECT *, sum(n) OVER (PARTITION BY ride_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN lag(mismatch > 60) OVER (PARTITION BY ride_id ORDER BY seq) IS NOT DISTINCT FROM (mismatch > 60) THEN 0 ELSE 1 END AS n FROM ms)),
he AS (SELECT *, min(seq) OVER (PARTITION BY ride_id, run) AS began FROM ru)
SELECT ride_id, min(seq) FILTER (WHERE mismatch > 60 AND seq - began >= 2) AS seq FROM he GROUP BY ride_id""")
def route_guard(spark, sf_dir):
    """The first second at which more than 60 degrees have been unexplained for two seconds."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "d_mm", "head_deg"), "rides")
    track = r.select("ride_id", "seq", F.col("d_mm").alias("s"), F.col("head_deg").cast("double").alias("deg"))
    return E.route_guard(track, track.select("ride_id", (F.col("s") - 30000).alias("s"), "deg"))
