"""Queries of frames, features, tags, routes on the grid and other column operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import geo as G
from trackloom.functions import text as T
from trackloom.operators import features as X
from trackloom.operators import fold as D
from trackloom.operators import graph as H
from trackloom.operators import hmm
from trackloom.operators import network as N
from trackloom.operators import roads as W
from trackloom.operators import series as S
from trackloom.operators.places import arrivals
from trackloom.plans._register import Register
from trackloom.plans.folds_sql import near, stepwise
from trackloom.plans.graph import GRID_SQL, whole_grid
from trackloom.plans.roads import AT_SQL, road_of
from trackloom.sources import sinks as K
from trackloom.sources.files import SKIPPED_SERVICE, way_class
from trackloom.sources.rides import RIDES_SQL, by_ride, rides, table
from trackloom.sources.shared import materialize

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query


@query("q_rotation_frame", """, a AS (SELECT event_id, radians(k * 3.6::DOUBLE) AS az, radians((k % 30) - 15::DOUBLE) AS pi_, radians((seq % 40) - 20::DOUBLE) AS ro, dx_mm::DOUBLE AS x, dy_mm::DOUBLE AS y, 100.0::DOUBLE AS z FROM r)
SELECT event_id, round((cos(az) * cos(ro) - sin(az) * sin(pi_) * sin(ro)) * x - sin(az) * cos(pi_) * y + (cos(az) * sin(ro) + sin(az) * sin(pi_) * cos(ro)) * z, 6) AS e,
 round((sin(az) * cos(ro) + cos(az) * sin(pi_) * sin(ro)) * x + cos(az) * cos(pi_) * y + (sin(az) * sin(ro) - cos(az) * sin(pi_) * cos(ro)) * z, 6) AS n,
 round(-cos(pi_) * sin(ro) * x + sin(pi_) * y + cos(pi_) * cos(ro) * z, 6) AS u, round(cos(az) * x - sin(az) * y, 6) AS yawed_x, round(sin(az) * x + cos(az) * y, 6) AS yawed_y FROM a""")
def rotation_frame(spark, sf_dir):
    """Vectors turned by azimuth, pitch and roll, and by the yaw alone."""
    v = [F.col("dx_mm").cast("double"), F.col("dy_mm").cast("double"), F.lit(100.0)]
    yaw = F.radians(F.col("k") * 3.6)
    r = G.rotate(G.rotation_from_angles(yaw, F.radians((F.col("k") % 30 - 15).cast("double")), F.radians((F.col("seq") % 40 - 20).cast("double"))), v)
    yawed = G.rotate(G.rotation_from_angles(yaw, F.lit(0.0), F.lit(0.0)), v)
    return rides(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(n) for n, c in zip(("e", "n", "u", "yawed_x", "yawed_y"), [*r, *yawed[:2]])])


LEVEL_SQL = """, a AS (SELECT ride_id, seq, dx_mm / 1000.0::DOUBLE AS ax, dy_mm / 1000.0::DOUBLE AS ay, 9.80665::DOUBLE AS az FROM r),
m AS (SELECT *, frame, CASE WHEN frame = 'trailing' THEN avg(ax) OVER t ELSE avg(ax) OVER c END AS mx, CASE WHEN frame = 'trailing' THEN avg(ay) OVER t ELSE avg(ay) OVER c END AS my, CASE WHEN frame = 'trailing' THEN avg(az) OVER t ELSE avg(az) OVER c END AS mz FROM a, (SELECT unnest(['trailing', 'centred']) AS frame)
 WINDOW t AS (PARTITION BY ride_id, frame ORDER BY seq ROWS BETWEEN 80 PRECEDING AND CURRENT ROW), c AS (PARTITION BY ride_id, frame ORDER BY seq ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING)),
d AS (SELECT *, mx / n AS dx, my / n AS dy, mz / n AS dz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS n FROM m)),
e AS (SELECT *, CASE WHEN abs(dx) > 0.9 THEN dz ELSE 0 END AS e1, CASE WHEN abs(dx) > 0.9 THEN 0 ELSE -dz END AS e2, CASE WHEN abs(dx) > 0.9 THEN -dx ELSE dy END AS e3 FROM d),
f AS (SELECT *, e1 / q AS ex, e2 / q AS ey, e3 / q AS ez FROM (SELECT *, sqrt(e1 * e1 + e2 * e2 + e3 * e3) AS q FROM e))
SELECT ride_id, seq, frame, round(ex * ax + ey * ay + ez * az, 6) AS east, round((dy * ez - dz * ey) * ax + (dz * ex - dx * ez) * ay + (dx * ey - dy * ex) * az, 6) AS north, round(dx * ax + dy * ay + dz * az, 6) AS down FROM f"""


@query("q_level_frame", LEVEL_SQL)
def level_frame(spark, sf_dir):
    """Accelerations in the level frame of the mean over 81 rows: trailing, as on the phone, and centred, as offline."""
    r = rides(spark, sf_dir).select("ride_id", "seq", (F.col("dx_mm") / 1000).alias("ax"), (F.col("dy_mm") / 1000).alias("ay"), F.lit(X.GRAVITY).alias("az"))
    w = by_ride()
    frames = []
    for name, before, after in (("trailing", 80, 0), ("centred", 40, 40)):
        mean = [S.rolling(F.col(c), w, before, after, "mean") for c in ("ax", "ay", "az")]
        m = r.select("*", *[c.alias(n) for c, n in zip(mean, ("mx", "my", "mz"))])
        level = X.tilt_columns(F.col("mx"), F.col("my"), F.col("mz"), [F.col("ax"), F.col("ay"), F.col("az")])
        frames.append(m.select("ride_id", "seq", F.lit(name).alias("frame"), *[F.round(c, 6).alias(n) for c, n in zip(level, ("east", "north", "down"))]))
    return frames[0].unionByName(frames[1])


@query("q_yaw_free", """, a AS (SELECT event_id, ride_id, seq, dx_mm / 1000.0::DOUBLE AS ax, dy_mm / 1000.0::DOUBLE AS ay, 9.8::DOUBLE + (k - 50) / 100.0::DOUBLE AS az, k / 100.0::DOUBLE AS gx, value / 100 AS gy, (k - 50) / 50.0::DOUBLE AS gz FROM r),
b AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS nm FROM a)
SELECT event_id, round(sqrt(ax * ax + ay * ay), 6) AS a_h, az AS a_v, round(sqrt(gx * gx + gy * gy), 6) AS w_h, gz AS w_z, round(nm, 6) AS a, round((nm - coalesce(lag(nm) OVER (PARTITION BY ride_id ORDER BY seq), nm)) * 10, 5) AS jerk,
 round((gx * ax + gy * ay + gz * az) / nm, 6) AS yaw_rate FROM b""")
def yaw_free(spark, sf_dir):
    """The six channels that don't depend on the mount's heading, and the rate about the measured vertical."""
    r = rides(spark, sf_dir).select("event_id", "ride_id", "seq", (F.col("dx_mm") / 1000).alias("ax"), (F.col("dy_mm") / 1000).alias("ay"), (F.lit(9.8) + (F.col("k") - 50) / 100).alias("az"), (F.col("k") / 100).alias("gx"), (F.col("value") / 100).alias("gy"), ((F.col("k") - 50) / 50).alias("gz"))
    a, g = [F.col(c) for c in ("ax", "ay", "az")], [F.col(c) for c in ("gx", "gy", "gz")]
    r = r.withColumn("before", F.lag(F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])).over(by_ride()))
    c = G.yaw_free_channels(*a, *g, F.col("before"), 10.0)
    return r.select("event_id", F.round(c["a_h"], 6).alias("a_h"), c["a_v"].alias("a_v"), F.round(c["w_h"], 6).alias("w_h"), c["w_z"].alias("w_z"), F.round(c["a"], 6).alias("a"), F.round(c["jerk"], 5).alias("jerk"), F.round(X.level(*g, *a)["a_v"], 6).alias("yaw_rate"))


KEEP = math.exp(-1 / 4)


@query("q_gravity_average", stepwise("SELECT ride_id, seq AS n, dx_mm / 1000.0::DOUBLE AS ax, dy_mm / 1000.0::DOUBLE AS ay FROM r", {"gx": "0.0::DOUBLE", "gy": "0.0::DOUBLE", "gz": f"{X.GRAVITY}::DOUBLE"}, [f"{KEEP!r}::DOUBLE * gx_ + {1 - KEEP!r}::DOUBLE * ax AS gx, {KEEP!r}::DOUBLE * gy_ + {1 - KEEP!r}::DOUBLE * ay AS gy, {KEEP!r}::DOUBLE * gz_ + {1 - KEEP!r}::DOUBLE * 9.0 AS gz"], "SELECT ride_id, n AS seq, round(gx, 9) AS gx, round(gy, 9) AS gy, round(gz, 9) AS gz FROM f WHERE n >= 0"), ctes=False)
def gravity_average(spark, sf_dir):
    """Exponential gravity over four seconds."""

    def step(f, row):
        g = f.push(np.array([row["dx_mm"] / 1000, row["dy_mm"] / 1000, 9.0]))
        return {"seq": row["seq"], "gx": float(g[0]), "gy": float(g[1]), "gz": float(g[2])}

    r = rides(spark, sf_dir).select("ride_id", "seq", "dx_mm", "dy_mm")
    d = D.fold(r, "ride_id", ["seq"], lambda: X.Ema(4.0, 1.0), step, "ride_id long, seq long, gx double, gy double, gz double")
    return d.select("ride_id", "seq", *[F.round(c, 9).alias(c) for c in ("gx", "gy", "gz")])


@query("q_detector_channels", """, a AS (SELECT ride_id, seq // 20 AS win, seq, dx_mm / 1000.0::DOUBLE AS x, dy_mm / 1000.0::DOUBLE AS y, (k - 50)::DOUBLE AS z, sqrt(pow(dx_mm / 1000.0::DOUBLE, 2) + pow(dy_mm / 1000.0::DOUBLE, 2) + pow(k - 50, 2)) AS mag, sqrt(pow(dx_mm / 1000.0::DOUBLE, 2) + pow(dy_mm / 1000.0::DOUBLE, 2)) AS hor FROM r),
m AS (SELECT ride_id, win, quantile_cont(mag, 0.5) AS mm, quantile_cont(z, 0.5) AS mz, quantile_cont(hor, 0.5) AS mh FROM a GROUP BY ride_id, win HAVING count(*) = 20)
SELECT ride_id, seq, round(mag - mm, 6) AS size, round(coalesce(mag - lag(mag) OVER (PARTITION BY ride_id, win ORDER BY seq), 0), 6) AS step, round(z - mz, 6) AS vertical, round(hor - mh, 6) AS horizontal FROM a JOIN m USING (ride_id, win)""")
def detector_channels(spark, sf_dir):
    """Channels of full windows of 20 rows: all of it windows, nothing in Python."""
    x, y, z = F.col("dx_mm") / 1000, F.col("dy_mm") / 1000, (F.col("k") - 50).cast("double")
    r = rides(spark, sf_dir).select("ride_id", "seq", F.floor(F.col("seq") / 20).alias("win"), z.alias("z"), F.sqrt(F.pow(x, 2) + F.pow(y, 2) + F.pow(z, 2)).alias("mag"), F.sqrt(F.pow(x, 2) + F.pow(y, 2)).alias("hor"))
    whole, w = Window.partitionBy("ride_id", "win"), Window.partitionBy("ride_id", "win").orderBy("seq")
    centred = lambda c: F.round(F.col(c) - F.percentile(c, 0.5).over(whole), 6)
    step = F.round(F.coalesce(F.col("mag") - F.lag("mag").over(w), F.lit(0.0)), 6)
    d = r.select("ride_id", "seq", F.count(F.lit(1)).over(whole).alias("n"), centred("mag").alias("size"), step.alias("step"), centred("z").alias("vertical"), centred("hor").alias("horizontal"))
    return d.where("n = 20").drop("n")


@query("q_speed_estimator", """SELECT ride_id, seq, CASE WHEN count(*) OVER w = 10 THEN round(greatest(sum(k - 45) OVER w / 10.0::DOUBLE, 0), 6) END AS speed FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def speed_estimator(spark, sf_dir):
    """The stream form of a model call on a full ring: metres in ten seconds, never negative."""

    def step(f, row):
        f.push(float(row["seq"]), np.array([row["k"] - 45.0]))
        return {"seq": row["seq"], "speed": f.at(float(row["seq"]))}

    r = rides(spark, sf_dir).select("ride_id", "seq", "k")
    start = lambda: X.Estimator(lambda w: float(w.sum()), rows=10, hz=1.0, every=1.0, stall=1.5)
    return D.fold(r, "ride_id", ["seq"], start, step, "ride_id long, seq long, speed double").withColumn("speed", F.round("speed", 6))


@query("q_edge_stream")
def edge_stream(spark, sf_dir):
    """The small device on every ride at one sample a second: levelled ring, a model call every two seconds, distance since the last fix."""

    def step(f, row):
        if row["gnss_ok"]:
            f.fix()
        f.push(float(row["seq"]), np.array([row["dx_mm"] / 1000, row["dy_mm"] / 1000, X.GRAVITY]), np.array([0.0, 0.0, row["k"] / 50]))
        return {"seq": row["seq"], "speed": f.speed, "since_fix": f.since_fix}

    r = rides(spark, sf_dir).select("ride_id", "seq", "dx_mm", "dy_mm", "k", "gnss_ok")
    return D.fold(r, "ride_id", ["seq"], lambda: X.Edge(lambda w: float(np.abs(w[:, 3:5]).sum()), hz=1.0, model_hz=1.0, rows=10, every=2.0), step, "ride_id long, seq long, speed double, since_fix double")


#: Three sensors a second apart, from 0, 0.3 and 0.6 s on, and their columns as (x, y, z).
SENSORS = ((0.0, ("dx_mm / 1000.0", "dy_mm / 1000.0", "k / 10.0")), (0.3, ("k / 100.0", "value / 100.0", "(k - 50) / 50.0")), (0.6, ("dx_mm / 2000.0", "(k - 50) / 20.0", "9.8")))


def _imu_features_sql() -> str:
    parts = ["g0 AS (SELECT ride_id, k AS step, 0.6::DOUBLE + k / 2.0::DOUBLE AS t FROM (SELECT ride_id, unnest(range(0, max(seq) * 2)) AS k, max(seq) AS last FROM r GROUP BY ride_id) WHERE 0.6::DOUBLE + k / 2.0::DOUBLE <= last)"]
    for n, (first, v) in enumerate(SENSORS):
        e = f"SELECT ride_id, seq, {', '.join(f'({x})::DOUBLE AS v{i}' for i, x in enumerate(v))} FROM r"
        parts.append(f"e{n} AS ({e})")
        mixed = ", ".join(f"a.v{i} + (g.t - {first}::DOUBLE - a.seq) * (coalesce(b.v{i}, a.v{i}) - a.v{i}) AS s{n}{i}" for i in range(3))
        parts.append(f"g{n + 1} AS (SELECT g.*, {mixed} FROM g{n} g JOIN e{n} a ON a.ride_id = g.ride_id AND a.seq = floor(g.t - {first}::DOUBLE)::BIGINT LEFT JOIN e{n} b ON b.ride_id = g.ride_id AND b.seq = a.seq + 1)")
    parts += ["m AS (SELECT *, " + ", ".join(f"avg(s2{i}) OVER w AS m{i}" for i in range(3)) + ", least(row_number() OVER (PARTITION BY ride_id ORDER BY step), 300) AS filled FROM g3 WINDOW w AS (PARTITION BY ride_id ORDER BY step ROWS BETWEEN 80 PRECEDING AND CURRENT ROW))",
              "d AS (SELECT *, m0 / q AS dx, m1 / q AS dy, m2 / q AS dz FROM (SELECT *, sqrt(m0 * m0 + m1 * m1 + m2 * m2) AS q FROM m))",
              "ee AS (SELECT *, CASE WHEN abs(dx) > 0.9 THEN dz ELSE 0 END AS e1, CASE WHEN abs(dx) > 0.9 THEN 0 ELSE -dz END AS e2, CASE WHEN abs(dx) > 0.9 THEN -dx ELSE dy END AS e3 FROM d)",
              "f AS (SELECT *, e1 / h AS ex, e2 / h AS ey, e3 / h AS ez FROM (SELECT *, sqrt(e1 * e1 + e2 * e2 + e3 * e3) AS h FROM ee))"]
    out = []
    for j, n in enumerate((1, 0)):
        x, y, z = (f"s{n}{i}" for i in range(3))
        rows = (f"ex * {x} + ey * {y} + ez * {z}", f"(dy * ez - dz * ey) * {x} + (dz * ex - dx * ez) * {y} + (dx * ey - dy * ex) * {z}", f"dx * {x} + dy * {y} + dz * {z}")
        out += [f"round({e}, 5) AS f{3 * j + i}" for i, e in enumerate(rows)]
    return ", " + ",\n".join(parts) + f"\nSELECT ride_id, step, filled::INTEGER AS filled, {', '.join(out)} FROM f"


@query("q_imu_features", _imu_features_sql())
def imu_features(spark, sf_dir):
    """What a phone would feed the speed model: three sensors to one grid of two rows a second, levelled by the mean of gravity, event by event."""

    def step(f, row):
        got = f.push(row["sensor"], row["t"], np.array([row["x"], row["y"], row["z"]]))
        return [{"t": t, "filled": len(f.ring), **{f"f{i}": float(x) for i, x in enumerate(v)}} for t, v in got]

    r = rides(spark, sf_dir)
    events = [r.select("ride_id", F.lit(n).alias("sensor"), (F.col("seq") + F.lit(first)).alias("t"), *[F.expr(x).cast("double").alias(c) for x, c in zip(v, "xyz")]) for n, (first, v) in enumerate(SENSORS)]
    d = D.fold(events[0].unionByName(events[1]).unionByName(events[2]), "ride_id", ["t", "sensor"], lambda: X.FeatureStream("gravity", hz=2.0), step, "ride_id long, t double, filled int, " + ", ".join(f"f{i} double" for i in range(6)))
    return d.select("ride_id", F.round((F.col("t") - 0.6) * 2).cast("long").alias("step"), "filled", *[F.round(f"f{i}", 5).alias(f"f{i}") for i in range(6)])


FRAMES_SQL = f""", a AS (SELECT ride_id, seq, dx_mm / 1000.0::DOUBLE AS ax, dy_mm / 1000.0::DOUBLE AS ay, (k - 50) / 25.0::DOUBLE AS az, k / 100.0::DOUBLE AS wx, (k - 50) / 50.0::DOUBLE AS wy, value / 100 AS wz, (k - 50) / 20.0::DOUBLE AS gx, value / 50 AS gy, 9.8::DOUBLE AS gz FROM r),
t AS (SELECT *, avg(ax) OVER c AS cx, avg(ay) OVER c AS cy, avg(az) OVER c AS cz, avg(ax) OVER b AS bx, avg(ay) OVER b AS by_, avg(az) OVER b AS bz FROM a WINDOW c AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING), b AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 80 PRECEDING AND CURRENT ROW)),
w AS (SELECT ride_id, seq, frame, ax, ay, az, wx, wy, wz, CASE frame WHEN 'gravity' THEN gx WHEN 'offline' THEN ax + cx / cn * {X.GRAVITY} ELSE ax + bx / bn * {X.GRAVITY} END AS rx, CASE frame WHEN 'gravity' THEN gy WHEN 'offline' THEN ay + cy / cn * {X.GRAVITY} ELSE ay + by_ / bn * {X.GRAVITY} END AS ry, CASE frame WHEN 'gravity' THEN gz WHEN 'offline' THEN az + cz / cn * {X.GRAVITY} ELSE az + bz / bn * {X.GRAVITY} END AS rz
 FROM (SELECT *, greatest(sqrt(cx * cx + cy * cy + cz * cz), 1e-6) AS cn, greatest(sqrt(bx * bx + by_ * by_ + bz * bz), 1e-6) AS bn FROM t), (SELECT unnest(['offline', 'replica', 'gravity']) AS frame)),
m AS (SELECT *, CASE WHEN frame = 'offline' THEN avg(rx) OVER c ELSE avg(rx) OVER b END AS mx, CASE WHEN frame = 'offline' THEN avg(ry) OVER c ELSE avg(ry) OVER b END AS my, CASE WHEN frame = 'offline' THEN avg(rz) OVER c ELSE avg(rz) OVER b END AS mz FROM w WINDOW c AS (PARTITION BY ride_id, frame ORDER BY seq ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING), b AS (PARTITION BY ride_id, frame ORDER BY seq ROWS BETWEEN 80 PRECEDING AND CURRENT ROW)
 UNION ALL SELECT ride_id, seq, 'edge', ax + gx - mx, ay + gy - my, az + gz - mz, wx, wy, wz, 0, 0, 0, mx, my, mz FROM (SELECT *, exp(-(seq + 1) / 20.0::DOUBLE) * (0 + sum((ax + gx) * (1 - exp(-1 / 20.0::DOUBLE)) * exp((seq + 1) / 20.0::DOUBLE)) OVER o) AS mx, exp(-(seq + 1) / 20.0::DOUBLE) * (0 + sum((ay + gy) * (1 - exp(-1 / 20.0::DOUBLE)) * exp((seq + 1) / 20.0::DOUBLE)) OVER o) AS my, exp(-(seq + 1) / 20.0::DOUBLE) * ({X.GRAVITY} + sum((az + gz) * (1 - exp(-1 / 20.0::DOUBLE)) * exp((seq + 1) / 20.0::DOUBLE)) OVER o) AS mz FROM a WINDOW o AS (PARTITION BY ride_id ORDER BY seq))),
d AS (SELECT *, mx / n AS dx, my / n AS dy, mz / n AS dz FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS n FROM m)),
e AS (SELECT *, CASE WHEN abs(dx) > 0.9 THEN dz ELSE 0 END AS e1, CASE WHEN abs(dx) > 0.9 THEN 0 ELSE -dz END AS e2, CASE WHEN abs(dx) > 0.9 THEN -dx ELSE dy END AS e3 FROM d),
f AS (SELECT *, e1 / q AS ex, e2 / q AS ey, e3 / q AS ez FROM (SELECT *, sqrt(e1 * e1 + e2 * e2 + e3 * e3) AS q FROM e))
SELECT ride_id, seq, frame, round(ex * wx + ey * wy + ez * wz, 5) AS f0, round((dy * ez - dz * ey) * wx + (dz * ex - dx * ez) * wy + (dx * ey - dy * ex) * wz, 5) AS f1, round(dx * wx + dy * wy + dz * wz, 5) AS f2, round(ex * ax + ey * ay + ez * az, 5) AS f3, round((dy * ez - dz * ey) * ax + (dz * ex - dx * ez) * ay + (dx * ey - dy * ex) * az, 5) AS f4, round(dx * ax + dy * ay + dz * az, 5) AS f5 FROM f"""


@query("q_feature_frames", FRAMES_SQL)
def feature_frames(spark, sf_dir):
    """The model's six channels in four frames: centred as offline, trailing as on the phone, by the gravity sensor, and the small device's running gravity."""
    k, v = F.col("k"), F.col("value")
    r = rides(spark, sf_dir).select("ride_id", "seq", (F.col("dx_mm") / 1000).alias("ax"), (F.col("dy_mm") / 1000).alias("ay"), ((k - 50) / 25).alias("az"), (k / 100).alias("wx"), ((k - 50) / 50).alias("wy"), (v / 100).alias("wz"), ((k - 50) / 20).alias("gx"), (v / 50).alias("gy"), F.lit(9.8).alias("gz"))
    a, g, w = by_ride(), [F.col(c) for c in ("gx", "gy", "gz")], [F.col(c) for c in ("wx", "wy", "wz")]
    acc = [F.col(c) for c in ("ax", "ay", "az")]
    parts = []
    for name, before, after in (("offline", 40, 40), ("replica", 80, 0), ("gravity", 80, 0)):
        raw = r
        if name != "gravity":
            m = r.select("*", *[S.rolling(c, a, before, after, "mean").alias(f"m{i}") for i, c in enumerate(acc)])
            n = F.greatest(F.sqrt(sum(F.pow(f"m{i}", 2) for i in range(3))), F.lit(1e-6))
            raw = m.select(*r.columns, *[(c + F.col(f"m{i}") / n * X.GRAVITY).alias(f"r{i}") for i, c in enumerate(acc)])
        else:
            raw = r.select("*", *[c.alias(f"r{i}") for i, c in enumerate(g)])
        down = raw.select(*r.columns, *[S.rolling(F.col(f"r{i}"), a, before, after, "mean").alias(f"d{i}") for i in range(3)])
        parts.append(down.withColumn("frame", F.lit(name)).select("ride_id", "seq", "frame", *[f"d{i}" for i in range(3)], "wx", "wy", "wz", "ax", "ay", "az"))

    def step(f, row):
        whole = np.array([row["ax"] + row["gx"], row["ay"] + row["gy"], row["az"] + row["gz"]])
        d = f.push(whole)
        return {"seq": row["seq"], **{f"d{i}": float(d[i]) for i in range(3)}, "wx": row["wx"], "wy": row["wy"], "wz": row["wz"], **dict(zip(("ax", "ay", "az"), (whole - d).tolist()))}

    edge = D.fold(r, "ride_id", ["seq"], lambda: X.Ema(20.0, 1.0), step, "ride_id long, seq long, d0 double, d1 double, d2 double, wx double, wy double, wz double, ax double, ay double, az double")
    parts.append(edge.withColumn("frame", F.lit("edge")).select(parts[0].columns))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    level = lambda v: X.tilt_columns(F.col("d0"), F.col("d1"), F.col("d2"), v)
    return every.select("ride_id", "seq", "frame", *[F.round(c, 5).alias(f"f{i}") for i, c in enumerate([*level(w), *level(acc)])])


@query("q_window_speed", """, wn AS (SELECT ride_id, seq + 5 AS c, avg(step_mm) OVER w AS v, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
s AS (SELECT * FROM wn WHERE n = 10 AND (c - 5) % 8 = 0),
lo AS (SELECT r.ride_id, r.seq, s.c AS t0, s.v AS v0 FROM r ASOF LEFT JOIN s ON r.ride_id = s.ride_id AND r.seq >= s.c),
hi AS (SELECT lo.*, s.c AS t1, s.v AS v1 FROM lo ASOF LEFT JOIN s ON lo.ride_id = s.ride_id AND lo.seq <= s.c)
SELECT ride_id, seq, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (seq - t0) / (t1 - t0)::DOUBLE END, 4) AS speed_mm FROM hi""")
def window_speed(spark, sf_dir):
    """Speeds of windows of ten rows, eight apart, laid at the windows' middles and interpolated."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "step_mm"), "rides")
    w = S.trailing_windows(r, "step_mm", "ride_id", "seq", 10, 8)
    mean = F.aggregate("window", F.lit(0.0), lambda s, x: s + x) / 10
    s = w.select("ride_id", (F.col("seq") + 5).alias("seq"), mean.alias("v"))
    return S.interpolate(r.select("ride_id", "seq"), s, "ride_id", "seq", "v").select("ride_id", "seq", F.round("v", 4).alias("speed_mm"))


@query("q_ride_windows", """SELECT ride_id, seq, n, went_mm, f0, f9 FROM (SELECT ride_id, seq, count(*) OVER w AS n, last_value(d_mm) OVER w - d_mm AS went_mm, k AS f0, last_value(k) OVER w AS f9 FROM r WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE n = 10 AND seq % 2 = 0""")
def ride_windows(spark, sf_dir):
    """Training windows of a ride: ten rows of features, two apart, labelled with the distance they cover."""
    r = rides(spark, sf_dir)
    f = S.trailing_windows(r.withColumn("f", F.struct("k", "d_mm")), "f", "ride_id", "seq", 10, 2)
    return f.select("ride_id", "seq", F.size("window").cast("long").alias("n"), (F.col("window")[9]["d_mm"] - F.col("window")[0]["d_mm"]).alias("went_mm"), F.col("window")[0]["k"].alias("f0"), F.col("window")[9]["k"].alias("f9"))


@query("q_network_speed")
def network_speed(spark, sf_dir):
    """A small residual network, trained on the windows of four rides in five and held against the mean on the others: errors of each held-out ride.

    Fixed settings and seed; windows of ten rows, two apart, labelled with the distance they cover in hundreds of metres.
    """
    r = rides(spark, sf_dir)
    f = S.trailing_windows(r.withColumn("f", F.struct("k", "value", "d_mm")), "f", "ride_id", "seq", 10, 2)
    channel = lambda g: F.transform("window", g)
    went = (F.col("window")[9]["d_mm"] - F.col("window")[0]["d_mm"]) / 100000.0
    rows = materialize(f.select(F.struct("ride_id", "seq").alias("id"), "ride_id", F.concat(channel(lambda x: (x["k"] - 50) / 50.0), channel(lambda x: x["value"] / 100.0)).alias("x"), went.alias("y")), "windows")
    learned, net = rows.where("ride_id % 5 <> 0"), N.ResidualNet(channels=2, window=10, base=4, layers=(1, 1), hidden=8)
    N.train(learned, net, epochs=3, batches=4, rate=0.02)
    mean = learned.agg(F.avg("y")).first()[0] or 0.0
    p = N.predict(rows.where("ride_id % 5 = 0"), net, ["ride_id", "y"])
    error = lambda c: F.round(F.sqrt(F.avg(F.pow(c - F.col("y"), 2))), 6)
    return p.groupBy("ride_id").agg(F.count(F.lit(1)).alias("windows"), error(F.col("predicted")).alias("rmse"), error(F.lit(mean)).alias("rmse_by_mean"))


JUMPS = "x_mm / 1000.0::DOUBLE + CASE WHEN k < 4 THEN 150 ELSE 0 END AS x, y_mm / 1000.0::DOUBLE AS y"


def jumping(spark, sf_dir):
    """Tracks with a jump of 150 m now and then, in metres."""
    r = rides(spark, sf_dir)
    return r.select("ride_id", "seq", "k", (F.col("x_mm") / 1000 + F.when(F.col("k") < 4, 150).otherwise(0)).alias("x"), (F.col("y_mm") / 1000).alias("y"))


def thinned(rows, start, keep):
    def step(f, row):
        return {"seq": row["seq"], "x": row["x"], "y": row["y"]} if keep(f, row) else None

    return D.fold(rows, "ride_id", ["seq"], start, step, "ride_id long, seq long, x double, y double")


@query("q_live_path", stepwise(f"SELECT ride_id, seq AS n, {JUMPS} FROM r", {"ux": "NULL::DOUBLE", "uy": "NULL::DOUBLE", "kept": "false"}, [f"ux_ IS NULL OR ({near('u')} > 0 AND {near('u')} <= 100) AS kept", "CASE WHEN kept THEN x ELSE ux_ END AS ux, CASE WHEN kept THEN y ELSE uy_ END AS uy"], "SELECT ride_id, n AS seq, ux AS x, uy AS y FROM f WHERE n >= 0 AND kept"), ctes=False)
def live_path(spark, sf_dir):
    """The drawn path: points that moved, without jumps of more than 100 m."""
    return thinned(jumping(spark, sf_dir), lambda: D.Anchor(0.0, 100.0), lambda f, row: f.keep((row["x"], row["y"])))


STORE = f"{near('u')} >= 2 AND {near('u')} <= 60"


@query("q_learned_routes", stepwise(f"SELECT ride_id, seq AS n, {JUMPS} FROM r", {"ux": "NULL::DOUBLE", "uy": "NULL::DOUBLE", "kept": "false"}, [f"ux_ IS NULL OR ({STORE}) AS kept", "CASE WHEN kept THEN x ELSE ux_ END AS ux, CASE WHEN kept THEN y ELSE uy_ END AS uy"], """, kp AS (SELECT * FROM f WHERE n >= 0 AND kept),
sp AS (SELECT *, sqrt(pow(ux - lag(ux) OVER w, 2) + pow(uy - lag(uy) OVER w, 2)) AS l FROM kp WINDOW w AS (PARTITION BY ride_id ORDER BY n)),
g AS (SELECT ride_id, sum(l) AS m, count(*) AS n_points, sqrt(pow(arg_max(ux, n) - arg_min(ux, n), 2) + pow(arg_max(uy, n) - arg_min(uy, n), 2)) AS ends FROM sp GROUP BY ride_id)
SELECT ride_id, 'learned ' || ride_id AS name, round(m, 1) AS length_m, n_points, ends < 50 AS closed FROM g JOIN (SELECT ride_id FROM st GROUP BY ride_id HAVING count(*) >= 20) USING (ride_id) WHERE n_points >= 10 AND m >= 200"""), ctes=False)
def learned_routes(spark, sf_dir):
    """Routes from tracks: hops of more than 60 m and of less than 2 m go, short tracks are no route."""
    j = jumping(spark, sf_dir)

    class Store:
        def __init__(self):
            self.at = None

        def keep(self, xy):
            if self.at is not None and not 2 <= math.dist(self.at, xy) <= 60:
                return False
            self.at = xy
            return True

    kept = thinned(j, Store, lambda f, row: f.keep((row["x"], row["y"])))
    return K.learned_routes(kept.select("ride_id", "seq", (F.col("x") * 1000).alias("x_mm"), (F.col("y") * 1000).alias("y_mm")), j)


@query("q_real_movement", stepwise("SELECT ride_id, seq AS n, x_mm / 1000.0::DOUBLE AS x, y_mm / 1000.0::DOUBLE AS y, k / 5.0::DOUBLE AS acc FROM r", {"ux": "NULL::DOUBLE", "uy": "NULL::DOUBLE", "kept": "false"}, [f"ux_ IS NULL OR {near('u')} > least(greatest(acc, 3), 8) AS kept", "CASE WHEN kept THEN x ELSE ux_ END AS ux, CASE WHEN kept THEN y ELSE uy_ END AS uy"], "SELECT ride_id, n AS seq, ux AS x, uy AS y FROM f WHERE n >= 0 AND kept"), ctes=False)
def real_movement(spark, sf_dir):
    """Fixes that have moved from the last accepted one by more than their accuracy, of 3 to 8 m."""

    class Moved:
        def __init__(self):
            self.at = None

        def keep(self, xy, accuracy):
            if self.at is not None and not math.dist(self.at, xy) > min(max(accuracy, 3.0), 8.0):
                return False
            self.at = xy
            return True

    r = rides(spark, sf_dir).select("ride_id", "seq", (F.col("x_mm") / 1000).alias("x"), (F.col("y_mm") / 1000).alias("y"), (F.col("k") / 5).alias("acc"))
    return thinned(r, Moved, lambda f, row: f.keep((row["x"], row["y"]), row["acc"]))


@query("q_tag_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'building' ELSE replace(lower(p_type), '_', ' ') END AS kind, p_type AS plain FROM (SELECT p_partkey, p_size, p_type FROM part)", ctes=False)
def tag_text(spark, sf_dir):
    """Kinds of places from tags like "building=yes" or "shop=large_brushed"."""
    p = table(spark, sf_dir, "part")
    tag = F.concat(F.lit("shop="), F.when(F.col("p_size") % 3 == 0, "yes").otherwise(F.lower(F.regexp_replace("p_type", " ", "_"))))
    return p.select("p_partkey", T.tag_text(tag).alias("kind"), F.col("p_type").alias("plain"))


#: Road classes by line number, as the query names them.
CLASSES = ["motorway", "trunk_link", "primary", "secondary", "tertiary_link", "residential", "service", "living_street", "unclassified", "road", "footway"]


@query("q_way_classes", f"""WITH t AS (SELECT l_orderkey, l_linenumber, (['{"', '".join(CLASSES)}'])[(l_linenumber + l_partkey) % 11 + 1] AS highway, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN '-1' ELSE 'no' END AS oneway, CASE WHEN l_linestatus = 'F' THEN 'private' ELSE 'yes' END AS access,
 (['roundabout', 'circular', 'none', NULL])[l_suppkey % 4 + 1] AS junction, (['driveway', 'parking_aisle', 'alley', NULL, NULL])[l_partkey % 5 + 1] AS service, CASE WHEN l_quantity > 45 THEN 'yes' END AS area FROM lineitem),
k AS (SELECT *, CASE WHEN service IN ('parking_aisle', 'drive-through') OR area = 'yes' THEN NULL WHEN highway IN ('motorway', 'motorway_link', 'trunk_link') THEN 'trunk' WHEN highway = 'tertiary_link' THEN 'tertiary' ELSE highway END AS kind FROM t)
SELECT l_orderkey, l_linenumber, highway, oneway, access, kind, CASE WHEN oneway = 'yes' OR junction IN ('roundabout', 'circular') THEN 1 WHEN oneway = '-1' THEN -1 ELSE 0 END AS way, access = 'private' AS private,
 round(3.6::DOUBLE / CASE kind WHEN 'trunk' THEN 40 WHEN 'primary' THEN 35 WHEN 'secondary' THEN 30 WHEN 'tertiary' THEN 25 WHEN 'unclassified' THEN 20 WHEN 'residential' THEN 20 WHEN 'service' THEN 15 WHEN 'living_street' THEN 10 WHEN 'road' THEN 20 END * CASE WHEN access = 'private' THEN 5 ELSE 1 END, 9) AS pace FROM k""", ctes=False)
def way_classes(spark, sf_dir):
    """Class, direction, privacy and seconds a metre of ways from their tags."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    tagged = {"junction": pick(["roundabout", "circular", "none", None], F.col("l_suppkey")), "service": pick(["driveway", SKIPPED_SERVICE[0], "alley", None, None], F.col("l_partkey")), "area": F.when(F.col("l_quantity") > 45, "yes")}
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.create_map(*[x for k, v in tagged.items() for x in (F.lit(k), v)]).alias("more"), pick(CLASSES, F.col("l_linenumber") + F.col("l_partkey")).alias("highway"), F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "-1").otherwise("no").alias("oneway"), F.when(F.col("l_linestatus") == "F", "private").otherwise("yes").alias("access"))
    tags = F.map_concat("more", F.create_map(F.lit("highway"), F.col("highway"), F.lit("oneway"), F.col("oneway"), F.lit("access"), F.col("access")))
    kind, way, private = way_class(tags)
    return li.select("l_orderkey", "l_linenumber", "highway", "oneway", "access", kind.alias("kind"), way.alias("way"), private.alias("private")).withColumn("pace", F.round(H.seconds_per_metre(F.col("kind"), F.col("private")), 9))


@query("q_edge_points", ", g AS (SELECT ride_id, CAST(unnest(generate_series(0, max(d_mm), 10000)) AS BIGINT) AS s FROM r GROUP BY ride_id), " + AT_SQL + "SELECT ride_id, s, round(x, 4) AS x, round(y, 4) AS y, round(degrees(atan2(y1 - y0, x1 - x0)), 4) AS heading_deg FROM pl WHERE t0 IS NOT NULL AND t1 IS NOT NULL AND t0 <> t1")
def edge_points(spark, sf_dir):
    """Places every 10 m along an edge, with the heading there; those at its own points are left out."""
    r = rides(spark, sf_dir)
    places = r.groupBy("ride_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("d_mm"), F.lit(10000).cast("long"))).alias("s"))
    e = W.at(places, road_of(r), with_heading=True).where("heading is not null")
    return e.select("ride_id", "s", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(F.degrees("heading"), 4).alias("heading_deg"))


@query("q_imu_observations", """, g AS (SELECT ride_id, CAST(unnest(generate_series(0, max(d_mm) - 1, 10000)) AS BIGINT) AS s FROM r GROUP BY ride_id),
lo AS (SELECT g.*, r.d_mm AS t0, r.head_deg AS v0 FROM g ASOF LEFT JOIN r ON g.ride_id = r.ride_id AND g.s >= r.d_mm),
hi AS (SELECT lo.*, r.d_mm AS t1, r.head_deg AS v1 FROM lo ASOF LEFT JOIN r ON lo.ride_id = r.ride_id AND lo.s <= r.d_mm),
h AS (SELECT ride_id, s, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (s - t0)::DOUBLE / (t1 - t0) END AS h FROM hi)
SELECT ride_id, s, turn_deg FROM (SELECT ride_id, s, round(h - lag(h) OVER (PARTITION BY ride_id ORDER BY s), 6) AS turn_deg FROM h) WHERE turn_deg IS NOT NULL""")
def imu_observations(spark, sf_dir):
    """What a map matcher gets to see: the turn over every ten metres."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "d_mm", "head_deg"), "rides")
    places = r.groupBy("ride_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("d_mm") - 1, F.lit(10000).cast("long"))).alias("d_mm"))
    h = S.interpolate(places, r.withColumn("head_deg", F.col("head_deg").cast("double")), "ride_id", "d_mm", "head_deg")
    turn = F.round(F.col("head_deg") - F.lag("head_deg").over(Window.partitionBy("ride_id").orderBy("d_mm")), 6)
    return h.select("ride_id", F.col("d_mm").alias("s"), turn.alias("turn_deg")).where("turn_deg is not null")


@query("q_followed_roads")
def followed_roads(spark, sf_dir):
    """Every ride's turns over ten metres, followed on the streets within 600 m of where it begins, a street every 40 m between neighbouring
    parts: how far from the ride the way lies at each step, where it ends, and junctions passed.

    A ride and the streets about it are a group, as large as the area that a ride can reach; streets meet rides on cells.
    """
    n, edges, targets = whole_grid(spark, sf_dir)
    n = materialize(n, "places")
    wide, reach, d = max(1, math.isqrt(max(n.count() - 1, 0)) + 1), 600.0, 40.0
    place = F.col("node") - targets[0]
    at = n.select("node", (F.pmod(place, F.lit(wide)) * d).alias("x"), (F.floor(place / wide) * d).alias("y"))
    p = lambda c: at.select(F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    streets = materialize(edges.where("u < v").join(p("u"), "u").join(p("v"), "v").select("u", "v", "ux", "uy", "vx", "vy"), "streets")
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "d_mm", "head_deg", "x_mm", "y_mm"), "rides")
    # a ride begins at the part that its number falls on
    total = n.count()
    starts = r.groupBy("ride_id").agg(F.min_by("x_mm", "seq").alias("x0"), F.min_by("y_mm", "seq").alias("y0")).withColumn("node", F.pmod("ride_id", F.lit(total)) + targets[0]).join(at, "node")
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / reach).cast("long"), F.floor((F.col(c) + reach) / reach).cast("long")))
    asked = starts.withColumn("cx", cells("x")).withColumn("cy", cells("y")).select("ride_id", "x", "y", "cx", "cy")
    near = streets.withColumn("cx", F.floor(F.col("ux") / reach).cast("long")).withColumn("cy", F.floor(F.col("uy") / reach).cast("long")).join(asked, ["cx", "cy"])
    near = near.where(F.hypot(F.col("ux") - F.col("x"), F.col("uy") - F.col("y")) <= reach).select("ride_id", "u", "v", "ux", "uy", "vx", "vy")
    truth = W.at(r.groupBy("ride_id").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("d_mm") - 1, F.lit(10000).cast("long"))).alias("s")), road_of(r)).join(starts.select("ride_id", "x0", "y0", F.col("x").alias("sx"), F.col("y").alias("sy")), "ride_id")
    seen = imu_observations(spark, sf_dir).join(truth.select("ride_id", "s", "sx", "sy", (F.col("x") - F.col("x0")).alias("tx"), (F.col("y") - F.col("y0")).alias("ty")), ["ride_id", "s"])

    def follow(key, obs: pd.DataFrame, roads: pd.DataFrame) -> pd.DataFrame:
        obs, roads = obs.sort_values("s"), roads.sort_values(["u", "v"])
        if obs.empty or roads.empty:
            return pd.DataFrame({"ride_id": [], "steps": [], "x": [], "y": [], "junctions": [], "median_off": [], "final_off": []})
        net = hmm.Roads([hmm.Edge(int(e.u), int(e.v), ((e.ux, e.uy), (e.vx, e.vy))) for e in roads.itertuples()])
        first = (float(obs["sx"].iloc[0]), float(obs["sy"].iloc[0]))
        path, way = hmm.follow(net, first, [(10.0, t) for t in obs["turn_deg"].tolist()])
        if not path:
            return pd.DataFrame({"ride_id": [key[0]], "steps": [0], "x": [None], "y": [None], "junctions": [0], "median_off": [None], "final_off": [None]})
        # the first place is where the search began, before any observation
        true = np.column_stack([first[0] + obs["tx"] / 1000, first[1] + obs["ty"] / 1000])[: len(path) - 1]
        off = np.hypot(*(np.array(path)[1:] - true).T) if len(true) else np.zeros(1)
        return pd.DataFrame({"ride_id": [key[0]], "steps": [len(path)], "x": [path[-1][0]], "y": [path[-1][1]], "junctions": [net.junctions(way)], "median_off": [float(np.median(off))], "final_off": [float(off[-1])]})

    streets_of = near.withColumnRenamed("ride_id", "of")
    return seen.groupBy("ride_id").cogroup(streets_of.groupBy("of")).applyInPandas(follow, "ride_id long, steps int, x double, y double, junctions int, median_off double, final_off double")


@query("q_maneuvers", stepwise("""SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY seq) - 1 AS n, along, turn FROM (SELECT ride_id, seq, d_mm / 1000.0::DOUBLE AS along, lead(k - 50) OVER (PARTITION BY ride_id ORDER BY seq) AS turn, max(d_mm) OVER (PARTITION BY ride_id) / 1000.0::DOUBLE AS total, k FROM r) WHERE turn IS NOT NULL AND seq > 0 AND abs(turn) >= 30 AND k % 5 < 3 AND along > 15 AND along < total - 15""", {"oa": "NULL::DOUBLE", "og": "NULL::DOUBLE", "sa": "NULL::DOUBLE", "sg": "NULL::DOUBLE"}, ["oa_ IS NOT NULL AND along - oa_ < 25 AS joins", "CASE WHEN joins THEN NULL ELSE oa_ END AS sa, CASE WHEN joins THEN NULL ELSE og_ END AS sg, CASE WHEN joins THEN oa_ ELSE along END AS oa, CASE WHEN joins THEN og_ + turn ELSE turn END AS og"], "SELECT ride_id, round(sa, 3) AS along_m, round(sg) AS angle_deg FROM f WHERE sa IS NOT NULL UNION ALL SELECT ride_id, round(arg_max(oa, n), 3), round(arg_max(og, n)) FROM f WHERE n >= 0 GROUP BY ride_id"), ctes=False)
def maneuvers(spark, sf_dir):
    """Turns of 30 degrees or more at junctions of a route; nearer than 25 m they are one."""

    def step(f, row):
        got = f.push(row["along"], row["turn"])
        return None if got is None else {"along_m": got[0], "angle_deg": got[1]}

    w = by_ride()
    r = rides(spark, sf_dir).withColumn("turn", F.lead(F.col("k") - 50).over(w).cast("double")).withColumn("total", F.max("d_mm").over(Window.partitionBy("ride_id")) / 1000).withColumn("along", F.col("d_mm") / 1000)
    t = r.where("turn is not null and seq > 0 and abs(turn) >= 30 and k % 5 < 3 and along > 15 and along < total - 15").select("ride_id", "seq", "along", "turn")
    d = D.fold(t, "ride_id", ["seq"], lambda: D.TurnPieces(25.0, any_sign=True), step, "ride_id long, along_m double, angle_deg double", lambda f, key: [] if f.open is None else [{"along_m": f.open[0], "angle_deg": f.open[1]}])
    return d.select("ride_id", F.round("along_m", 3).alias("along_m"), F.round("angle_deg").alias("angle_deg"))


@query("q_arrival_nodes", """, nd AS (SELECT event_id AS node, x_mm AS nx, y_mm AS ny FROM r WHERE seq % 10 = 0), pl AS (SELECT event_id AS place, ride_id, x_mm AS px, y_mm AS py, k < 50 AS outlined FROM r WHERE hit),
pr AS (SELECT *, (nx - px) * (nx - px) + (ny - py) * (ny - py) AS d2 FROM pl, nd),
best AS (SELECT place, min(d2) AS least_d2, arg_min(node, (d2, node)) AS nearest FROM pr GROUP BY place),
near AS (SELECT place, count(*) AS nodes, min(node) AS first_node FROM pr WHERE d2 <= CASE WHEN outlined THEN 1600000000 ELSE 3600000000 END GROUP BY place)
SELECT place, coalesce(nodes, 1) AS nodes, coalesce(first_node, nearest) AS first_node, CAST(least_d2 AS BIGINT) AS least_d2 FROM best LEFT JOIN near USING (place)""")
def arrival_nodes(spark, sf_dir):
    """Where a place can be reached: nodes within 40 m of an outline, 60 m of a point, else the nearest one."""
    r = materialize(rides(spark, sf_dir).select("event_id", "seq", "hit", "k", "x_mm", "y_mm"), "rides")
    nodes = r.where("seq % 10 = 0").select(F.col("event_id").alias("node"), F.col("x_mm").alias("nx"), F.col("y_mm").alias("ny"))
    places = r.where("hit").select(F.col("event_id").alias("place"), (F.col("k") < 50).alias("outlined"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y"))
    g = arrivals(places, nodes, 40000, 60000, lambda d: materialize(d, "arrivals"))
    return g.select("place", F.size("arrive").cast("long").alias("nodes"), F.col("arrive")[0].alias("first_node"), F.col("least_d2").cast("long").alias("least_d2"))


@query("q_directed_reroute", f"""WITH RECURSIVE {GRID_SQL}, s(node, cost) USING KEY (node) AS (SELECT least, 0::BIGINT FROM z UNION SELECT e.v, CAST(min(s.cost + e.cost) AS BIGINT) FROM s JOIN e ON e.u = s.node LEFT JOIN recurring.s AS o ON o.node = e.v WHERE o.cost IS NULL OR s.cost + e.cost < o.cost GROUP BY e.v)
SELECT e.u, e.v, least(e.cost / 4.0::DOUBLE + b.cost, e.cost * 0.75::DOUBLE + 30 + a.cost) AS cost, e.cost * 0.75::DOUBLE + 30 + a.cost < e.cost / 4.0::DOUBLE + b.cost AS u_turn FROM e JOIN s a ON a.node = e.u JOIN s b ON b.node = e.v""", ctes=False)
def directed_reroute(spark, sf_dir):
    """From three quarters along every edge, the way it is driven, to the first node; turning back costs 30 more."""
    n, edges, targets = whole_grid(spark, sf_dir)
    edges = materialize(edges, "edges")
    wide = max(1, math.isqrt(max(n.count() - 1, 0)) + 1)
    place = F.col("node") - targets[0]
    regions = n.select("node", F.concat_ws(":", F.floor(F.pmod(place, F.lit(wide)) / 16), F.floor(place / wide / 16)).alias("region"))
    # edges lead both ways at the same cost, so costs from the target are costs to it
    to = H.distances(edges, regions, n.where(F.col("node") == targets[0]).select("node", F.lit(0.0).alias("cost")), lambda d: materialize(d, "distances"))
    e = edges.join(to.select(F.col("node").alias("u"), F.col("cost").alias("a")), "u").join(to.select(F.col("node").alias("v"), F.col("cost").alias("b")), "v")
    on, back = F.col("cost") / 4 + F.col("b"), F.col("cost") * 0.75 + 30 + F.col("a")
    return e.select("u", "v", F.least(on, back).alias("cost2"), (back < on).alias("u_turn")).withColumnRenamed("cost2", "cost")


@query("q_route_arrays", """SELECT ride_id, p[least(len(p), 4):] AS suffix, list_reverse(p) AS back, list_concat(list_reverse(p), p[2:]) AS there_and_back, len(p) AS n FROM (SELECT ride_id, list(seq ORDER BY seq) FILTER (WHERE hit) AS p FROM r GROUP BY ride_id) WHERE len(p) > 0""")
def route_arrays(spark, sf_dir):
    """Paths as arrays: from the fourth node on, reversed, there and back."""
    p = rides(spark, sf_dir).where("hit").groupBy("ride_id").agg(F.sort_array(F.collect_list("seq")).alias("p"))
    n = F.size("p")
    return p.select("ride_id", F.slice("p", F.least(n, F.lit(4)), n).alias("suffix"), F.reverse("p").alias("back"), F.concat(F.reverse("p"), F.slice("p", 2, n)).alias("there_and_back"), n.cast("long").alias("n"))


@query("q_near_distance", """, a AS (SELECT event_id, 15.0::DOUBLE + y_mm / 1e8::DOUBLE AS lat1, 75.0::DOUBLE + x_mm / 1e8::DOUBLE AS lon1, 15.0::DOUBLE + (y_mm + dy_mm) / 1e8::DOUBLE AS lat2, 75.0::DOUBLE + (x_mm - dx_mm) / 1e8::DOUBLE AS lon2 FROM r)
SELECT event_id, round(6371008.8::DOUBLE * sqrt(pow(radians(lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), 2) + pow(radians(lat2 - lat1), 2)), 4) AS metres FROM a""")
def near_distance(spark, sf_dir):
    """Distances by the cosine of the middle latitude."""
    lat, lon = F.lit(15.0) + F.col("y_mm") / 1e8, F.lit(75.0) + F.col("x_mm") / 1e8
    d = G.distance(lat, lon, F.lit(15.0) + (F.col("y_mm") + F.col("dy_mm")) / 1e8, F.lit(75.0) + (F.col("x_mm") - F.col("dx_mm")) / 1e8)
    return rides(spark, sf_dir).select("event_id", F.round(d, 4).alias("metres"))


@query("q_trip_display", """SELECT ride_id, printf('%.1f km/h', round(max(d_mm) / max(seq + 1) * 3.6::DOUBLE / 1000, 1)) AS mean_speed, CASE WHEN max(d_mm) < 1000000 THEN CAST(CAST(round(max(d_mm) / 10000.0::DOUBLE) * 10 AS BIGINT) AS VARCHAR) || ' m' ELSE printf('%.1f km', max(d_mm) / 1000000.0::DOUBLE) END AS length, printf('%d:%02d', max(seq) // 60, max(seq) % 60) AS duration FROM r GROUP BY ride_id""")
def trip_display(spark, sf_dir):
    """What a trip's summary shows: mean speed, length, duration."""
    g = rides(spark, sf_dir).groupBy("ride_id").agg(F.max("d_mm").alias("d"), F.max("seq").alias("t"))
    return g.select("ride_id", F.format_string("%.1f km/h", F.round(F.col("d") / (F.col("t") + 1) * 3.6 / 1000, 1)).alias("mean_speed"), T.distance_text(F.col("d") / 1000).alias("length"), F.format_string("%d:%02d", F.floor(F.col("t") / 60), F.col("t") % 60).alias("duration"))


@query("q_route_list", """, l AS (SELECT ride_id, count(*) AS points, max(d_mm) AS length_mm, arg_max(d_mm, seq) AS last_mm FROM r GROUP BY ride_id)
SELECT place, name, points, length_mm FROM (SELECT 0 AS place, 'AUTO' AS name, NULL::BIGINT AS points, NULL::BIGINT AS length_mm UNION ALL SELECT row_number() OVER (ORDER BY ride_id), 'ride ' || ride_id, points, length_mm FROM l)""")
def route_list(spark, sf_dir):
    """What a rider can choose from: AUTO, then the routes in order; their number is a list on a screen."""
    r = rides(spark, sf_dir).groupBy("ride_id").agg(F.count(F.lit(1)).alias("points"), F.max("d_mm").alias("length_mm"))
    listed = r.select(F.row_number().over(Window.orderBy("ride_id")).cast("long").alias("place"), F.concat(F.lit("ride "), F.col("ride_id")).alias("name"), "points", "length_mm")
    auto = spark.range(1).select(F.lit(0).cast("long").alias("place"), F.lit("AUTO").alias("name"), F.lit(None).cast("long").alias("points"), F.lit(None).cast("long").alias("length_mm"))
    return auto.unionByName(listed)
