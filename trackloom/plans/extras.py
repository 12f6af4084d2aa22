"""Queries of the smaller operators: text scorecards, fault injection, event runs, distances since the last fix."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trackloom.functions.geo import confidence_radius
from trackloom.operators import fold as D
from trackloom.operators import series as S
from trackloom.operators.cleaning import clean, clean_distance
from trackloom.operators.places import merge_places
from trackloom.plans._register import Register
from trackloom.plans.folds import CLEAN_SQL
from trackloom.plans.scoring import SCORES_SQL, scores
from trackloom.sources.rides import RIDES_SQL, by_ride, rides
from trackloom.sources.shared import materialize

R = Register(RIDES_SQL)
QUERIES, SQL, query = R.queries, R.sql, R.query


@query("q_scorecard_text", SCORES_SQL + "SELECT predictor, predictor || ': ' || count(*) || ' outages, median ' || CAST(round(quantile_cont(drift_pct, 0.5)) AS BIGINT) || ' %, ' || count(*) FILTER (WHERE passes) || ' under 10 %' AS line FROM s GROUP BY predictor")
def scorecard_text(spark, sf_dir):
    g = scores(spark, sf_dir).groupBy("predictor").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("drift_pct", 0.5)).cast("long").alias("med"), F.count_if("passes").alias("ok"))
    return g.select("predictor", F.format_string("%s: %d outages, median %d %%, %d under 10 %%", "predictor", "n", "med", "ok").alias("line"))


@query("q_fault_injection", """, f AS (SELECT *, CAST(round(40000 * greatest(least((d_mm - 50000) / 40000.0::DOUBLE, (300000 - d_mm) / 40000.0::DOUBLE, 1), 0)) AS BIGINT) AS pushed_mm FROM r)
SELECT ride_id, seq, pushed_mm, CAST(round(x_mm - pushed_mm * sin(radians(head_deg::DOUBLE))) AS BIGINT) AS x_mm, CAST(round(y_mm + pushed_mm * cos(radians(head_deg::DOUBLE))) AS BIGINT) AS y_mm FROM f""")
def fault_injection(spark, sf_dir):
    """A 250 m stretch pushed 40 m sideways, with ramps of 40 m."""
    share = F.greatest(F.least((F.col("d_mm") - 50000) / 40000.0, (300000 - F.col("d_mm")) / 40000.0, F.lit(1.0)), F.lit(0.0))
    r = rides(spark, sf_dir).withColumn("pushed_mm", F.round(40000 * share).cast("long")).withColumn("h", F.radians(F.col("head_deg").cast("double")))
    return r.select("ride_id", "seq", "pushed_mm", F.round(F.col("x_mm") - F.col("pushed_mm") * F.sin("h")).cast("long").alias("x_mm"), F.round(F.col("y_mm") + F.col("pushed_mm") * F.cos("h")).cast("long").alias("y_mm"))


@query("q_landmark_width", "SELECT event_id, CASE WHEN step_mm * (k + 10) < 112500 THEN 'bump' WHEN step_mm * (k + 10) < 187500 THEN 'hump' ELSE 'table' END AS by_width, step_mm * (k + 10) AS width_um FROM r WHERE hit")
def landmark_width(spark, sf_dir):
    """Kind by duration times speed: halfway between the surveyed widths. A recorded negative: no better than chance on real rides."""
    width = F.col("step_mm") * (F.col("k") + 10)
    return rides(spark, sf_dir).where("hit").select("event_id", F.when(width < 112500, "bump").when(width < 187500, "hump").otherwise("table").alias("by_width"), width.alias("width_um"))


@query("q_trip_times", "SELECT ride_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS began, strftime(max(ts), '%Y%m%d_%H%M%S') AS stamp, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) AS ended_ms FROM r GROUP BY ride_id")
def trip_times(spark, sf_dir):
    g = rides(spark, sf_dir).groupBy("ride_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("ride_id", F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("began"), F.date_format("b", "yyyyMMdd_HHmmss").alias("stamp"), F.unix_millis("b").alias("ended_ms"))


@query("q_event_runs", """, b AS (SELECT *, CASE WHEN lag(up) OVER (PARTITION BY ride_id ORDER BY seq) IS NOT DISTINCT FROM up THEN 0 ELSE 1 END AS n FROM (SELECT *, step_mm > 5000 AS up FROM r)),
i AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ride_id ORDER BY seq) AS BIGINT) AS run FROM b)
SELECT ride_id, run, min(seq) AS t0, max(seq) AS t1, arg_max(seq, (step_mm, -seq)) AS apex, max(step_mm) AS peak_mm, CAST(sum(step_mm * step_mm) AS BIGINT) AS energy FROM i WHERE up GROUP BY ride_id, run""")
def event_runs(spark, sf_dir):
    """Runs above a threshold as events: extent, apex, peak, energy."""
    i = S.islands(rides(spark, sf_dir).withColumn("up", F.col("step_mm") > 5000), F.col("up"), "ride_id", "seq", "run").where("up")
    return i.groupBy("ride_id", "run").agg(F.min("seq").alias("t0"), F.max("seq").alias("t1"), F.max_by("seq", F.struct("step_mm", -F.col("seq"))).alias("apex"), F.max("step_mm").alias("peak_mm"), F.sum(F.col("step_mm") * F.col("step_mm")).alias("energy"))


EVENTS_SQL = """, b AS (SELECT *, CASE WHEN lag(up) OVER (PARTITION BY ride_id ORDER BY seq) IS NOT DISTINCT FROM up THEN 0 ELSE 1 END AS n FROM (SELECT *, step_mm > 3000 AS up FROM r)),
i AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ride_id ORDER BY seq) AS BIGINT) AS run FROM b),
ev AS (SELECT ride_id, run AS event, min(seq) AS t0, max(seq) AS t1, arg_max(seq, (step_mm, -seq)) AS apex, max(step_mm) AS peak FROM i WHERE up GROUP BY ride_id, run)
"""


def step_events(r):
    i = S.islands(r.withColumn("up", F.col("step_mm") > 3000), F.col("up"), "ride_id", "seq", "run").where("up")
    return i.groupBy("ride_id", F.col("run").alias("event")).agg(F.min("seq").alias("t0"), F.max("seq").alias("t1"), F.max_by("seq", F.struct("step_mm", -F.col("seq"))).alias("apex"), F.max("step_mm").alias("peak"))


@query("q_event_widths", EVENTS_SQL + """, lo AS (SELECT e.ride_id, e.event, e.t0, e.t1, max(seq) FILTER (WHERE seq < apex AND step_mm * 2 < peak) AS lo, min(seq) FILTER (WHERE seq > apex AND step_mm * 2 < peak) AS hi FROM ev e JOIN r ON r.ride_id = e.ride_id AND seq BETWEEN t0 AND t1 GROUP BY ALL)
SELECT ride_id, event, coalesce(hi - 1, t1) - coalesce(lo + 1, t0) + 1 AS width FROM lo""")
def event_widths(spark, sf_dir):
    """How long events stay above half of their peak."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "step_mm"), "rides")
    return S.half_width(r, step_events(r), "ride_id", "seq", "step_mm")


@query("q_event_spectra", EVENTS_SQL + """, xs AS (SELECT e.ride_id, e.event, r.step_mm / 1000.0::DOUBLE AS x, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY e.ride_id, e.event) AS n, avg(r.step_mm / 1000.0::DOUBLE) OVER (PARTITION BY e.ride_id, e.event) AS mean FROM ev e JOIN r ON r.ride_id = e.ride_id AND r.seq BETWEEN apex - 16 AND apex + 15 WINDOW w AS (PARTITION BY e.ride_id, e.event ORDER BY r.seq)),
tp AS (SELECT *, (x - mean) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / (n - 1))) AS y FROM xs WHERE n >= 8),
sp AS (SELECT ride_id, event, f, n, sqrt(pow(sum(y * cos(2 * pi() * f * j / n)), 2) + pow(sum(y * sin(2 * pi() * f * j / n)), 2)) AS loud FROM tp, (SELECT unnest(range(1, 17)) AS f) WHERE f * 10.0::DOUBLE / n > 1 AND f * 10.0::DOUBLE / n < 5 GROUP BY ride_id, event, f, n)
SELECT DISTINCT ride_id, event, n AS samples, round(fr, 6) AS frequency FROM (SELECT xs.ride_id, xs.event, xs.n, fr FROM (SELECT DISTINCT ride_id, event, n FROM xs) xs LEFT JOIN (SELECT ride_id, event, arg_max(f * 10.0::DOUBLE / n, (round(loud, 9), -f)) AS fr FROM sp GROUP BY ride_id, event) USING (ride_id, event))""")
def event_spectra(spark, sf_dir):
    """Where the spectrum of the 32 rows around an event is loudest; ten rows stand for a second."""
    r = materialize(rides(spark, sf_dir).select("ride_id", "seq", "step_mm"), "rides")
    near = step_events(r).select("ride_id", "event", F.explode(F.sequence(F.col("apex") - 16, F.col("apex") + 15)).alias("seq")).join(r, ["ride_id", "seq"])
    w = near.groupBy("ride_id", "event").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "step_mm"))), lambda x: x["step_mm"] / 1000.0).alias("window"))
    d = S.dominant_frequency(w, 10.0)
    return d.select("ride_id", "event", F.size("window").cast("long").alias("samples"), F.round("frequency", 6).alias("frequency"))


@query("q_since_last_fix", f""", f AS (SELECT ride_id, seq AS fix, d_mm AS at_mm FROM r WHERE gnss_ok), a AS (SELECT r.ride_id, r.seq, r.d_mm - f.at_mm AS since_mm FROM r ASOF LEFT JOIN f ON r.ride_id = f.ride_id AND r.seq >= f.fix)
SELECT ride_id, seq, since_mm, round(greatest(0.19::DOUBLE * since_mm / 1000, 2) * {math.sqrt(-2 * math.log(1 - 0.9))!r}::DOUBLE, 4) AS radius_m FROM a""")
def since_last_fix(spark, sf_dir):
    """Dead reckoning since the last fix: distance and the radius that holds nine in ten."""
    r = rides(spark, sf_dir)
    a = S.asof(r.select("ride_id", "seq", "d_mm"), r.where("gnss_ok").select("ride_id", "seq", F.col("d_mm").alias("at_mm")), "ride_id", "seq", ["at_mm"])
    since = F.col("d_mm") - F.col("at_mm")
    return a.select("ride_id", "seq", since.alias("since_mm"), F.round(confidence_radius(since / 1000.0), 4).alias("radius_m"))


@query("q_labelled_windows", """, w AS (SELECT ride_id, seq, count(*) OVER c AS n, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER m AS near_hit FROM r WINDOW c AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), m AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT ride_id, seq, near_hit = 1 AS positive FROM w WHERE n = 30 AND seq % 3 = 0""")
def labelled_windows(spark, sf_dir):
    """Thirty-row windows, every third row, positive if a landmark lies at the middle."""
    w = by_ride()
    r = rides(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(w.rowsBetween(-15, 14))).withColumn("positive", F.max(F.col("hit").cast("int")).over(w.rowsBetween(-1, 1)) == 1)
    return r.where("n = 30 and seq % 3 = 0").select("ride_id", "seq", "positive")


@query("q_clean_path_length", CLEAN_SQL + """, st AS (SELECT ride_id, seq, coalesce(abs(x_mm - lag(x_mm) OVER w) + abs(y_mm - lag(y_mm) OVER w), 0) AS step FROM c10 WINDOW w AS (PARTITION BY ride_id ORDER BY seq))
SELECT ride_id, count(*) AS fixes, CAST(sum(step) AS BIGINT) AS block_mm FROM st GROUP BY ride_id""")
def clean_path_length(spark, sf_dir):
    """City-block length of the cleaned track: whole numbers, so that it can be compared to the last digit."""
    w = by_ride()
    c = clean(rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm"), 15000.0)
    step = F.coalesce(F.abs(F.col("x_mm") - F.lag("x_mm").over(w)) + F.abs(F.col("y_mm") - F.lag("y_mm").over(w)), F.lit(0))
    return c.withColumn("step", step).groupBy("ride_id").agg(F.count(F.lit(1)).alias("fixes"), F.sum("step").alias("block_mm"))


@query("q_physics_check", "SELECT ride_id, round(avg(k), 6) AS mean, round(quantile_cont(k, 0.1), 6) AS p10, round(sqrt(avg(dx_mm * dx_mm + dy_mm * dy_mm)), 4) AS rms_mm, max(abs(k - 50)) AS worst FROM r GROUP BY ride_id")
def physics_check(spark, sf_dir):
    g = rides(spark, sf_dir).groupBy("ride_id")
    return g.agg(F.round(F.avg("k"), 6).alias("mean"), F.round(F.percentile("k", 0.1), 6).alias("p10"), F.round(F.sqrt(F.avg(F.col("dx_mm") * F.col("dx_mm") + F.col("dy_mm") * F.col("dy_mm"))), 4).alias("rms_mm"), F.max(F.abs(F.col("k") - 50)).alias("worst"))


@query("q_json_defaults", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.missing'), '-1') AS BIGINT) AS missing, json_exists(props, '$.k') AS has_k FROM events", ctes=False)
def json_defaults(spark, sf_dir):
    from trackloom.sources.rides import table

    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object(p, "$.missing"), F.lit("-1")).cast("long").alias("missing"), F.get_json_object(p, "$.k").isNotNull().alias("has_k"))


@query("q_merged_places", """WITH RECURSIVE pa AS (SELECT lower(p_name) AS name, p_partkey AS place, p_partkey * 7919 % 5000 AS x, p_partkey * 104729 % 5000 AS y, p_size % 7 + 1 AS arrivals FROM part),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY name ORDER BY arrivals DESC, place) AS i FROM pa),
w(name, i, kept) AS (
 SELECT name, 0::BIGINT, CAST([] AS STRUCT(place BIGINT, x BIGINT, y BIGINT)[]) FROM o GROUP BY name
 UNION ALL
 SELECT w.name, o.i, CASE WHEN len(list_filter(kept, lambda q: (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) < 90000)) > 0 THEN kept ELSE list_append(kept, {'place': o.place, 'x': o.x, 'y': o.y}) END FROM w JOIN o ON o.name = w.name AND o.i = w.i + 1),
b AS (SELECT o.name, o.place, arrivals, (list_filter(w.kept, lambda q: (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) < 90000))[1] AS q FROM o JOIN w ON w.name = o.name AND w.i = o.i)
SELECT name, q.place AS place, q.x AS x, q.y AS y, count(DISTINCT member) AS merged, count(DISTINCT node) AS arrivals FROM (SELECT name, q, place AS member, unnest(range(place, place + arrivals)) AS node FROM b) GROUP BY name, q""", ctes=False)
def merged_places(spark, sf_dir):
    """Places of one name within 300 m are one: the entry with most arrivals stays where it is and gets the others' arrivals. Parts stand for places."""
    from trackloom.sources.rides import table

    own = F.col("p_partkey")
    nodes = F.sequence(own, own + F.col("p_size") % 7)
    places = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), own.alias("place"), F.pmod(own * 7919, F.lit(5000)).alias("x"), F.pmod(own * 104729, F.lit(5000)).alias("y"), nodes.alias("arrive"))
    found = merge_places(places, 300)
    return found.select("name", "place", "x", "y", "merged", F.size("arrive").cast("long").alias("arrivals"))


@query("q_clean_distance", CLEAN_SQL + """, sm AS (SELECT ride_id, seq, quantile_cont(x_mm, 0.5) OVER w AS x, quantile_cont(y_mm, 0.5) OVER w AS y FROM c10 WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
st AS (SELECT ride_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS l FROM sm WINDOW w AS (PARTITION BY ride_id ORDER BY seq))
SELECT ride_id, round(coalesce(sum(l), 0), 2) AS distance FROM st GROUP BY ride_id""")
def clean_distances(spark, sf_dir):
    """The length of every ride without spikes, on medians of five."""
    d = clean_distance(rides(spark, sf_dir).select("ride_id", "seq", "x_mm", "y_mm"), 15000.0)
    return d.select("ride_id", F.round("distance", 2).alias("distance"))


@query("q_fix_staircase", """, h AS (SELECT ride_id, seq, max(x_mm) FILTER (WHERE seq % 3 = 0) OVER (PARTITION BY ride_id, seq // 3) AS held FROM r),
f AS (SELECT * FROM (SELECT *, held IS DISTINCT FROM lag(held) OVER (PARTITION BY ride_id ORDER BY seq) AS new FROM h) WHERE new),
lo AS (SELECT h.ride_id, h.seq, f.seq AS t0, f.held AS v0 FROM h ASOF LEFT JOIN f ON h.ride_id = f.ride_id AND h.seq >= f.seq),
hi AS (SELECT lo.*, f.seq AS t1, f.held AS v1 FROM lo ASOF LEFT JOIN f ON lo.ride_id = f.ride_id AND lo.seq <= f.seq)
SELECT ride_id, seq, t0 = seq AS fix, round(CASE WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (seq - t0)::DOUBLE / (t1 - t0) END, 3) AS x FROM hi""")
def fix_staircase(spark, sf_dir):
    """A fix that is held for three seconds, as logs have it: where it is a new one, and the line between those."""
    from pyspark.sql import Window

    r = rides(spark, sf_dir)
    held = F.max(F.when(F.col("seq") % 3 == 0, F.col("x_mm"))).over(Window.partitionBy("ride_id", F.floor(F.col("seq") / 3)))
    h = r.select("ride_id", "seq", held.alias("held"))
    new = S.stairs(h, "held", "ride_id", "seq")
    x = S.interpolate(h.select("ride_id", "seq"), new.where("new").select("ride_id", "seq", "held"), "ride_id", "seq", "held")
    return x.join(new.select("ride_id", "seq", "new"), ["ride_id", "seq"]).select("ride_id", "seq", F.col("new").alias("fix"), F.round("held", 3).alias("x"))
