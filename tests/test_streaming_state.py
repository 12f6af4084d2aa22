"""Typed state, files with each row once, the stored map, and progress."""

import glob
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import fold as D
from trackloom.operators import healing as Z
from trackloom.operators.features import GRAVITY, FeatureStream, tilt
from trackloom.streaming import features as SF
from trackloom.streaming import store as ST


def events(seconds=14):
    """Three sensors of two rides, at rates and with offsets of their own."""
    rng = np.random.default_rng(4)
    out = []
    for ride in (1, 2):
        for sensor, (rate, first) in enumerate(((20, 0.01), (17, 0.03), (9, 0.05))):
            t = first + np.arange(int(seconds * rate)) / rate
            v = rng.normal(0, 1, (len(t), 3)) + ([0, 0, 9.8] if sensor == 2 else [0.3, 0.1, 0])
            out += [(ride, sensor, float(a), *map(float, b)) for a, b in zip(t, v)]
    return sorted(out, key=lambda r: (r[2], r[1]))


SCHEMA = "ride_id long, sensor int, t double, x double, y double, z double"


def plain(rows, frame, hz=10.0, trail=81):
    """The definition with numpy's interpolation, ride by ride."""
    out = {}
    for ride in {r[0] for r in rows}:
        s = [np.array([r[2:] for r in rows if r[0] == ride and r[1] == k]) for k in range(3)]
        start, end = max(x[0, 0] for x in s), min(x[-1, 0] for x in s)
        k = np.arange(int((end - start) * hz) + 2)
        t = start + k / hz
        t = t[t <= end]
        a, w, g = ([np.interp(t, x[:, 0], x[:, c]) for c in (1, 2, 3)] for x in s)
        a, w, g = (np.stack(x, axis=1) for x in (a, w, g))
        mean = lambda v, i: v[max(0, i - trail + 1) : i + 1].mean(0)
        raw = np.stack([a[i] + mean(a, i) / max(np.linalg.norm(mean(a, i)), 1e-6) * GRAVITY for i in range(len(t))]) if frame == "replica" else g
        for i, due in enumerate(t):
            r = tilt(mean(raw, i))
            out[ride, round(due, 6)] = (min(i + 1, 60), *(r @ w[i]), *(r @ a[i]))
    return out


def near(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-9), k


@pytest.mark.parametrize("frame", ["replica", "gravity"])
def test_features_stream_equals_the_definition(spark, tmp_path, frame):
    """In batches that cut rides anywhere, events arriving in order."""
    rows = events()
    source = str(tmp_path / "events")
    for lo in range(0, len(rows), 400):
        spark.createDataFrame(rows[lo : lo + 400], SCHEMA).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SF.PROVIDER)
    try:
        stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        name = f"features_{frame}"
        q = SF.features(stream, frame, rows=60).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
        got = {(r["ride_id"], round(r["t"], 6)): (r["filled"], *(r[f"f{i}"] for i in range(6))) for r in spark.table(name).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    near(got, plain(rows, frame))
    # the batch form
    step = lambda f, r: [{"t": t, "filled": len(f.ring), "v": v.tolist()} for t, v in f.push(r["sensor"], r["t"], np.array([r["x"], r["y"], r["z"]]))]
    batch = D.fold(spark.createDataFrame(rows, SCHEMA), "ride_id", ["t", "sensor"], lambda: FeatureStream(frame, rows=60), step, "ride_id long, t double, filled int, v array<double>")
    near({(r["ride_id"], round(r["t"], 6)): (r["filled"], *r["v"]) for r in batch.collect()}, plain(rows, frame))


def test_recorder_has_each_row_once_over_a_restart(spark, tmp_path):
    source, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))

    def come(lo, hi):
        rows = [(10**9 * i, float(i), 0.1 * i, 0.2, 0.3) for i in range(lo, hi)]
        spark.createDataFrame(rows, ST.SENSOR_LOG).repartition(3).write.mode("append").option("header", True).csv(source)

    def run():
        q = ST.record(ST.live_log(spark, source, files_a_batch=2), out, at, every=None)
        assert q.awaitTermination(120)
        return q

    come(0, 100)
    run()
    come(100, 160)
    # a batch that died: its files are there, its entry in the log of whole batches isn't
    q = run()
    with open(glob.glob(f"{out}/part-*.csv")[0]) as f:
        lines = f.read()
    with open(f"{out}/part-dead.csv", "w") as f:
        f.write(lines)
    run()
    got = spark.read.schema(ST.SENSOR_LOG + ", file string").option("header", True).csv(out)
    assert sorted(r["seconds_elapsed"] for r in got.collect()) == [float(i) for i in range(160)]
    assert q.lastProgress is None or q.lastProgress["numInputRows"] >= 0


def reference_map(runs, cluster=12.0, corridor=25.0, limit=3):
    """One list of candidates, every one looked at."""
    cands = []
    for run in sorted(runs):
        for x, y, kind in [(x, y, k) for _, x, y, k in sorted(runs[run]) if k]:
            d = [(np.hypot(c["x"] - x, c["y"] - y), i) for i, c in enumerate(cands)]
            if d and min(d)[0] <= cluster:
                c = cands[min(d)[1]]
                w = c["n"] / (c["n"] + 1)
                c.update(x=c["x"] * w + x * (1 - w), y=c["y"] * w + y * (1 - w), n=c["n"] + 1)
                c["runs"].add(run)
                c["kinds"].append(kind)
            else:
                cands.append({"x": x, "y": y, "n": 1, "runs": {run}, "kinds": [kind], "misses": 0})
        for c in list(cands):
            if run not in c["runs"] and min(np.hypot(c["x"] - x, c["y"] - y) for _, x, y, _ in runs[run]) <= corridor:
                c["misses"] += 1
                if c["misses"] >= limit:
                    cands.remove(c)
    return sorted((round(c["x"], 6), round(c["y"], 6), c["n"], len(c["runs"]), c["misses"], max(sorted(set(c["kinds"])), key=c["kinds"].count)) for c in cands)


def hits(seed, runs):
    rng = random.Random(seed)
    marks = [(rng.uniform(100, 900), rng.uniform(100, 900)) for _ in range(40)]
    out = {}
    for r in range(runs):
        rows = []
        for t, (x, y) in enumerate(marks):
            seen = rng.random() < 0.6
            rows.append((float(t), x + rng.gauss(0, 3), y + rng.gauss(0, 3), rng.choice(["bump", "bump", "hump"]) if seen else None))
        out[f"r{r:02d}"] = rows
    return out


def shown(df):
    return sorted((round(r["x"], 6), round(r["y"], 6), r["n"], r["runs"], r["misses"], r["kind"]) for r in Z.published(df, 1).collect())


def test_stored_map_equals_one_list_and_bears_repeats(spark, tmp_path):
    runs = hits(1, 9)
    source, store = str(tmp_path / "runs"), ST.MapStore(spark, f"file://{tmp_path}/map")
    rows = lambda names: spark.createDataFrame([(n, *r) for n in names for r in runs[n]], "run string, t double, x double, y double, kind string")
    names = sorted(runs)
    for part in (names[:4], names[4:5], names[5:]):
        rows(part).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
        q = ST.keep_map(spark.readStream.schema(rows(names[:1]).schema).parquet(source), store, str(tmp_path / "at"), size=5000.0)
        assert q.awaitTermination(200)
    assert store.versions() == [0, 1, 2]
    want = shown(store.read())
    assert want == reference_map(runs)
    store.update(rows(names[5:]), 2, size=5000.0)  # Spark repeats a batch
    assert shown(store.read()) == want and store.versions() == [0, 1, 2]


def test_ways_are_told_to_areas_they_come_near(spark):
    """A candidate just beyond the border of an area fades by runs on the other side."""
    hit = spark.createDataFrame([("a", 0.0, 101.0, 50.0, "bump")], "run string, t double, x double, y double, kind string")
    ways = spark.createDataFrame([("a", 0.0, 101.0, 50.0), ("b", 0.0, 90.0, 50.0), ("c", 0.0, 60.0, 50.0)], "run string, t double, x double, y double")
    assert [r["misses"] for r in Z.heal(None, hit, ways, size=100.0).collect()] == [1]


def test_progress_and_report(spark, tmp_path):
    source = str(tmp_path / "rides")
    spark.range(200).select((F.col("id") % 4).alias("ride_id"), (F.col("id") / 4).cast("long").alias("seq")).repartition(2).write.parquet(source)
    log = ST.ProgressLog()
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("ride_id long, seq long").parquet(source)
        q = stream.groupBy("ride_id").count().writeStream.queryName("edge").format("memory").outputMode("complete").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        end = time.time() + 20
        while not log.rows.get("edge") and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert sum(r["rows"] for r in log.frame(spark).collect()) == 200
    rides = spark.createDataFrame([("edge", i, 50) for i in range(4)], "name string, ride_id long, samples long")
    drift = spark.createDataFrame([("edge", i, float(i)) for i in range(4)], "name string, ride_id long, drift_pct double")
    r = ST.stream_report(log.frame(spark), rides, drift, 1.0).collect()
    assert len(r) == 1 and r[0]["rides"] == 4 and r[0]["median_drift"] == 1.5 and r[0]["times_real_time"] > 0
