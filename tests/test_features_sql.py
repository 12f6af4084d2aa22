"""Spectra and scales against definitions."""

import cmath
import math
import random

import numpy as np

from trackloom.operators import series as S
from trackloom.operators.matching import ByScale


def test_dominant_frequency_equals_a_direct_transform(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) + 2 * math.sin(j * rng.uniform(0.4, 0.5)) for j in range(rng.randint(1, 40))]) for i in range(60)] + [(90, []), (91, None), (92, [1.0] * 12)]
    got = {r["id"]: r["frequency"] for r in S.dominant_frequency(spark.createDataFrame(rows, "id int, window array<double>"), 20.0).collect()}
    for i, w in rows[:60]:
        n = len(w)
        band = [k for k in range(1, n // 2 + 1) if k * 20 > n and 2 * k < n]
        if n < 8 or not band:
            assert got[i] is None
            continue
        mean = sum(w) / n
        tapered = [(x - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * j / (n - 1))) for j, x in enumerate(w)]
        loud = {k: abs(sum(x * cmath.exp(-2j * math.pi * k * j / n) for j, x in enumerate(tapered))) for k in band}
        assert math.isclose(got[i], max(band, key=loud.get) * 20 / n)
    assert got[90] is None and got[91] is None and got[92] is not None


def test_half_width(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 4, 6, 10, 8, 5, 4, 9, 1])], "k int, i int, v int")
    events = spark.createDataFrame([(1, 7, 1, 7, 3, 10)], "k int, event int, t0 int, t1 int, apex int, peak int")
    assert [r["width"] for r in S.half_width(rows, events, "k", "i", "v").collect()] == [4]  # 6, 10, 8, 5


def test_scale_is_the_least_squares_one():
    """Marks 50 m apart, seen 8 per cent too far along: the scale is found, and is that of all pairs."""
    marks = [20.0 + 50 * i for i in range(30)]
    rng = random.Random(2)
    seen = [m * 1.08 + rng.gauss(0, 1) for m in marks]
    f = ByScale(marks)
    for s in seen:
        f.step(s)
    assert f.held == 30 and abs(f.k - 1 / 1.08) < 0.01
    k, b = np.linalg.lstsq(np.column_stack([seen, np.ones(30)]), np.array(marks), rcond=None)[0]
    assert math.isclose(f.k, k, rel_tol=1e-9) and math.isclose(f.b, b, rel_tol=1e-6)
    # a scale that is too far from 1 is not believed
    g = ByScale([0.0, 100.0], growth=9.0)
    g.step(1.0)
    g.step(40.0)
    assert g.k == 1.0 and g.held == 2


def test_sweep_is_a_filter_for_each_noise():
    from trackloom.operators.fusion import Fleet, Noise
    from trackloom.plans.folds import SWEEP, Sweep

    rng = np.random.default_rng(4)
    sweep, alone = Sweep(), [Fleet(Noise(accel=a, yaw_rate=y)) for a, y in SWEEP]
    n, rides = len(SWEEP), 2
    at = np.arange(n * rides)
    for t in range(12):
        one = {"x_mm": rng.normal(0, 5000, rides), "y_mm": rng.normal(0, 5000, rides), "value": rng.uniform(0, 90, rides), "k": rng.integers(40, 60, rides).astype(float), "head_deg": rng.uniform(-90, 90, rides), "seen": np.array([t < 5, t % 2 == 0], float)}
        row = {k: np.tile(v, n) for k, v in one.items()} | {"v": np.repeat(np.arange(n), rides).astype(float)}
        got = sweep.step(at, row, np.full(len(at), t == 0))
        for k, fleet in enumerate(alone):
            xy, none = np.stack([one["x_mm"], one["y_mm"]], axis=1) / 1000, np.full(rides, np.nan)
            if t == 0:
                fleet.add(xy[:, 0], xy[:, 1], one["value"] / 10, np.radians(one["head_deg"]))
            else:
                fleet.step(np.arange(rides), 1.0, np.radians(one["k"] - 50), np.zeros(rides), np.where(one["seen"].astype(bool)[:, None], xy, np.nan), none, one["value"] / 10, np.stack([none, none], axis=1), none, np.stack([none, none], axis=1))
            assert np.allclose(got["x"][k * rides : (k + 1) * rides], fleet.x[:, 0]) and np.allclose(got["sigma"][k * rides : (k + 1) * rides], fleet.sigma(np.arange(rides)))


def test_traces_leave_out_what_cannot_be_read(spark):
    """A log that steps back, one that is too short, one whose time stands still, one in milliseconds."""
    from trackloom.sources import files as L

    def log(key, times, scale=1.0):
        return [(key, i, t * scale, 1.0, 0.0, 0.0, 0.1, 0.0, 0.0, 15.0 + i // 3 * 1e-5, 75.0) for i, t in enumerate(times)]

    rows = log("back", [0, 1, 2, 3, 2.5, 4, 5, 6]) + log("short", [0, 1, 2]) + log("still", [5] * 8) + log("ms", range(8), 1000.0)
    kinds = "key string, n long, t double, ax double, ay double, az double, gx double, gy double, gz double, lat double, lon double"
    got = L.traces(spark.createDataFrame(rows, kinds), "key", "n", hz=2.0, least=5)
    by = {}
    for r in got.collect():
        by.setdefault(r["key"], []).append(r["t"])
    assert set(by) == {"back", "ms"} and sorted(by["ms"]) == [i / 2 for i in range(14)] and sorted(by["back"]) == [i / 2 for i in range(12)]
    import pytest

    with pytest.raises(ValueError, match="no column"):
        L.adhoc_log(spark.createDataFrame([(1, 1.0)], "key int, t double"), "key")
