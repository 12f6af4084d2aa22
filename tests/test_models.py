"""Beam search on roads, features, learned speed."""

import math

import numpy as np

from trackloom.operators import features as X
from trackloom.operators import hmm as H
from trackloom.operators.learn import leave_one_out, window_features


def grid_roads(n=5, d=100.0):
    at = lambda i, j: (i * d, j * d)
    edges = []
    for i in range(n):
        for j in range(n):
            if i + 1 < n:
                edges.append(H.Edge(i * n + j, (i + 1) * n + j, (at(i, j), at(i + 1, j))))
            if j + 1 < n:
                edges.append(H.Edge(i * n + j, i * n + j + 1, (at(i, j), at(i, j + 1))))
    return H.Roads(edges)


def test_follow_takes_the_turn():
    obs = [(10.0, 0.0)] * 19 + [(10.0, 90.0)] + [(10.0, 0.0)] * 12
    roads = grid_roads()
    path, edges = H.follow(roads, (9.0, 0.0), obs)
    assert len(path) == len(edges) == len(obs) + 1
    assert math.dist(path[15], (160.0, 0.0)) < 1 and math.dist(path[-1], (200.0, 130.0)) < 25 and roads.junctions(edges) == 3


def test_follow_nowhere_near():
    assert H.follow(grid_roads(), (9999.0, 0.0), [(10.0, 0.0)]) == ([], [])


def test_follow_costs_by_hand():
    """A straight road with a side street: staying costs nothing, entering another edge 8, a turn (90 / 22)^2."""
    roads = H.Roads([H.Edge(0, 1, ((0.0, 0.0), (100.0, 0.0))), H.Edge(1, 2, ((100.0, 0.0), (200.0, 0.0))), H.Edge(1, 3, ((100.0, 0.0), (100.0, 100.0)))])
    assert roads.near((0.0, 20.0)) == [(0, 0.0, 20.0), (3, 100.0, 20.0)]
    assert roads.onward(0, 95.0, 10.0) == [(1, 5.0), (2, 5.0)] and roads.onward(0, 90.0, 10.0) == [(0, 100.0)] and roads.onward(1, 95.0, 10.0) == []
    assert H.follow(roads, (90.0, 0.0), [(20.0, 90.0)])[0][-1] == (100.0, 10.0)
    # which way the ride faces isn't known: back along the same edge needs no fee
    assert H.follow(roads, (90.0, 0.0), [(20.0, 40.0)])[0][-1] == (70.0, 0.0)


def test_rebind():
    xy = {0: (0, 0), 1: (100, 0), 2: (200, 0), 3: (100, 100), 4: (100, -100), 5: (300, 0), 6: (200, 100)}
    n = {1: [0, 2, 3, 4], 2: [1, 5, 6]}
    assert H.rebind(xy, n, [0, 1, 2, 5], (50, 150), 80.0) == (1, 3)
    assert H.rebind(xy, n, [0, 1, 2, 5], (50, 150), -95.0) == (1, 4)
    assert H.rebind(xy, n, [0, 1, 2, 5], (50, 250), 90.0) == (2, 6)
    assert H.rebind(xy, n, [0, 1, 2, 5], (120, 150), 90.0) is None


def test_tilt_levels(spark):
    from pyspark.sql import functions as F

    for v in ((0.3, -2.0, 9.0), (9.7, 0.1, 0.2)):
        r = X.tilt(np.array(v))
        assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(r @ np.array(v), [0, 0, np.linalg.norm(v)]) and np.linalg.det(r) > 0
        got = spark.range(1).select(*[c.alias(n) for n, c in zip("end", X.tilt_columns(*[F.lit(x) for x in v], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]))]).first()
        assert np.allclose(list(got), r @ np.array([1.0, 2.0, 3.0]))
    # flat on the table, third axis up: east = x cross down = -y
    assert np.allclose(X.tilt(np.array([0.0, 0.0, 9.8])), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    # first axis down: the second is the reference
    assert np.allclose(X.tilt(np.array([9.8, 0.0, 0.0])), [[0, 0, -1], [0, 1, 0], [1, 0, 0]])


def test_detector_channels():
    c = X.detector_channels(np.tile([0.0, 0.0, 9.8], (30, 1)))
    assert c.shape == (30, 4) and np.allclose(c, 0)
    w = np.array([[3.0, 4.0, 0.0], [0.0, 0.0, 2.0], [6.0, 8.0, 1.0]])
    size = np.array([5.0, 2.0, 101**0.5])
    want = np.stack([size - 5, [0, -3, 101**0.5 - 2], [-1, 1, 0], [0, -5, 5]], axis=1)
    assert np.allclose(X.detector_channels(w), want)


def test_estimator_cadence():
    e = X.Estimator(lambda w: 30.0 * 5)
    for i in range(2500):  # 50 Hz for 50 s
        if i % 5 == 0:
            e.push(i / 50, np.zeros(3), active=40 <= i / 50)
    assert 19 <= e.calls <= 21 and e.speed == 5.0 and e.at(60.0) is None
    e = X.Estimator(lambda w: 1.0)
    for i in range(200):
        e.push(i / 10, np.zeros(3))
    assert e.calls == 0
    for i in range(200, 320):
        e.push(i / 10, np.zeros(3))
    assert e.calls > 0
    calls = e.calls
    e.push(60.0, np.zeros(3))
    assert e.calls == calls and len(e.ring) == 1


def test_edge_engine():
    seen = []
    e = X.Edge(lambda w: seen.append(w) or 30.0 * 2)
    for i in range(200 * 40):
        e.push(i / 200, np.array([0.0, 0.0, 9.81]), np.array([0.1, 0.0, 0.2]))
        if i == 0:
            assert e.since_fix == 0
            e.fix()
    assert 19 < e.since_fix < 21 and abs(np.linalg.norm(e.gravity.value) - 9.81) < 0.01 and 10 <= len(seen) <= 11
    # rates in east, north, down, then accelerations without gravity
    assert seen[-1].shape == (300, 6) and np.allclose(seen[-1][-1], [0, 0.1, 0.2, 0, 0, 0], atol=1e-3)
    e.fix()
    assert e.since_fix == 0


def test_learned_speed_beats_the_mean(spark):
    rng = np.random.default_rng(0)
    rows = []
    for ride in range(4):
        for _ in range(40):
            v = rng.uniform(1, 15)
            rows.append((ride, [float(x) for x in v + rng.normal(0, 0.3, 20)], float(v * 20)))
    f = window_features(spark.createDataFrame(rows, "ride_id long, window array<double>, label double"))
    for r in leave_one_out(f, [0, 3]):
        assert r["error"] < 0.2 * r["by_mean"]
