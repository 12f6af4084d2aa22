"""State machines by script, and folds of them against plain loops."""

import math

import numpy as np
import pytest

from trackloom.operators import fold as D
from trackloom.operators import graph as G
from trackloom.operators.fusion import Dot, Fusion
from trackloom.operators.matching import Costs, Online, align, correct_by_marks


def run_switch(script, until, sats=9):
    """script: t -> accuracy of a fix, at 10 ticks a second; changes as (t, mode)."""
    s, changes, before = D.GnssSwitch(), [], "GNSS"
    for i in range(int(until * 10) + 1):
        t = i / 10
        n = sats(t) if callable(sats) else sats
        if n is not None:
            s.satellites(t, n)
        if t in script:
            s.fix(t, script[t])
        s.tick(t)
        if s.mode != before:
            changes.append((t, s.mode))
            before = s.mode
    return s, changes


def every_second(a, b, accuracy=5.0):
    return {float(t): accuracy for t in range(a, b)}


def test_switch_stays():
    assert run_switch(every_second(0, 31), 30)[1] == []


def test_switch_tunnel_and_back():
    s, c = run_switch(every_second(0, 10), 20)
    assert c == [(11.6, "DEAD_RECKONING")]
    s, c = run_switch(every_second(0, 10) | {20.0: 5.0, 21.0: 5.0}, 22)
    assert c == [(11.6, "DEAD_RECKONING"), (21.0, "GNSS")]


def test_switch_satellites():
    assert run_switch(every_second(0, 31), 30, sats=0)[1] == []
    assert run_switch(every_second(0, 21), 20, sats=lambda t: 9 if t < 10 else 3)[1] == [(11.0, "DEAD_RECKONING")]


def test_switch_coarse():
    assert run_switch({0.0: 5.0, 1.0: 45.0}, 2)[1] == []
    assert run_switch({0.0: 5.0, 1.0: 150.0}, 2)[1] == [(1.0, "DEAD_RECKONING")]


def test_switch_flicker():
    fixes = every_second(0, 10) | {float(t): 5.0 for t in range(20, 40, 2)}
    assert len(run_switch(fixes, 40)[1]) == 1


def test_switch_simulated():
    s = D.GnssSwitch()
    s.fix(0.0, 5.0)
    s.simulate(True)
    assert s.mode == "DEAD_RECKONING" and s.switches == 1
    s.tick(10.0)
    s.simulate(False)
    assert s.mode == "DEAD_RECKONING"
    s.fix(20.0, 5.0)
    s.fix(21.0, 5.0)
    assert s.mode == "GNSS" and s.switches == 2


@pytest.mark.parametrize(
    "steps, verdicts",
    [
        ([(0, 0, 240), (0, 1, 0), (8, 2, 0)], ["STALE", "ACCEPT", "ACCEPT"]),
        ([(0, 0, 0), (900, 1, 0), (16, 2, 0)], ["ACCEPT", "GLITCH", "ACCEPT"]),
        ([(99999, 0, 0), (0, 1, 0), (8, 2, 0), (16, 3, 0), (24, 4, 0)], ["ACCEPT", "GLITCH", "GLITCH", "NEW_TRACK", "ACCEPT"]),
        ([(0, 0, 0), (300, 60, 0), (308, 61, 0)], ["ACCEPT", "NEW_TRACK", "ACCEPT"]),
    ],
)
def test_fix_filter(steps, verdicts):
    f = D.FixFilter()
    assert [f.check((float(x), 0.0), float(t), float(age)) for x, t, age in steps] == verdicts


def test_off_route():
    o = D.OffRoute()
    assert [o.fix(d, 5) for d in (58, 58, 58, 58, 58, 10, 60, 60)] == [False] * 7 + [True]
    o = D.OffRoute()
    assert [o.fix(d, 5) for d in (0, 60, 10, 60, 55)] == [False] * 4 + [True]
    o = D.OffRoute()
    assert [o.fix(d, a) for d, a in ((0, 5), (60, 80), (60, 80))] == [False] * 3


def test_speaker_says_each_once():
    s = D.Speaker([200.0], 400.0)
    assert [x for x in (s.at(float(d)) for d in range(0, 401, 5)) if x] == ["far 0", "now 0", "arrived"]


def test_gyro_bias():
    b = D.GyroBias()
    for _ in range(149):
        b.observe((0.005, 0, 0), True)
    assert not b.ready
    b.observe((0.2, 0, 0), True)
    b.observe((0.005, 0, 0), True)
    assert b.ready and math.isclose(b.bias[0], 0.005)
    b = D.GyroBias()
    for _ in range(200):
        b.observe((0.04, 0, 0), True)
    assert not b.ready


def test_crowd():
    c = D.Crowd()
    assert [c.observe(xy, r) for xy, r in (((0, 0), 1), ((10, 0), 2), ((40, 0), 1), ((12, 0), 2))] == [0, 0, 1, 0]
    assert c.candidates[0]["n"] == 3 and math.isclose(c.candidates[0]["xy"][0], 22 / 3)
    for run in (7, 8):
        assert c.decay(run, [(41, 0)]) == 0
    assert c.decay(9, [(41, 0)]) == 1 and len(c.candidates) == 1


def plain_align(det, marks, c):
    """The table entry by entry."""
    n, m = len(det), len(marks)
    best = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                options = []
                if i:
                    options.append(best[i - 1, j] + c.skip_detection)
                if j:
                    options.append(best[i, j - 1] + c.skip_mark)
                if i and j and abs(det[i - 1] - marks[j - 1]) <= c.gate:
                    options.append(best[i - 1, j - 1] + ((det[i - 1] - marks[j - 1]) / c.sigma) ** 2)
                best[i, j] = min(options)
    return best[n, m]


def test_align_is_optimal():
    rng, c = np.random.default_rng(3), Costs()
    for _ in range(40):
        det, marks = sorted(rng.uniform(0, 500, rng.integers(1, 9)).tolist()), sorted(rng.uniform(0, 500, rng.integers(1, 9)).tolist())
        got = align(det, marks, costs=c)
        used = [j for j in got if j >= 0]
        assert used == sorted(set(used))
        cost = sum(((d - marks[j]) / c.sigma) ** 2 if j >= 0 else c.skip_detection for d, j in zip(det, got)) + c.skip_mark * (len(marks) - len(used))
        assert math.isclose(cost, plain_align(det, marks, c), abs_tol=1e-9)


def test_online_is_monotone():
    m = Online([10.0, 60.0, 110.0])
    assert [m.match(s) for s in (12.0, 15.0, 300.0, 105.0, 111.0)] == [0, 1, -1, 2, -1]


def test_marks_correct_a_scaled_ride():
    marks = [50.0 * i for i in range(1, 12)]
    out, held, refused = correct_by_marks([1.05 * m for m in marks], marks)
    assert held == 11 and refused == 0 and abs(out[-1] - marks[-1]) < 10 < 1.05 * marks[-1] - marks[-1]
    assert correct_by_marks([10.0, 700.0], marks)[1] < 2


def test_filter_is_sound():
    f, rng = Fusion(0, 0, 10, 0.0), np.random.default_rng(1)
    for i in range(1, 300):
        fix = (i * 1.0 + rng.normal(0, 2), rng.normal(0, 2)) if i < 100 or i > 200 else None
        f.step(0.1, 0.0, 0.0, fix=fix, model_speed=10.0, road=(0.0, 0.0) if fix is None else None, road_heading=0.0 if fix is None else None)
        assert np.allclose(f.P, f.P.T) and np.linalg.eigvalsh(f.P).min() > 0
        assert f.mode == ("GNSS_AIDED" if fix else "DEAD_RECKONING") and f.epochs_without == (0 if fix else i - 99)
    assert abs(f.x[0] - 299) < 8 and abs(f.x[1]) < 4


def test_scale_state_learns():
    f = Fusion(0, 0, 10, 0.0, with_scale=True)
    for i in range(1, 400):
        f.step(0.1, 0.0, 0.0, fix=(i * 1.0, 0.0), fix_speed=10.0, model_speed=8.0)
    assert 1.1 < f.x[5] < 1.4
    f = Fusion(0, 0, 10, 0.0)
    f.step(0.1, 0.0, 0.0, landmark=(1.0, 0.0))
    assert f.mode == "DR_LANDMARK" and f.epochs_without == 0


def test_dot_never_jumps():
    d = Dot()
    d.follow((0, 0), 0.1)
    x = [d.follow((100, 0), 0.1)[0] for _ in range(300)]
    assert max(b - a for a, b in zip([0, *x], x)) <= 2.5 + 1e-9 and x[-1] == 100


def test_network_search():
    net = G.Network([(0, 1, 5.0), (1, 2, 5.0), (0, 2, 11.0), (2, 3, 1.0)])
    assert net.search({0: 0.0}, {3}) == ([0, 1, 2, 3], 11.0) and net.search({3: 0.0}, {0}) is None
    assert net.search({0: 0.0, 2: 2.0}, {3}) == ([2, 3], 3.0)


def test_straightest_and_maneuvers():
    xy = {0: (0, 0), 1: (10, 0), 2: (20, 1), 3: (10, 10), 4: (30, 2)}
    net = G.Network([(0, 1, 1), (1, 2, 1), (1, 3, 1), (2, 4, 1), (1, 0, 1)])
    assert net.straightest(xy, 0, 1, 30) == [0, 1, 2, 4]
    route = [(0.0, 0.0), (0.0, 200.0), (-200.0, 200.0)]
    assert [(round(s), round(a)) for s, a in G.maneuvers(route, [1, 3, 1])] == [(200, 90)] and G.maneuvers(route, [1, 2, 1]) == []


def test_fold_starts_anew_with_each_key(spark):
    df = spark.createDataFrame([(k, i, 1) for k in range(7) for i in range(50)], "key long, i long, v long")

    class Sum:
        total = 0

    def step(s, row):
        s.total += row["v"]
        return {"i": row["i"], "run": s.total}

    got = D.fold(df, "key", ["i"], Sum, step, "key long, i long, run long", lambda s, k: [{"i": -1, "run": s.total}]).collect()
    assert all(r["run"] == (50 if r["i"] < 0 else r["i"] + 1) for r in got) and len(got) == 7 * 51


def test_fleet_is_many_filters(spark):
    """The query's rides, filtered at once, against a filter for each ride, row by row."""
    import trackloom.queries as core
    from trackloom.sources.rides import rides

    sf = "/root/testdata/sf0.001"
    for name, with_scale in (("q_ekf5", False), ("q_ekf6", True)):
        got = {(r["ride_id"], r["seq"]): r for r in core.queries()[name](spark, sf).collect()}
        filters, dots = {}, {}
        for r in rides(spark, sf).orderBy("ride_id", "seq").collect():
            xy, speed, ride = (r["x_mm"] / 1000, r["y_mm"] / 1000), r["value"] / 10, r["ride_id"]
            if ride not in filters:
                filters[ride], dots[ride] = Fusion(*xy, speed, 0.0, with_scale=with_scale), Dot()
            else:
                on = with_scale and r["seq"] % 20 == 0
                filters[ride].step(1.0, math.radians(r["k"] - 50), 0.0, fix=xy if r["gnss_ok"] else None, model_speed=speed, road=xy if on else None, road_heading=math.radians(r["head_deg"]) if on else None)
            f, g = filters[ride], got[ride, r["seq"]]
            shown = dots[ride].follow(tuple(f.x[:2]), 1.0)
            assert np.allclose([g["x"], g["y"], g["speed"], g["heading"], g["sigma"], g["dot_x"], g["dot_y"]], [*f.x[:4], f.sigma, *shown]) and g["mode"] == f.mode


def test_lockstep_takes_repeated_rows_one_by_one(spark):
    rows = [(k, t, float(v)) for k, t, v in [(1, 0, 1), (1, 1, 2), (1, 1, 3), (2, 1, 10), (2, 1, 20), (2, 1, 30), (1, 2, 4)]]

    class Sums:
        def __init__(self):
            self.sum = np.zeros(0)

    def step(f, at, row, new):
        f.sum = np.append(f.sum, np.zeros(new.sum()))
        assert len(set(at.tolist())) == len(at)
        f.sum[at] += row["v"]
        return {"total": f.sum[at]}

    d = D.lockstep(spark.createDataFrame(rows, "k long, t long, v double"), "k", "t", Sums, step, "k long, t long, total double")
    got = sorted(map(tuple, d.collect()))
    assert [g for g in got if g[0] == 1][0] == (1, 0, 1.0) and got[-1] == (2, 1, 60.0) and (1, 2, 10.0) in got and len(got) == 7
