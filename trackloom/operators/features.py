"""Inertial features: levelling, exponential gravity, windows, and the stream form that keeps a ring of them."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.80665


def level(ax: Column, ay: Column, az: Column, gx: Column, gy: Column, gz: Column) -> dict[str, Column]:
    """Horizontal and vertical part of an acceleration against a gravity estimate (gx, gy, gz), and its total."""
    g = F.sqrt(gx * gx + gy * gy + gz * gz)
    up = (ax * gx + ay * gy + az * gz) / g
    total = F.sqrt(ax * ax + ay * ay + az * az)
    return {"a_v": up, "a_h": F.sqrt(F.greatest(total * total - up * up, F.lit(0.0))), "a": total}


def tilt(mean_acc: np.ndarray) -> np.ndarray:
    """Rotation of rows east, north, down, from a mean acceleration as down: east = reference x down, north = down x east.

    The reference is the first axis, or the second where that lies within about 26 degrees of down. A model that depends on the
    heading of its frame needs this very basis.
    """
    down = np.asarray(mean_acc, float) / max(float(np.linalg.norm(mean_acc)), 1e-9)
    east = np.cross([0.0, 1.0, 0.0] if abs(down[0]) > 0.9 else [1.0, 0.0, 0.0], down)
    east /= max(float(np.linalg.norm(east)), 1e-9)
    return np.stack([east, np.cross(down, east), down])


def tilt_columns(mx: Column, my: Column, mz: Column, v: list[Column]) -> list[Column]:
    """The same as columns: a vector v in east, north, down of a mean acceleration (mx, my, mz)."""
    n = F.greatest(F.sqrt(mx * mx + my * my + mz * mz), F.lit(1e-9))
    dx, dy, dz = mx / n, my / n, mz / n
    second = F.abs(dx) > 0.9
    ex, ey, ez = F.when(second, dz).otherwise(F.lit(0.0)), F.when(second, F.lit(0.0)).otherwise(-dz), F.when(second, -dx).otherwise(dy)
    m = F.greatest(F.sqrt(ex * ex + ey * ey + ez * ez), F.lit(1e-9))
    ex, ey, ez = ex / m, ey / m, ez / m
    north = (dy * ez - dz * ey, dz * ex - dx * ez, dx * ey - dy * ex)
    return [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in ((ex, ey, ez), north, (dx, dy, dz))]


def detector_channels(window: np.ndarray) -> np.ndarray:
    """(T, 3) accelerations -> (T, 4): magnitude less its median and its steps; third axis and length of the other two, less their medians."""
    size, flat = np.linalg.norm(window, axis=1), np.linalg.norm(window[:, :2], axis=1)
    centred = [c - np.median(c) for c in (size, window[:, 2], flat)]
    return np.stack([centred[0], np.diff(centred[0], prepend=centred[0][:1]), centred[1], centred[2]], axis=1)


class Ema:
    """Exponential gravity: weight exp(-1 / (tau * hz)) on what was, from straight down."""

    def __init__(self, tau: float, hz: float):
        self.keep, self.value = math.exp(-1 / (tau * hz)), np.array([0.0, 0.0, GRAVITY])

    def push(self, a: np.ndarray) -> np.ndarray:
        self.value = self.keep * self.value + (1 - self.keep) * a
        return self.value


class SensorGrid:
    """Several sensors on one grid of `hz`, event by event: times from the latest of their first events, each value interpolated.

    A time is due once every sensor has an event at or after it. Of each sensor no more than `keep` seconds before the next time are held.
    """

    def __init__(self, sensors: int, hz: float, keep: float = 1.0):
        self.held: list[deque] = [deque() for _ in range(sensors)]
        self.hz, self.keep, self.start, self.k = hz, keep, None, 0

    @staticmethod
    def _at(events: deque, t: float) -> float:
        before = None
        for s, v in events:
            if s >= t:
                return v if before is None or s == t else before[1] + (v - before[1]) * (t - before[0]) / (s - before[0])
            before = (s, v)
        return before[1]

    def push(self, sensor: int, t: float, value: float) -> list[tuple[float, list[float]]]:
        self.held[sensor].append((t, value))
        if self.start is None:
            if not all(self.held):
                return []
            self.start = max(h[0][0] for h in self.held)
        out = []
        while (due := self.start + self.k / self.hz) <= min(h[-1][0] for h in self.held):
            out.append((due, [self._at(h, due) for h in self.held]))
            self.k += 1
        for h in self.held:
            while len(h) > 2 and h[1][0] <= due - self.keep:
                h.popleft()
        return out


class Estimator:
    """Speed from a stream of features: a full ring, then a model call every half second; a stall or a step back starts anew.

    model: (N, C) features -> metres travelled in the ring. The estimate is fresh for three seconds.
    """

    def __init__(self, model: Callable[[np.ndarray], float], rows: int = 300, hz: float = 10.0, every: float = 0.5, stall: float = 0.5, fresh: float = 3.0):
        self.model, self.ring, self.hz, self.every, self.stall, self.fresh = model, deque(maxlen=rows), hz, every, stall, fresh
        self.last: float | None = None
        self.called, self.calls, self.speed = -math.inf, 0, 0.0

    def push(self, t: float, features: np.ndarray, active: bool = True) -> None:
        if self.last is not None and not 0 <= t - self.last <= self.stall:
            self.ring.clear()
        self.last = t
        self.ring.append(features)
        if active and len(self.ring) == self.ring.maxlen and t - self.called >= self.every - 1e-9:
            self.speed = max(self.model(np.stack(self.ring)) / (self.ring.maxlen / self.hz), 0.0)
            self.called, self.calls = t, self.calls + 1

    def at(self, t: float) -> float | None:
        return self.speed if t - self.called <= self.fresh else None


class Edge:
    """The small device: gravity by Ema at full rate; every k-th sample, less gravity, is kept; a model call a second.

    The model sees the ring in the basis of tilt() at the time of the call: levelled rates, then levelled accelerations. The
    distance since the last fix grows with the speed; before the first fix nothing does.
    """

    def __init__(self, model: Callable[[np.ndarray], float], hz: float = 200.0, model_hz: float = 10.0, rows: int = 300, tau: float = 4.0, every: float = 1.0):
        self.model, self.gravity, self.skip, self.seconds, self.every = model, Ema(tau, hz), max(round(hz / model_hz), 1), rows / model_hz, every
        self.ring, self.n, self.speed, self.since_fix = deque(maxlen=rows), 0, 0.0, 0.0
        self.fixed, self.last, self.called = False, None, -math.inf

    def push(self, t: float, a: np.ndarray, w: np.ndarray) -> None:
        dt, self.last = 0.0 if self.last is None else max(t - self.last, 0.0), t
        g = self.gravity.push(a)
        if self.n % self.skip == 0:
            self.ring.append(np.concatenate([w, a - g]))
        self.n += 1
        self.since_fix += self.speed * dt * self.fixed
        if len(self.ring) == self.ring.maxlen and t - self.called >= self.every:
            rows, r = np.stack(self.ring), tilt(g)
            features = np.concatenate([rows[:, :3] @ r.T, rows[:, 3:] @ r.T], axis=1).astype(np.float32)
            self.speed, self.called = max(float(self.model(features)) / self.seconds, 0.0), t

    def fix(self, speed: float | None = None) -> None:
        self.fixed, self.since_fix = True, 0.0
        self.speed = self.speed if speed is None else speed


class FeatureStream:
    """What a phone feeds the speed model: three sensors' events to one grid, levelled by trailing means, the latest rows in a ring.

    Levelled by the gravity sensor's mean ("gravity"), or by the mean of acceleration with one g added back along its own mean ("replica").
    Six channels: rates, then accelerations, in east, north, down. No more than `keep` seconds of events, `trail` and `rows` rows are held.
    """

    ACC, GYRO, GRAV = 0, 1, 2

    def __init__(self, frame: str = "replica", hz: float = 10.0, rows: int = 300, trail: int = 81):
        if frame not in ("replica", "gravity"):
            raise ValueError("frame is replica or gravity")
        self.frame, self.grid = frame, SensorGrid(3, hz)
        self.acc, self.raw, self.ring = deque(maxlen=trail), deque(maxlen=trail), deque(maxlen=rows)

    def push(self, sensor: int, t: float, v: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The rows that this event completes."""
        return [(due, self._level(*values)) for due, values in self.grid.push(sensor, t, np.asarray(v, float))]

    def _level(self, a: np.ndarray, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        if self.frame == "gravity":
            self.raw.append(g)
        else:
            self.acc.append(a)
            mean = np.mean(self.acc, axis=0)
            self.raw.append(a + mean / max(float(np.linalg.norm(mean)), 1e-6) * GRAVITY)
        r = tilt(np.mean(self.raw, axis=0))
        row = np.concatenate([r @ w, r @ a])
        self.ring.append(row)
        return row

    def window(self, mean: np.ndarray, std: np.ndarray) -> np.ndarray | None:
        """The full ring, normalised, channel first; None until it is full."""
        return None if len(self.ring) < self.ring.maxlen else ((np.stack(self.ring) - mean) / std).T.astype(np.float32)
