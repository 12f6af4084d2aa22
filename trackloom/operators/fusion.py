"""Fusion of satellites, inertial sensors, speed models, landmarks and roads in one extended Kalman filter.

The state is x, y, speed, heading, gyro bias and, if wanted, a speed scale. Speed always points along the heading, so there is
nothing for a lateral constraint to add. A road is measured across only: along it, nothing is known.

All rides of a task are filtered at once: Fleet holds their states as arrays and takes one epoch of many of them in a call. What a
ride has no measurement of is NaN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Noise:
    accel: float = 1.2
    yaw_rate: float = 0.35
    bias: float = 1e-5
    scale: float = 1e-3
    position: float = 4.0
    speed: float = 1.0
    model_speed: float = 3.5
    landmark: float = 4.0
    road_cross: float = 2.5
    road_heading: float = 0.05


class Fleet:
    """Filters of many rides: x (n, size), P (n, size, size), without_fix (epochs), mode (0 aided, 1 dead reckoning, 2 at a landmark)."""

    MODES = ("GNSS_AIDED", "DEAD_RECKONING", "DR_LANDMARK")

    def __init__(self, noise: Noise = Noise(), with_scale: bool = False):
        self.noise, self.size = noise, 6 if with_scale else 5
        self.x, self.P = np.zeros((0, self.size)), np.zeros((0, self.size, self.size))
        self.without_fix, self.mode = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, x, y, speed, heading) -> np.ndarray:
        """Begins rides; their places in the arrays."""
        n, old = len(x), len(self.x)
        state = np.stack([x, y, speed, heading, np.zeros(n), np.ones(n)][: self.size], axis=1)
        spread = np.diag([16.0, 16.0, 1.0, 0.05, 1e-4, 0.04][: self.size])
        self.x, self.P = np.concatenate([self.x, state]), np.concatenate([self.P, np.repeat(spread[None], n, axis=0)])
        self.without_fix, self.mode = np.append(self.without_fix, np.zeros(n, np.int64)), np.append(self.mode, np.zeros(n, np.int64))
        return np.arange(old, old + n)

    def sigma(self, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.P[at, 0, 0] + self.P[at, 1, 1], 0.0) / 2)

    def predict(self, at: np.ndarray, yaw_rate: np.ndarray, accel: np.ndarray, dt: float) -> None:
        x = self.x[at]
        v, c, s = x[:, 2], np.cos(x[:, 3]), np.sin(x[:, 3])
        f = np.repeat(np.eye(self.size)[None], len(at), axis=0)
        f[:, 0, 2], f[:, 0, 3], f[:, 1, 2], f[:, 1, 3], f[:, 3, 4] = c * dt, -v * s * dt, s * dt, v * c * dt, -dt
        x[:, :4] += np.stack([v * c, v * s, accel, yaw_rate - x[:, 4]], axis=1) * dt
        x[:, 2] = np.maximum(x[:, 2], 0.0)
        n = self.noise
        grown = np.array([n.accel * dt * dt / 2, n.accel * dt * dt / 2, n.accel * dt, n.yaw_rate * dt, n.bias * dt, n.scale * dt])[: self.size]
        self.x[at], self.P[at] = x, f @ self.P[at] @ f.transpose(0, 2, 1) + np.diag(grown**2)

    def measure(self, at: np.ndarray, rows: np.ndarray, difference: np.ndarray, sigma: float) -> None:
        """rows (m, k, size), difference (m, k). Joseph form, so P stays symmetric and positive."""
        if not len(at):
            return
        p, turned = self.P[at], rows.transpose(0, 2, 1)
        r = np.eye(rows.shape[1]) * sigma**2
        gain = np.linalg.solve(rows @ p @ turned + r, rows @ p).transpose(0, 2, 1)
        x = self.x[at] + (gain @ difference[:, :, None])[:, :, 0]
        keep = np.eye(self.size) - gain @ rows
        x[:, 3] = np.arctan2(np.sin(x[:, 3]), np.cos(x[:, 3]))
        if self.size == 6:
            x[:, 5] = np.clip(x[:, 5], 0.4, 2.5)
        self.x[at], self.P[at] = x, keep @ p @ keep.transpose(0, 2, 1) + gain @ r @ gain.transpose(0, 2, 1)

    def _row(self, n: int, **entries: np.ndarray | float) -> np.ndarray:
        out = np.zeros((n, 1, self.size))
        for name, v in entries.items():
            out[:, 0, "xyvhbk".index(name)] = v
        return out

    def see_position(self, at: np.ndarray, xy: np.ndarray, sigma: float) -> None:
        self.measure(at, np.repeat(np.eye(2, self.size)[None], len(at), axis=0), xy - self.x[at, :2], sigma)

    def see_speed(self, at: np.ndarray, speed: np.ndarray, sigma: float) -> None:
        self.measure(at, self._row(len(at), v=1.0), (speed - self.x[at, 2])[:, None], sigma)

    def see_model_speed(self, at: np.ndarray, speed: np.ndarray, sigma: float) -> None:
        """With a scale state, the model measures speed over scale."""
        if self.size == 5:
            return self.see_speed(at, speed, sigma)
        v, k = self.x[at, 2], self.x[at, 5]
        self.measure(at, self._row(len(at), v=1 / k, k=-v / k**2), (speed - v / k)[:, None], sigma)

    def see_heading(self, at: np.ndarray, heading: np.ndarray, sigma: float) -> None:
        d = heading - self.x[at, 3]
        self.measure(at, self._row(len(at), h=1.0), np.arctan2(np.sin(d), np.cos(d))[:, None], sigma)

    def see_road(self, at: np.ndarray, xy: np.ndarray, heading: np.ndarray, sigma: float) -> None:
        nx, ny = -np.sin(heading), np.cos(heading)
        off = xy - self.x[at, :2]
        self.measure(at, self._row(len(at), x=nx, y=ny), (nx * off[:, 0] + ny * off[:, 1])[:, None], sigma)

    def step(self, at: np.ndarray, dt: float, yaw_rate, accel, fix, fix_speed, model_speed, landmark, road_heading, road) -> None:
        """One epoch of the rides `at`; places are (m, 2), the rest (m,). Every epoch without a fix is dead reckoning, even between healthy fixes."""
        n = self.noise
        self.predict(at, yaw_rate, accel, dt)
        has = lambda v: ~np.isnan(v[:, 0] if v.ndim == 2 else v)
        fixed, marked = has(fix), ~has(fix) & has(landmark)
        self.see_position(at[fixed], fix[fixed], n.position)
        quick = fixed & has(fix_speed)
        self.see_speed(at[quick], fix_speed[quick], n.speed)
        self.mode[at] = np.where(fixed, 0, np.where(marked, 2, 1))
        # in the five-state filter a landmark counts as a fix
        self.without_fix[at] = np.where(fixed | (marked & (self.size == 5)), 0, self.without_fix[at] + 1)
        self.see_position(at[marked], landmark[marked], n.landmark)
        turned = has(road_heading)
        self.see_heading(at[turned], road_heading[turned], n.road_heading)
        beside = has(road)
        self.see_road(at[beside], road[beside], np.where(turned, road_heading, self.x[at, 3])[beside], n.road_cross)
        modelled = has(model_speed)
        self.see_model_speed(at[modelled], model_speed[modelled], n.model_speed)


class Fusion:
    """A fleet of one."""

    def __init__(self, x: float, y: float, speed: float, heading: float, noise: Noise = Noise(), with_scale: bool = False):
        self.fleet = Fleet(noise, with_scale)
        self.at = self.fleet.add(*(np.array([v], float) for v in (x, y, speed, heading)))

    x = property(lambda self: self.fleet.x[0])
    P = property(lambda self: self.fleet.P[0])
    mode = property(lambda self: Fleet.MODES[self.fleet.mode[0]])
    epochs_without = property(lambda self: int(self.fleet.without_fix[0]))
    sigma = property(lambda self: float(self.fleet.sigma(self.at)[0]))

    def step(self, dt: float, yaw_rate: float, accel: float, fix=None, fix_speed=None, model_speed=None, landmark=None, road_heading=None, road=None) -> None:
        one = lambda v: np.array([math.nan if v is None else v], float)
        two = lambda v: np.array([(math.nan, math.nan) if v is None else v], float)
        self.fleet.step(self.at, dt, one(yaw_rate), one(accel), two(fix), one(fix_speed), one(model_speed), two(landmark), one(road_heading), two(road))


class Dots:
    """The dots that are shown: each follows its estimate exponentially (1.8 s), at most 25 m/s, and sits on it within half a metre."""

    def __init__(self, tau: float = 1.8, fastest: float = 25.0, sit: float = 0.5):
        self.tau, self.fastest, self.sit, self.xy = tau, fastest, sit, np.zeros((0, 2))

    def add(self, xy: np.ndarray) -> None:
        self.xy = np.concatenate([self.xy, xy])

    def follow(self, at: np.ndarray, xy: np.ndarray, dt: float) -> np.ndarray:
        gap = xy - self.xy[at]
        d = np.hypot(gap[:, 0], gap[:, 1])
        share = np.where(d <= self.sit, 1.0, np.minimum(1 - math.exp(-dt / self.tau), self.fastest * dt / np.maximum(d, 1e-12)))
        self.xy[at] = np.where((d <= self.sit)[:, None], xy, self.xy[at] + gap * share[:, None])
        return self.xy[at]


class Dot:
    """One of them."""

    def __init__(self, **rules: float):
        self.dots = Dots(**rules)

    def follow(self, xy: tuple[float, float], dt: float) -> tuple[float, float]:
        to = np.array([xy], float)
        if not len(self.dots.xy):
            self.dots.add(to)
        return tuple(self.dots.follow(np.zeros(1, np.int64), to, dt)[0].tolist())
