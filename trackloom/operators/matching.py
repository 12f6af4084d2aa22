"""Matching of detections to landmarks and turns along a road, and gated corrections of the distance travelled."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

GAP = -1


@dataclass(frozen=True)
class Costs:
    gate: float = 80.0
    sigma: float = 20.0
    other_kind: float = 1.5
    skip_mark: float = 1.0
    skip_detection: float = 2.0

    def pair(self, at: float, kind: str | None, marks: np.ndarray, kinds: list[str | None]) -> np.ndarray:
        """Cost of a detection against each mark; inf beyond the gate."""
        away = np.abs(marks - at)
        other = np.array([bool(kind and k and k != kind) for k in kinds], float)
        return np.where(away > self.gate, np.inf, (away / self.sigma) ** 2 + other * self.other_kind)


def align(detected: list[float], marks: list[float], kinds: list[str | None] | None = None, mark_kinds: list[str | None] | None = None, costs: Costs = Costs()) -> list[int]:
    """Of each detection the mark it belongs to, or -1: the cheapest order-preserving assignment of all.

    Rows of the table are made at once: skipping marks along a row is a running minimum after taking out its slope.
    """
    n, m = len(detected), len(marks)
    if not n or not m:
        return [GAP] * n
    at, slope = np.asarray(marks, float), costs.skip_mark * np.arange(m + 1)
    table = np.empty((n + 1, m + 1))
    table[0] = slope
    pairs = np.full((n, m), np.inf)
    for i, d in enumerate(detected):
        pairs[i] = costs.pair(d, (kinds or [None] * n)[i], at, mark_kinds or [None] * m)
        row = table[i] + costs.skip_detection
        row[1:] = np.minimum(row[1:], table[i, :-1] + pairs[i])
        table[i + 1] = np.minimum.accumulate(row - slope) + slope
    out, i, j = [GAP] * n, n, m
    while i and j:
        skip_d, skip_m, pair = table[i - 1, j] + costs.skip_detection, table[i, j - 1] + costs.skip_mark, table[i - 1, j - 1] + pairs[i - 1, j - 1]
        if pair < min(skip_d, skip_m) - 1e-12:
            i, j = i - 1, j - 1
            out[i] = j
        elif skip_m < skip_d - 1e-12:
            j -= 1
        else:
            i -= 1
    return out


class Online:
    """The causal matcher: the cheapest mark not yet passed within the gate; a mark is used once, in order."""

    def __init__(self, marks: list[float], kinds: list[str | None] | None = None, costs: Costs = Costs()):
        self.marks, self.kinds, self.costs, self.next = np.asarray(marks, float), kinds or [None] * len(marks), costs, 0

    def match(self, at: float, kind: str | None = None) -> int:
        c = self.costs.pair(at, kind, self.marks[self.next :], self.kinds[self.next :])
        if not len(c) or not np.isfinite(c.min()):
            return GAP
        found = self.next + int(np.argmin(c))
        self.next = found + 1
        return found


class AlongRoad:
    """Uncertainty of the distance along a road: grows with travel, gates a correction, weighs it."""

    def __init__(self, growth: float = 0.07, mark_sigma: float = 4.0, sigma: float = 5.0, gate: float = 3.0):
        self.growth, self.noise, self.variance, self.gate, self.at = growth, mark_sigma**2, sigma**2, gate, None

    def travel(self, s: float) -> None:
        if self.at is not None:
            self.variance += (self.growth * abs(s - self.at)) ** 2
        self.at = s

    def correct(self, difference: float) -> float | None:
        """The shift to apply, or None if the difference isn't credible."""
        total = self.variance + self.noise
        if difference**2 > self.gate**2 * total:
            return None
        gain = self.variance / total
        self.variance *= 1 - gain
        return gain * difference

    def behind(self, s: float) -> float:
        """Marks before this are certainly passed."""
        return s - self.gate * math.sqrt(self.variance) - 3 * math.sqrt(self.noise)


class ByMarks:
    """Corrects the distance along a road at one detection after the other, by the marks ahead. A shift applies to all that follows."""

    def __init__(self, marks: list[float], filt: AlongRoad | None = None, window: int = 3):
        self.marks, self.filter, self.window = marks, filt or AlongRoad(), window
        self.shift, self.first, self.held, self.refused = 0.0, 0, 0, 0

    def step(self, raw: float) -> float:
        s, f = raw + self.shift, self.filter
        if self.first >= len(self.marks):
            return s
        f.travel(s)
        while self.first < len(self.marks) and self.marks[self.first] < f.behind(s):
            self.first += 1
        ahead = range(self.first, min(self.first + self.window, len(self.marks)))
        if not ahead:
            return s
        j = min(ahead, key=lambda q: abs(self.marks[q] - s))
        moved = f.correct(self.marks[j] - s)
        if moved is None:
            self.refused += 1
            return s
        self.shift, s, self.first, self.held = self.shift + moved, s + moved, j + 1, self.held + 1
        f.at = s
        return s


class ByScale:
    """As ByMarks, but what is corrected is a scale and an offset, refitted by least squares over all pairs held so far.

    A recorded negative on real rides: early wrong pairs spoil the scale. Only sums of the pairs are kept, so the state doesn't grow with them.
    A scale farther than `most` from 1 is not believed; then, and with a single pair, the offset alone moves.
    """

    def __init__(self, marks: list[float], start: float = 0.0, growth: float = 0.07, mark_sigma: float = 4.0, sigma: float = 5.0, gate: float = 3.0, window: int = 3, most: float = 0.35):
        self.marks, self.start, self.growth, self.noise, self.sigma, self.gate, self.window, self.most = marks, start, growth, mark_sigma**2, sigma, gate, window, most
        self.k, self.b, self.first, self.held, self.refused, self.ended = 1.0, 0.0, 0, 0, 0, False
        self.last, self.n, self.sums = 0.0, 0, [0.0] * 4  # of d, m, d * d, d * m

    def step(self, raw: float) -> float:
        """Where a detection at this raw distance is, by what is known before it."""
        s = self.start + self.k * raw + self.b
        sigma = math.hypot(self.sigma, self.growth * max(raw - self.last, 0.0))
        if self.ended:
            return s
        while self.first < len(self.marks) and self.marks[self.first] < s - 3 * sigma - 3 * math.sqrt(self.noise):
            self.first += 1
        if self.first >= len(self.marks):
            self.ended = True
            return s
        j = min(range(self.first, min(self.first + self.window, len(self.marks))), key=lambda q: abs(self.marks[q] - s))
        if (self.marks[j] - s) ** 2 > self.gate**2 * (sigma * sigma + self.noise):
            self.refused += 1
            return s
        self._hold(raw, self.marks[j] - self.start)
        self.first, self.held = j + 1, self.held + 1
        return s

    def _hold(self, d: float, m: float) -> None:
        self.last, self.n = d, self.n + 1
        self.sums = [a + x for a, x in zip(self.sums, (d, m, d * d, d * m))]
        sd, sm, sdd, sdm = self.sums
        spread = self.n * sdd - sd * sd
        k = (self.n * sdm - sd * sm) / spread if self.n > 1 and spread > 0 else None
        if k is not None and abs(k - 1) <= self.most:
            self.k, self.b = k, (sm - k * sd) / self.n
        else:
            self.b = m - self.k * d


class ByTurns:
    """The same by turns (distance, angle) of the road: sign and angle must agree as well."""

    def __init__(self, road: list[tuple[float, float]], tolerance: float = 45.0, filt: AlongRoad | None = None, window: int = 4):
        self.road, self.tolerance, self.filter, self.window = road, tolerance, filt or AlongRoad(mark_sigma=8.0), window
        self.shift, self.first, self.held, self.refused = 0.0, 0, 0, 0

    def step(self, raw: float, angle: float) -> float:
        s, f = raw + self.shift, self.filter
        f.variance += 0.0 if f.at is None else (f.growth * max(s - f.at, 0.0)) ** 2
        f.at = s
        while self.first < len(self.road) and self.road[self.first][0] < f.behind(s):
            self.first += 1
        ahead = range(self.first, min(self.first + self.window, len(self.road)))
        like = [j for j in ahead if self.road[j][1] * angle > 0 and abs(self.road[j][1] - angle) <= self.tolerance]
        best = min(like, key=lambda q: abs(self.road[q][0] - s), default=None)
        moved = None if best is None else f.correct(self.road[best][0] - s)
        if moved is None:
            self.refused += 1
            return s
        self.first, self.shift, s, self.held = best + 1, self.shift + moved, s + moved, self.held + 1
        f.at = s
        return s


def correct_by_marks(places: list[float], marks: list[float], filt: AlongRoad | None = None, window: int = 3) -> tuple[list[float], int, int]:
    """places: raw distance at each detection -> corrected ones, how many corrections held, how many were refused."""
    c = ByMarks(marks, filt, window)
    return [c.step(p) for p in places], c.held, c.refused
