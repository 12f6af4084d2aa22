"""Ordered folds: what happens at a row depends on all earlier rows of its key.

Rows are dealt by key and sorted within partitions; a step function then sees them one by one, with a state of
fixed size that starts anew with each key. No key is ever held as a whole, so a ride may be arbitrarily long, and
the same step functions serve the streaming twins (trackloom.streaming.live).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: step(state, row) -> rows to emit; state is what start() gave and may be changed in place.
Step = Callable[[Any, dict], list[dict] | dict | None]


def dealt(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """All rows of a key in one task.

    Spark leaves that shuffle out where a union's sides are each dealt by the key already, and then puts small partitions of each side together
    on its own, so that a key's rows meet no more; so in this session a union counts as dealt by nothing.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.unionOutputPartitioning", "false")
    return df.repartition(partitions or int(conf.get("spark.sql.shuffle.partitions")), key)


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Step, schema: str, finish: Callable[[Any, Any], list[dict]] | None = None, partitions: int | None = None) -> DataFrame:
    """Run step over each key's rows in order. The key is added to what it emits. finish(state, key) may emit more at the end."""
    kind = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, begun = None, None, False
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if not begun or row[key] != at:
                    if begun and finish:
                        out += [{key: at, **r} for r in finish(state, at)]
                    state, at, begun = start(), row[key], True
                got = step(state, row)
                if got:
                    out += [{key: at, **r} for r in (got if isinstance(got, list) else [got])]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], arrow.field(n).type) for n in names], schema=arrow)
        if begun and finish:
            out = [{key: at, **r} for r in finish(state, at)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], arrow.field(n).type) for n in names], schema=arrow)

    return dealt(df, key, partitions).sortWithinPartitions(key, *order).mapInArrow(run, kind)


#: step(state, at, columns, new) -> columns to emit. at: places of the rows' keys in the state; new: which of them are seen first.
Epoch = Callable[[Any, np.ndarray, dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def lockstep(df: DataFrame, key: str, seq: str, start: Callable[[], Any], step: Epoch, schema: str, partitions: int | None = None) -> DataFrame:
    """The fold of many keys at once: rows with the same seq, of all keys of a task, are one call on arrays.

    The state holds a row of numbers for each key of the task, however long the keys are. Rows that repeat a key and seq are taken one after
    the other. Columns must be numbers or booleans; null is NaN. Key and seq are added to what is emitted.
    """
    kind = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, places, held = start(), {}, None
        names = df_columns

        def groups(cols: list[np.ndarray], last: bool) -> tuple[list[slice], int]:
            t = cols[names.index(seq)]
            edges = np.concatenate([[0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]])
            spans = [slice(a, b) for a, b in zip(edges, edges[1:])]
            return (spans, len(t)) if last else (spans[:-1], int(edges[-2]))

        def work(cols: list[np.ndarray], spans: list[slice]) -> Iterator[pa.RecordBatch]:
            out: list[dict[str, np.ndarray]] = []
            for span in spans:
                keys = cols[names.index(key)][span]
                again = np.concatenate([[False], keys[1:] == keys[:-1]])  # rows of a seq come by key
                wave = np.arange(len(keys)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))
                for w in range(int(wave.max()) + 1):
                    take = wave == w
                    part = {n: c[span][take] for n, c in zip(names, cols)}
                    fresh = np.array([k not in places for k in part[key].tolist()])
                    for k in part[key][fresh].tolist():
                        places[k] = len(places)
                    at = np.array([places[k] for k in part[key].tolist()], np.int64)
                    out.append({key: part[key], seq: part[seq], **step(state, at, part, fresh)})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(o[f.name]) for o in out])).cast(f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            spans, done = groups(cols, False)
            yield from work(cols, spans)
            held = [c[done:] for c in cols]
        if held is not None:
            yield from work(held, groups(held, True)[0])

    df_columns = df.columns
    return dealt(df, key, partitions).sortWithinPartitions(seq, key).mapInArrow(run, kind)


def _apart(a: tuple[float, float], b: tuple[float, float]) -> float:
    return math.hypot(a[0] - b[0], a[1] - b[1])


class FixFilter:
    """Is a fix to be used? Its verdict: ACCEPT, NEW_TRACK (use, but draw no line to it), STALE or GLITCH.

    A fix is stale when older than ten seconds on arrival. One that can't be reached at 60 m/s is a glitch, unless
    three in a row can be reached from one another. After 20 s and 50 m a new track begins.
    """

    STALE_S, MAX_SPEED, CONFIRM, GAP_S, GAP_M = 10.0, 60.0, 3, 20.0, 50.0

    def __init__(self) -> None:
        self.used: tuple[tuple[float, float], float] | None = None
        self.doubt: tuple[tuple[float, float], float] | None = None
        self.agreeing = 0

    @classmethod
    def _reachable(cls, since: tuple[tuple[float, float], float], xy: tuple[float, float], t: float) -> bool:
        dt = t - since[1]
        return dt > 0 and _apart(since[0], xy) / dt <= cls.MAX_SPEED

    def check(self, xy: tuple[float, float], t: float, age: float) -> str:
        if age > self.STALE_S:
            return "STALE"
        if self.used is None or self._reachable(self.used, xy, t):
            new = self.used is not None and t - self.used[1] >= self.GAP_S and _apart(self.used[0], xy) >= self.GAP_M
            # the first fix of all leaves no doubts to clear
            self.used, self.agreeing = (xy, t), 0
            return "NEW_TRACK" if new else "ACCEPT"
        follows = self.agreeing > 0 and self._reachable(self.doubt, xy, t)
        self.agreeing, self.doubt = (self.agreeing + 1 if follows else 1), (xy, t)
        if self.agreeing < self.CONFIRM:
            return "GLITCH"
        self.used, self.agreeing = (xy, t), 0
        return "NEW_TRACK"


class GnssSwitch:
    """Whether satellites can be trusted now: GNSS or DEAD_RECKONING, from fixes, satellite counts and ticks (seconds).

    Lost: no fix for more than 2.5 s; under four satellites for a second, once four were ever seen; a fix coarser
    than 60 m. Back: two good fixes (30 m or better, enough satellites) no more than 1.5 s apart.
    """

    SILENCE, WEAK_FOR, STREAK_GAP, LEAST_SATS, GOOD_M, STREAK = 2.5, 1.0, 1.5, 4, 30.0, 2

    def __init__(self) -> None:
        self.real, self.simulated, self.switches, self.mode = True, False, 0, "GNSS"
        self.fix_at: float | None = None
        self.weak_since: float | None = None
        self.sats: int | None = None
        self.ever_enough, self.streak = False, 0

    def _settle(self, real: bool | None = None) -> None:
        if real is not None:
            self.real, self.streak = real, 0
        mode = "GNSS" if self.real and not self.simulated else "DEAD_RECKONING"
        self.switches += mode != self.mode
        self.mode = mode

    def fix(self, t: float, accuracy: float) -> None:
        gap = None if self.fix_at is None else t - self.fix_at
        self.fix_at = t
        enough = self.sats is None or not self.ever_enough or self.sats >= self.LEAST_SATS
        if accuracy > self.GOOD_M or not enough:
            self.streak = 0
        else:
            self.streak = self.streak + 1 if gap is not None and gap <= self.STREAK_GAP else 1
        if not self.real and self.streak >= self.STREAK:
            self._settle(True)
        elif self.real and accuracy > 2 * self.GOOD_M:
            self._settle(False)

    def satellites(self, t: float, used: int) -> None:
        self.sats = used
        self.ever_enough |= used >= self.LEAST_SATS
        if used >= self.LEAST_SATS or not self.ever_enough:
            self.weak_since = None
        elif self.weak_since is None:
            self.weak_since = t
        self.tick(t)

    def tick(self, t: float) -> None:
        silent = self.fix_at is not None and t - self.fix_at > self.SILENCE
        weak = self.weak_since is not None and t - self.weak_since >= self.WEAK_FOR
        if self.real and (silent or weak):
            self._settle(False)

    def simulate(self, on: bool) -> None:
        self.simulated = on
        self._settle()


class OffRoute:
    """True at the second fix in a row that is more than 40 m, and more than its accuracy, off a route once joined (25 m)."""

    def __init__(self) -> None:
        self.joined, self.off = False, 0

    def fix(self, off_m: float, accuracy: float) -> bool:
        self.joined |= off_m <= 25.0
        self.off = self.off + 1 if self.joined and off_m > max(40.0, accuracy) else 0
        return self.off >= 2


class GyroBias:
    """Mean rate while vehicle and phone are still: ready after 150 samples, dropped if over a degree a second."""

    LEAST, STILL, IMPLAUSIBLE_DEG = 150, 0.05, 1.0

    def __init__(self) -> None:
        self.frozen = False
        self._clear()

    def _clear(self) -> None:
        self.n, self.sum, self.bias, self.ready = 0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), False

    def observe(self, w: tuple[float, float, float], stationary: bool) -> None:
        if self.frozen or not stationary or sum(v * v for v in w) > self.STILL**2:
            return
        self.n, self.sum = self.n + 1, tuple(s + v for s, v in zip(self.sum, w))
        if self.n >= self.LEAST:
            self.bias, self.ready = tuple(s / self.n for s in self.sum), True
            if math.degrees(math.hypot(*self.bias)) > self.IMPLAUSIBLE_DEG:
                self._clear()


class Anchor:
    """Greedy thinning: keep a point if it is more than `least` from the last kept one and not more than `most`."""

    def __init__(self, least: float, most: float = math.inf):
        self.least, self.most, self.kept = least, most, None

    def keep(self, xy: tuple[float, float]) -> bool:
        if self.kept is not None and not self.least < _apart(self.kept, xy) <= self.most:
            return False
        self.kept = xy
        return True


class StrongestWithin:
    """Merges events nearer than `gap` to the last kept one, in place or time; the stronger stays and moves the anchor."""

    def __init__(self, gap: float):
        self.gap, self.last = gap, None

    def push(self, at: float, strength: float, item: Any) -> Any | None:
        """The event that is settled now, if any."""
        if self.last is not None and at - self.last[0] < self.gap:
            if strength > self.last[1]:
                self.last = (at, strength, item)
            return None
        settled, self.last = self.last, (at, strength, item)
        return settled and settled[2]


class TurnPieces:
    """Joins turns of one sign (or any) nearer than `gap` to where the first of them began; angles add up."""

    def __init__(self, gap: float = 15.0, any_sign: bool = False):
        self.gap, self.any_sign, self.open = gap, any_sign, None

    def push(self, at: float, angle: float) -> tuple[float, float] | None:
        if self.open is not None and at - self.open[0] < self.gap and (self.any_sign or (angle > 0) == (self.open[1] > 0)):
            self.open = (self.open[0], self.open[1] + angle)
            return None
        settled, self.open = self.open, (at, angle)
        return settled


class Crowd:
    """Landmarks from many rides, in order of arrival: an observation joins the nearest candidate within 12 m (running mean)."""

    def __init__(self, within: float = 12.0):
        self.within, self.candidates = within, []

    def observe(self, xy: tuple[float, float], run: Any) -> int:
        near = min(range(len(self.candidates)), key=lambda i: _apart(self.candidates[i]["xy"], xy), default=None)
        if near is None or _apart(self.candidates[near]["xy"], xy) > self.within:
            self.candidates.append({"xy": xy, "n": 1, "runs": {run}, "misses": 0})
            return len(self.candidates) - 1
        c = self.candidates[near]
        c["n"] += 1
        c["xy"] = tuple(m + (v - m) / c["n"] for m, v in zip(c["xy"], xy))
        c["runs"].add(run)
        return near

    def decay(self, run: Any, track: list[tuple[float, float]] | None, corridor: float = 25.0, limit: int = 3) -> int:
        """Candidates that the run went by without seeing them count a miss; those with three go. How many went."""
        for c in self.candidates:
            passed = not track or min(_apart(c["xy"], p) for p in track) <= corridor
            c["misses"] += passed and run not in c["runs"]
        before = len(self.candidates)
        self.candidates = [c for c in self.candidates if c["misses"] < limit]
        return before - len(self.candidates)


class RoadAdvance:
    """Moves along a road of a length by speed; below 0.5 m/s it stands; it stops at either end."""

    def __init__(self, s: float, length: float, direction: int = 1):
        self.s, self.length, self.direction = s, length, direction

    def step(self, speed: float, dt: float) -> tuple[float, bool]:
        if speed >= 0.5:
            self.s = min(max(self.s + self.direction * speed * dt, 0.0), self.length)
        left = self.length - self.s if self.direction > 0 else self.s
        return self.s, left <= 2.0


class Speaker:
    """Announces each turn once far off (150 m) and once at hand (30 m), and arrival once (30 m)."""

    def __init__(self, turns: list[float], length: float):
        self.turns, self.length = turns, length
        self.said: set[tuple[int, str]] = set()

    def at(self, s: float) -> str | None:
        for i, turn in enumerate(self.turns):
            if s > turn + 5.0:
                continue
            band = "now" if turn - s <= 30.0 else "far" if turn - s <= 150.0 else None
            if band and (i, band) not in self.said:
                self.said |= {(i, band), (i, "far")}
                return f"{band} {i}"
            break
        if self.length - s <= 30.0 and (-1, "arrived") not in self.said:
            self.said.add((-1, "arrived"))
            return "arrived"
        return None


class Throttled:
    """Lets a changed value through, at most once in `every` seconds (confidence bands, new routes)."""

    def __init__(self, every: float = 8.0):
        self.every, self.value, self.at = every, None, -math.inf

    def offer(self, t: float, value: Any) -> bool:
        if value == self.value or t - self.at < self.every:
            return False
        self.value, self.at = value, t
        return True
