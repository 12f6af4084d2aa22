"""A residual network over windows of a time series: forward in numpy batches inside tasks, trained by gradients summed over Spark.

Stem of width 7 and stride 2, maximum over 3, stages of two-convolution blocks with a skip (1 x 1 where the width or the stride changes), mean over
time, two linear layers. Channel normalisation has statistics that are set before training, from a first pass, and learned scale and shift, so
the gradient of a sum of rows is the sum of the rows' gradients and does not depend on how they are dealt. A step is one job: each task adds up
the gradients of its rows of the mini-batch, a second layer of tasks adds those up, and the driver gets `FAN` vectors of the
network's size, whatever the table's. Weights are AdamW's under a one-cycle rate, the loss is the smooth absolute one, gradients are
clipped at norm 1.

Defined results: windows of another size are an error; a null label is not learned from; an empty mini-batch changes nothing; without any row the
network is what it was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN, EPS = 8, 1e-5
Weights = dict[str, np.ndarray]


def _conv(x: np.ndarray, w: np.ndarray, stride: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(B, C, T) by (O, C, K) -> (B, O, T'), and the rows that were multiplied."""
    k = w.shape[2]
    xp = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
    cols = np.lib.stride_tricks.sliding_window_view(xp, k, axis=2)[:, :, ::stride]
    b, c, t, _ = cols.shape
    cols = cols.transpose(0, 2, 1, 3).reshape(b * t, c * k)
    return (cols @ w.reshape(len(w), -1).T).reshape(b, t, len(w)).transpose(0, 2, 1), cols


def _conv_back(dy: np.ndarray, cols: np.ndarray, w: np.ndarray, shape: tuple[int, ...], stride: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    (b, c, size), (o, _, k), t = shape, w.shape, dy.shape[2]
    flat = dy.transpose(0, 2, 1).reshape(b * t, o)
    dcols = (flat @ w.reshape(o, -1)).reshape(b, t, c, k).transpose(0, 2, 1, 3)
    dx = np.zeros((b, c, size + 2 * pad), dy.dtype)
    for i in range(k):
        dx[:, :, i : i + stride * t : stride] += dcols[..., i]
    return dx[:, :, pad : pad + size], (flat.T @ cols).reshape(w.shape)


@dataclass
class ResidualNet:
    """blocks: name, width in, width out, stride. Weights and statistics are by name."""

    channels: int = 6
    window: int = 300
    base: int = 32
    layers: tuple[int, ...] = (2, 2, 2, 2)
    hidden: int = 128
    seed: int = 7
    weights: Weights = field(default_factory=dict)
    stats: Weights = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng, self.blocks, wide = np.random.default_rng(self.seed), [], self.base
        for stage, n in enumerate(self.layers):
            for i in range(n):
                out = self.base * 2**stage
                self.blocks.append((f"s{stage}b{i}", wide, out, 2 if stage and not i else 1))
                wide = out
        if self.weights:
            return
        he = lambda *shape: rng.normal(0, math.sqrt(2 / np.prod(shape[1:])), shape)
        w = {"stem": he(self.base, self.channels, 7)}
        norms = [("stem", self.base)]
        for name, a, b, stride in self.blocks:
            w[f"{name}.1"], w[f"{name}.2"] = he(b, a, 3), he(b, b, 3)
            norms += [(f"{name}.1", b), (f"{name}.2", b)]
            if stride > 1 or a != b:
                w[f"{name}.d"] = he(b, a, 1)
                norms.append((f"{name}.d", b))
        for name, n in norms:
            w[f"{name}.g"], w[f"{name}.s"] = np.ones(n), np.zeros(n)
            self.stats[f"{name}.m"], self.stats[f"{name}.v"] = np.zeros(n), np.ones(n)
        w["h1"], w["h1.s"], w["h2"], w["h2.s"] = he(self.hidden, wide), np.zeros(self.hidden), he(1, self.hidden), np.zeros(1)
        self.weights = w

    # each part keeps what its gradient needs on a tape
    def _unit(self, x: np.ndarray, name: str, stride: int, pad: int, tape: list | None, collect: Weights | None) -> np.ndarray:
        y, cols = _conv(x, self.weights[name], stride, pad)
        if collect is not None:
            collect[f"{name}.m"], collect[f"{name}.v"] = y.mean((0, 2)), y.var((0, 2))
            self.stats.update({k: collect[k] for k in (f"{name}.m", f"{name}.v")})
        unit = (y - self.stats[f"{name}.m"][:, None]) / np.sqrt(self.stats[f"{name}.v"] + EPS)[:, None]
        if tape is not None:
            tape.append(("unit", name, stride, pad, x.shape, cols, unit))
        return unit * self.weights[f"{name}.g"][:, None] + self.weights[f"{name}.s"][:, None]

    def forward(self, x: np.ndarray, tape: list | None = None, collect: Weights | None = None) -> np.ndarray:
        """(B, C, T) -> (B,). tape: what backward() takes. collect: sets the statistics to those of this very batch."""
        if x.shape[1:] != (self.channels, self.window):
            raise ValueError(f"windows of {x.shape[1:]}, not {(self.channels, self.window)}")
        relu = lambda v: np.maximum(v, 0)
        x = relu(self._unit(x, "stem", 2, 3, tape, collect))
        padded = np.pad(x, ((0, 0), (0, 0), (1, 1)), constant_values=-np.inf)
        views = np.lib.stride_tricks.sliding_window_view(padded, 3, axis=2)[:, :, ::2]
        which = views.argmax(3)
        pooled = np.take_along_axis(views, which[..., None], 3)[..., 0]
        if tape is not None:
            tape.append(("pool", x, which))
        x = pooled
        for name, a, b, stride in self.blocks:
            own: list | None = None if tape is None else []
            first = relu(self._unit(x, f"{name}.1", stride, 1, own, collect))
            second = self._unit(first, f"{name}.2", 1, 1, own, collect)
            skip = self._unit(x, f"{name}.d", stride, 0, own, collect) if f"{name}.d" in self.weights else x
            out = relu(second + skip)
            if tape is not None:
                tape.append(("block", own, first, out))
            x = out
        mean = x.mean(2)
        hidden = relu(mean @ self.weights["h1"].T + self.weights["h1.s"])
        if tape is not None:
            tape.append(("head", x.shape, mean, hidden))
        return (hidden @ self.weights["h2"].T + self.weights["h2.s"])[:, 0]

    def _unit_back(self, dy: np.ndarray, kept: tuple, grads: Weights) -> np.ndarray:
        _, name, stride, pad, shape, cols, unit = kept
        grads[f"{name}.g"], grads[f"{name}.s"] = (dy * unit).sum((0, 2)), dy.sum((0, 2))
        dy = dy * (self.weights[f"{name}.g"] / np.sqrt(self.stats[f"{name}.v"] + EPS))[:, None]
        dx, grads[name] = _conv_back(dy, cols, self.weights[name], shape, stride, pad)
        return dx

    def backward(self, tape: list, dout: np.ndarray) -> Weights:
        """Gradients of sum(dout * forward) by every weight."""
        grads: Weights = {}
        _, shape, mean, hidden = tape[-1]
        grads["h2"], grads["h2.s"] = dout[None] @ hidden, dout.sum(keepdims=True)
        dh = dout[:, None] * self.weights["h2"] * (hidden > 0)
        grads["h1"], grads["h1.s"] = dh.T @ mean, dh.sum(0)
        dx = np.repeat((dh @ self.weights["h1"])[:, :, None] / shape[2], shape[2], axis=2)
        for _, own, first, out in reversed(tape[2:-1]):
            dx = dx * (out > 0)
            back = self._unit_back(dx, own[1], grads) * (first > 0)
            skip = self._unit_back(dx, own[2], grads) if len(own) > 2 else dx
            dx = self._unit_back(back, own[0], grads) + skip
        _, x, which = tape[1]
        dp = np.zeros((*x.shape[:2], x.shape[2] + 2))
        at = which + 2 * np.arange(which.shape[2])
        b, c = np.arange(x.shape[0])[:, None, None], np.arange(x.shape[1])[None, :, None]
        np.add.at(dp, (b, c, at), dx)
        self._unit_back(dp[:, :, 1:-1] * (x > 0), tape[0], grads)
        return grads

    def loss_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
        """Sum over rows of the smooth absolute loss, and its gradients."""
        tape: list = []
        off = self.forward(x, tape) - y
        loss = np.where(np.abs(off) < 1, 0.5 * off * off, np.abs(off) - 0.5).sum()
        return float(loss), self.backward(tape, np.clip(off, -1, 1))


def one_cycle(step: int, steps: int, most: float, rise: float = 0.3, begin: float = 25.0, end: float = 1e4) -> float:
    """The rate of a step: from most / begin up to most, then down to most / begin / end, along half cosines."""
    top = max(rise * steps - 1, 1e-9)
    low, last = most / begin, most / begin / end
    a, b, share = (low, most, step / top) if step <= top else (most, last, (step - top) / max(steps - 1 - top, 1e-9))
    return b + (a - b) * (1 + math.cos(math.pi * min(share, 1.0))) / 2


class AdamW:
    def __init__(self, decay: float = 1e-4, clip: float = 1.0):
        self.decay, self.clip, self.m, self.s, self.n = decay, clip, {}, {}, 0

    def step(self, weights: Weights, grads: Weights, rate: float) -> None:
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale, self.n = min(1.0, self.clip / (norm + 1e-6)), self.n + 1
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.s[k] = 0.999 * self.s.get(k, 0.0) + 0.001 * g * g
            weights[k] = weights[k] * (1 - rate * self.decay) - rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.s[k] / (1 - 0.999**self.n)) + 1e-8)


def _matrix(column: pa.Array, net: ResidualNet) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, net.channels, net.window)


def gradients_of(rows: DataFrame, net: ResidualNet, batch: int = 256) -> tuple[int, float, Weights]:
    """Rows, loss and gradients summed over rows(x: channels * window numbers, channel first; y)."""
    names = sorted(net.weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, {k: np.zeros_like(net.weights[k]) for k in names}
        for part in batches:
            for lo in range(0, part.num_rows, batch):
                some = part.slice(lo, batch)
                more, grads = net.loss_gradients(_matrix(some.column(0), net), np.array(some.column(1).to_pylist(), float))
                n, loss = n + some.num_rows, loss + more
                for k in names:
                    total[k] += grads[k]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([np.concatenate([total[k].ravel() for k in names]).tobytes()], pa.binary())], names=["n", "loss", "g"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, None
        for part in batches:
            for m, more, g in zip(*(c.to_pylist() for c in part.columns)):
                n, loss, total = n + m, loss + more, np.frombuffer(g) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=["n", "loss", "g"])

    kind = "n long, loss double, g binary"
    parts = rows.where("y is not null").select("x", "y").mapInArrow(add, kind).repartition(FAN).mapInArrow(again, kind).collect()  # FAN rows at most
    flat = sum((np.frombuffer(r["g"]) for r in parts), np.zeros(sum(net.weights[k].size for k in names)))
    grads, at = {}, 0
    for k in names:
        size = net.weights[k].size
        grads[k] = flat[at : at + size].reshape(net.weights[k].shape)
        at += size
    return sum(r["n"] for r in parts), sum(r["loss"] for r in parts), grads


def train(rows: DataFrame, net: ResidualNet, epochs: int, batches: int, rate: float = 1e-3, id_col: str = "id", warm: int = 256) -> list[float]:
    """Trains the net in place on a written table(id, x, y), each epoch in `batches` steps by a hash of the id; the mean loss of each step.

    The statistics come from `warm` rows at most, those with the least hashes: a documented sample, for normalisation only.
    """
    mark = F.xxhash64(id_col)
    first = rows.where("y is not null").orderBy(mark, id_col).limit(warm).select("x").collect()
    if not first:
        return []
    net.forward(np.array([r["x"] for r in first], float).reshape(-1, net.channels, net.window), collect={})
    adam, losses, steps = AdamW(), [], epochs * batches
    for step in range(steps):
        n, loss, grads = gradients_of(rows.where(F.pmod(mark, F.lit(batches)) == step % batches), net)
        if n:
            adam.step(net.weights, {k: g / n for k, g in grads.items()}, one_cycle(step, steps, rate))
            losses.append(loss / n)
    return losses


def predict(rows: DataFrame, net: ResidualNet, keep: list[str], batch: int = 256) -> DataFrame:
    """The columns in keep and predicted, a batch at a time."""
    kinds = rows.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", predicted double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for lo in range(0, part.num_rows, batch):
                some = part.slice(lo, batch)
                out = net.forward(_matrix(some.column(0), net))
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(out, pa.float64())], names=[*keep, "predicted"])

    return rows.select("x", *keep).mapInArrow(run, ddl)
