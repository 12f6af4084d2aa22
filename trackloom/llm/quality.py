"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 50 words. A passage becomes counts of its characters by class, word statistics and
hashed words; a small network encodes it, and a second one gives it a gated attention weight (tanh times sigmoid).
The encoded passages, summed by softmax of their weights, are scored as one vector. Everything is learned from the
documents' labels alone, on a bounded sample: about `per_class` documents of each label, chosen by a hash of the id, with all their
passages. Their features (half a KB a passage) are written; the driver trains in numpy on mini-batches of some 64 documents, holding
no more than `cache` bytes of features, else reading the table anew for every epoch, which gives the same model. Scoring
is a pandas UDF over all passages of all texts.

Defined results: null and empty texts are one empty passage and get a score like any other; rows that repeat an
id are scored alike; labels other than 0 and 1 are ignored and of repeated ones the greatest counts; without any
training label every score is 0.5; score() carries all columns but one named score, which it replaces. Whole texts are read, in as many passages as they have.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import materialize

PASSAGE, HASHED, PER_CLASS, HIDDEN, ATTENTION, EPOCHS, BATCH, CACHE = 50, 192, 1500, 32, 16, 20, 64, 1 << 26


def _classes() -> np.ndarray:
    """Bytes to classes: each mark its own, small letters one by one, capitals, digits, blanks, the rest."""
    out = np.full(256, 63)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for i, c in enumerate(marks):
        out[c] = i
    out[ord("A") : ord("Z") + 1] = 32
    out[ord("0") : ord("9") + 1] = 33
    out[ord("a") : ord("z") + 1] = 34 + np.arange(26)
    out[[9, 11, 12, 13, 32]] = 60
    out[10] = 61
    return out


CLASSES, N_CLASSES, N_STATS = _classes(), 64, 5
FEATURES = N_CLASSES + N_STATS + HASHED


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of 50 words, at least one."""
    data = (text or "").encode()
    words = data.split()
    n = max(1, -(-len(words) // PASSAGE))
    out = np.zeros((n, FEATURES), np.float32)
    if not words:
        return out
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    of_byte = np.zeros(len(raw), np.int64)
    of_byte[starts[PASSAGE::PASSAGE]] = 1
    of_byte = np.cumsum(of_byte)
    marks = np.bincount(of_byte * N_CLASSES + CLASSES[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = np.maximum(marks.sum(1, keepdims=True), 1)
    out[:, :N_CLASSES] = np.sqrt(marks / size)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    of_word = np.arange(len(words)) // PASSAGE
    per = np.bincount(of_word, minlength=n).astype(np.float32)
    order = np.lexsort((hashes, of_word))
    new = np.ones(len(words), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order][new], minlength=n)
    fresh = np.zeros(len(words), bool)
    fresh[np.unique(hashes, return_index=True)[1]] = True
    unseen = np.bincount(of_word[fresh], minlength=n)  # words that no earlier passage has
    out[:, N_CLASSES] = distinct / per
    out[:, N_CLASSES + 1] = unseen / per
    out[:, N_CLASSES + 2] = size[:, 0] / per / 10
    out[:, N_CLASSES + 3] = per / PASSAGE
    out[:, N_CLASSES + 4] = np.log1p(len(words)) / 10
    hashed = np.bincount(of_word * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    out[:, N_CLASSES + N_STATS :] = hashed / per[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """W, b encode; V, U, w attend; c, d score. mean, scale standardise the features."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, sizes = self.weights, np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "s": _sigmoid(z @ p["c"] + p["d"]), "sizes": sizes}

    def score(self, text: str | None) -> float:
        x = (passages(text) - self.mean) / self.scale
        return float(self.forward(x, np.array([0]))["s"][0])


def gradients(model: AttentionModel, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of documents (rows of x from starts on), each weighed by its cost, by every weight."""
    p, f = model.weights, model.forward(x, starts)
    ds = (f["s"] - labels) * cost / len(labels)
    dz = ds[:, None] * p["c"]
    dz_of = np.repeat(dz, f["sizes"], axis=0)
    da = (dz_of * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
    gate = de[:, None] * p["w"]
    dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
    dh = (f["a"][:, None] * dz_of + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


#: A mini-batch: a row of features for each passage, documents one after the other; where each document begins; labels.
Batch = tuple[np.ndarray, np.ndarray, np.ndarray]


def batch_of(bags: Sequence[np.ndarray], labels: Sequence[float]) -> Batch:
    return np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1], np.array(labels, np.float32)


def train(batches: Callable[[], Iterable[Batch]], epochs: int = EPOCHS, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the mean log loss, each class weighing the same; batches() gives the same mini-batches for every epoch, one held at a time."""
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, ATTENTION**-0.5, ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    passages_, documents, positive = 0, 0, 0.0
    sums, squares = np.zeros(FEATURES), np.zeros(FEATURES)
    for x, _, labels in batches():
        passages_ += len(x)
        sums += x.sum(0, dtype=float)
        squares += (x.astype(float) ** 2).sum(0)
        documents += len(labels)
        positive += float(labels.sum())
    if not documents:
        return AttentionModel(p, np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32))
    mean = sums / passages_
    model = AttentionModel(p, mean.astype(np.float32), (np.sqrt(np.maximum(squares / passages_ - mean**2, 0)) + 0.05).astype(np.float32))
    share = positive / documents
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for x, starts, labels in batches():
            cost = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
            grads = gradients(model, (x - model.mean) / model.scale, starts, labels, cost)
            step += 1
            for k, g in grads.items():
                g = g + decay * p[k]
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


class WrittenBatches:
    """Mini-batches from a written table (batch, doc_id, x, y). What fits `cache` bytes is fetched once; else every epoch streams the table anew."""

    def __init__(self, features: DataFrame, cache: int = CACHE):
        self.features = features.sort("batch", "doc_id", "x").select("batch", "x", "y")
        self.held = self.features.toArrow() if (features.figures["bytes"] or 0) <= cache else None

    def rows(self) -> Iterator[tuple[int, bytes, int]]:
        if self.held is None:
            yield from self.features.toLocalIterator(prefetchPartitions=True)
        else:
            for part in self.held.to_batches(max_chunksize=64):
                yield from zip(*(c.to_pylist() for c in part.columns))

    def __call__(self) -> Iterator[Batch]:
        for _, rows in itertools.groupby(self.rows(), key=lambda r: r[0]):
            _, x, y = zip(*rows)
            yield batch_of([np.frombuffer(b, np.float16).astype(np.float32).reshape(-1, FEATURES) for b in x], y)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, cache: int = CACHE) -> AttentionModel:
    """trainable: a condition on doc_id that says which labels may be learned from."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = (known if trainable is None else known.where(trainable)).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30) < share)
    picked = materialize(picked, "quality-sample", F.count(F.lit(1)).alias("n"))
    n = picked.figures["n"]
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # some 2 * per_class rows, as counted; beyond four times that Spark decides
    rows = texts.join(F.broadcast(picked) if n <= 8 * per_class else picked, "doc_id").select("doc_id", "text", "y")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 50):
                ids, found, y = (c.to_pylist() for c in batch.slice(lo, 50).columns)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([passages(t).astype(np.float16).tobytes() for t in found], pa.binary()), pa.array(y, pa.int32())], names=["doc_id", "x", "y"])

    features = rows.mapInArrow(featurise, "doc_id long, x binary, y int")
    features = features.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(max(1, n // BATCH))))
    return train(WrittenBatches(materialize(features, "quality-features", F.sum(F.octet_length("x")).alias("bytes")), cache))


def score(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """docs and a column score."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(F.col(f"`{text_col}`")))
