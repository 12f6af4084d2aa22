"""Language identification by nearest centroid.

A text is a bag of hashed one-, two- and three-letter grams of its lower-case letters, weighted by TF-IDF (log
counts) and normalised. Each language has several centroids, found by spherical k-means; a text gets the language
of the centroid nearest by cosine, and is rejected if even that one is too far for a text of its length. How far
texts of a length are is learned from the beginnings of the training texts: short ones lie farther off.

All labelled training rows are learned from: their gram counts are written once, packed, and give the document frequencies
and, a pass over them for each round, the centroids; their beginnings give the thresholds. Tasks send sums by centroid, in
whole numbers, so that the order of rows and tasks changes nothing; only centroids and frequencies come to the driver. A
language begins with one centroid and is split into those nearer and farther than the mean until it has enough.

Defined results: a text that is null, empty or without any letter is "und" with score 0 and rejected; a text
whose best cosine is below the threshold of its length keeps the nearest language in lang_pred and is rejected; without any
training row everything is "und"; rows that repeat an id count as often as they occur; predict() carries all columns but those
named lang_pred, score and rejected, which it replaces. However many languages there are, all are learned.
Whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import discard, materialize, shuffles_go

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 5
#: Weights are summed as multiples of 1 / SCALE; sums travel in blocks of so many dimensions.
SCALE, BLOCK = 1 << 24, 512
#: A text is rejected below this share of the cosine that all but one in a hundred beginnings of training texts with as many grams reach.
REJECT_SHARE = 0.85
#: Letters of the shorter ones of those beginnings, which are counted for many texts at once; the longer ones go on doubling as far as the text does.
#: Gram counts fall into buckets by their power of two; one with fewer beginnings than LEAST_KNOWN takes the threshold of the next shorter one.
#: Their cosines are rounded to so many digits, so that their counts stay few.
BEGINNINGS, LEAST_KNOWN, COSINE_DIGITS = (1, 2, 4, 8, 16, 32, 64, 128, 256), 20, 4
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
    low = codes < 0x10000
    out = np.zeros(len(codes), bool)
    out[low] = _LETTER[codes[low]]
    for c in np.unique(codes[~low]):
        out[codes == c] = chr(int(c)).isalpha()
    return out


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed grams of the whole text; None if it has no letter. A run of other characters is one gap."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(codes)
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[letter | np.concatenate([[True], letter[:-1]])]
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    return np.bincount(np.concatenate(_hashed(codes)), minlength=DIMENSIONS)


def _hashed(codes: np.ndarray) -> list[np.ndarray]:
    """The hashed one-, two- and three-letter grams at each place."""
    one = codes * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(31) + codes[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(37) + codes[2:] * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    out = []
    for mixed in (one, two ^ np.uint32(0x5BD1E995), three ^ np.uint32(0x27D4EB2F)):
        mixed = mixed ^ mixed >> np.uint32(16)
        out.append(mixed * np.uint32(0x7FEB352D) >> shift)
    return out


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What grams() counts, of many short texts at once: the text's number, the gram and its count, by text."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lower), np.int64, len(texts)))
    letter, first = _letters(codes), np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
    some = np.bincount(own[letter], minlength=len(texts)) > 0
    kept = (letter | first | np.concatenate([[True], letter[:-1]])[: len(own)]) & some[own]
    codes, own = np.where(letter, codes, np.uint32(32))[kept], own[kept]
    # a gap before and after each
    padded = np.full(len(codes) + 2 * int(some.sum()), 32, np.uint32)
    padded[np.arange(len(codes)) + 2 * np.cumsum(some)[own] - 1] = codes
    own = np.repeat(np.arange(len(texts)), np.where(some, np.bincount(own, minlength=len(texts)) + 2, 0))
    places = [n * DIMENSIONS + h for n, h in ((own[: len(h)][own[: len(h)] == own[k:]], h[own[: len(h)] == own[k:]]) for k, h in enumerate(_hashed(padded)))] if len(padded) else [own]
    times = np.bincount(np.concatenate(places), minlength=1)
    at = times.nonzero()[0]
    return at // DIMENSIONS, at % DIMENSIONS, times[at]


@dataclass
class CentroidModel:
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    thresholds: np.ndarray  # by bucket of gram counts; texts longer than any beginning take the last

    def threshold(self, n: int) -> float:
        """For a text of n grams."""
        return float(self.thresholds[min(int(n).bit_length(), len(self.thresholds)) - 1])

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, whether it is rejected."""
        counts = grams(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(counts)
        k = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[k])))
        return self.languages[self.owner[k]], score, score < self.threshold(counts.sum())

    def nearness(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and best cosines of all beginnings of texts; whole texts would find themselves in the centroids."""
        row, gram, n = grams_of([text[:k] for text in texts for k in BEGINNINGS if len(text) > k])
        buckets, cosines = np.zeros(0, np.int64), np.zeros(0)
        if len(row):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            v = np.log1p(n) * self.idf[gram]
            near = np.add.reduceat(self.centroids.T[gram] * v[:, None], starts, axis=0).max(1)
            buckets, cosines = np.frexp(np.add.reduceat(n, starts))[1] - 1, near / np.sqrt(np.add.reduceat(v * v, starts))
        longer = [g for text in texts for g in self._longer(text)]
        return np.append(buckets, [int(g.sum()).bit_length() - 1 for g in longer]).astype(np.int64), np.append(cosines, [(self.centroids @ self.vector(g)).max() for g in longer])

    @staticmethod
    def _longer(text: str) -> Iterator[np.ndarray]:
        """Gram counts of the beginnings beyond BEGINNINGS, each twice as long as the one before."""
        k = 2 * BEGINNINGS[-1]
        while k < len(text):
            counts = grams(text[:k])
            if counts is not None:
                yield counts
            k *= 2

    def calibrate(self, known: dict[int, tuple[int, float]]) -> None:
        """Sets the thresholds. known: by bucket how many beginnings there were and the first percentile of their cosines."""
        self.thresholds = np.zeros(max(known, default=0) + 1)
        for b in range(len(self.thresholds)):
            n, low = known.get(b, (0, 0.0))
            self.thresholds[b] = REJECT_SHARE * low if n >= LEAST_KNOWN else self.thresholds[b - 1] if b else 0.0


def pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Which grams a text has, as bits, and how often, in as few bytes a number as its largest needs."""
    there = counts > 0
    times = counts[there]
    return np.packbits(there).tobytes(), times.astype(np.min_scalar_type(times.max())).tobytes()


def unpack(marks: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed texts one after the other: the text's number, the gram and its count."""
    row, gram = np.divmod(np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(marks), np.uint8)).view(bool)), DIMENSIONS)
    kinds = np.bincount(row, minlength=len(marks)).tolist()
    return row, gram, np.concatenate([np.frombuffer(t, f"u{len(t) // k}") for t, k in zip(times, kinds)])


@dataclass
class Centres:
    """Of each language (first axis) its centroids so far. far: where texts below the limit of their nearest centroid go."""

    at: np.ndarray
    have: np.ndarray
    limit: np.ndarray
    far: np.ndarray

    def own(self, near: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The centroid of each text. near: its cosines to the centroids of its language."""
        near = np.where(np.arange(near.shape[1]) < self.have[language][:, None], near, -np.inf)
        own = near.argmax(1)
        return np.where(near.max(1) < self.limit[language, own], self.far[language, own], own)


#: By language and centroid: how many texts it has and the sum of their vectors, times SCALE.
Sums = dict[tuple[int, int], tuple[int, np.ndarray]]


def grow(sums: Callable[[Centres], Sums], languages: int, dimensions: int, k: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Spherical k-means of each language: all texts in one, then splits by the mean cosine, `rounds` rounds after each. A centroid that loses all texts goes."""
    c = Centres(np.zeros((languages, k, dimensions)), np.ones(languages, np.int64), np.full((languages, k), -np.inf), np.zeros((languages, k), np.int64))
    size, mean = np.zeros((languages, k), np.int64), np.zeros((languages, k))

    def step() -> bool:
        """Whether any centroid has moved."""
        before = c.at.copy()
        found = sums(c)
        c.at[:], c.have[:], c.limit[:], size[:] = 0, 0, -np.inf, 0
        for language, j in sorted(found):
            n, total = found[language, j]
            length, at = float(np.linalg.norm(total.astype(np.float64))), (language, int(c.have[language]))
            c.at[at], size[at], mean[at] = total / max(length, 1e-12), n, length / SCALE / n
            c.have[language] += 1
        return not np.array_equal(before, c.at)

    step()
    for _ in range((k - 1).bit_length()):
        for language, have in enumerate(c.have.tolist()):
            for i, j in enumerate(np.argsort(-size[language, :have], kind="stable")[: k - have].tolist()):
                c.limit[language, j], c.far[language, j] = mean[language, j], have + i
        for _ in range(rounds + 1):
            if not step():
                break
    return [c.at[language, :have] for language, have in enumerate(c.have.tolist())]


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """What grow() finds for one language whose vectors are all at hand."""
    whole = np.rint(vectors.astype(np.float64) * SCALE).astype(np.int64)

    def sums(c: Centres) -> Sums:
        own = c.own(vectors @ c.at[0].T, np.zeros(len(vectors), np.int64))
        return {(0, int(j)): (int((own == j).sum()), whole[own == j].sum(0)) for j in np.unique(own)}

    return grow(sums, 1, vectors.shape[1], k, rounds)[0]


PART = pa.schema([("centre", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])


def _parts(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
    rows = [(centre, block, n, part.tobytes()) for centre, (n, total) in held.items() for block, part in enumerate(np.split(total, DIMENSIONS // BLOCK))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PART)], schema=PART)


def _added(parts: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Sums of all tasks, added up in Spark; a few KB for each centroid come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            for centre, block, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
                m, total = held.get((centre, block), (0, 0))
                held[centre, block] = m + n, total + np.frombuffer(sums, np.int64)
        rows = [(*key, n, total.tobytes()) for key, (n, total) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PART)], schema=PART)

    found: dict[int, tuple[int, np.ndarray]] = {}
    with shuffles_go(parts.sparkSession):
        rows = parts.repartition("centre", "block").mapInArrow(add, "centre long, block int, n long, sums binary").collect()
    for r in rows:
        total = found.setdefault(r["centre"], (r["n"], np.zeros(DIMENSIONS, np.int64)))[1]
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], np.int64)
    return found


def _centroids(texts: DataFrame, languages: list[str], idf: np.ndarray, k: int) -> list[np.ndarray]:
    """texts: lang, marks, times of every training text."""
    number = {name: i for i, name in enumerate(languages)}

    def sums(c: Centres) -> Sums:
        flat = c.at.transpose(0, 2, 1).reshape(-1, k)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for lo in range(0, batch.num_rows, 128):
                    names, marks, times = (x.to_pylist() for x in batch.slice(lo, 128).columns)
                    language = np.array([number[x] for x in names])
                    row, gram, n = unpack(marks, times)
                    starts = np.searchsorted(row, np.arange(len(names)))
                    weight = np.log1p(n, dtype=np.float64) * idf[gram]
                    weight /= np.sqrt(np.add.reduceat(weight * weight, starts))[row]
                    near = np.add.reduceat(flat[language[row] * DIMENSIONS + gram] * weight[:, None], starts, axis=0)
                    there, place = np.unique(language * k + c.own(near, language), return_inverse=True)
                    total = np.bincount(place[row] * DIMENSIONS + gram, weights=np.rint(weight * SCALE), minlength=len(there) * DIMENSIONS)
                    for centre, m, x in zip(there.tolist(), np.bincount(place).tolist(), total.astype(np.int64).reshape(-1, DIMENSIONS)):
                        old, before = held.get(centre, (0, 0))
                        held[centre] = old + m, before + x
                    if len(held) > 256:
                        yield _parts(held)
                        held.clear()
            yield _parts(held)

        return {divmod(centre, k): x for centre, x in _added(texts.mapInArrow(tally, "centre long, block int, n long, sums binary")).items()}

    return grow(sums, len(languages), DIMENSIONS, k)


def fit(docs: DataFrame, trainable: Column | None = None, text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS) -> CentroidModel:
    """trainable: which rows may be learned from; rows without a language never are."""
    lang = F.col(f"`{lang_col}`")
    rows = docs.where(lang.isNotNull() & (F.lit(True) if trainable is None else trainable)).select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("marks", pa.binary()), ("times", pa.binary()), *PART])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with a letter, and for each task its document frequencies."""
        frequency, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for language, text in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns)):
                    counts = grams(text)
                    if counts is not None:
                        frequency += counts > 0
                        out.append((language, *pack(counts)))
                n += len(out)
                none = [None] * len(out)
                yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in out], schema[i].type) for i in range(3)], *[pa.array(none, f.type) for f in PART]], schema=schema)
        part = _parts({0: (n, frequency)})
        none = [None] * part.num_rows
        yield pa.RecordBatch.from_arrays([*[pa.array(none, schema[i].type) for i in range(3)], *part.columns], schema=schema)

    counted = materialize(rows.mapInArrow(count, "lang string, marks binary, times binary, centre long, block int, n long, sums binary"), "lang-fit")
    n, frequency = _added(counted.where("block is not null").select(*PART.names)).get(0, (0, np.zeros(DIMENSIONS, np.int64)))
    texts = counted.where("block is null").select("lang", "marks", "times")
    model = CentroidModel([], np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32), (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32), np.zeros(1))
    languages = sorted(r["lang"] for r in texts.select("lang").distinct().collect())  # the model has each of them
    if languages:
        found = _centroids(texts, languages, model.idf, centroids)
        model.languages = languages
        model.owner = np.repeat(np.arange(len(found)), [len(c) for c in found])
        model.centroids = np.concatenate(found).astype(np.float32)
    discard(counted)
    if not languages:
        return model

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: how many beginnings each bucket and cosine has."""
        held: Counter[tuple[int, float]] = Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                buckets, cosines = model.nearness(batch.column(0).slice(lo, 32).to_pylist())
                held.update(zip(buckets.tolist(), np.round(cosines, COSINE_DIGITS).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int32()), pa.array([c for _, c in held], pa.float64()), pa.array(held.values(), pa.int64())], names=["bucket", "cosine", "times"])

    begins = rows.where("text is not null").select("text")
    # no more rows than there are buckets and rounded cosines, however many texts
    known = begins.mapInArrow(near, "bucket int, cosine double, times long").groupBy("bucket", "cosine").agg(F.sum("times").alias("times"))
    buckets = known.groupBy("bucket").agg(F.sum("times").alias("n"), F.percentile("cosine", 0.01, F.col("times")).alias("low"))
    model.calibrate({r["bucket"]: (r["n"], r["low"]) for r in buckets.collect()})  # a row for each power of two
    return model


def predict(docs: DataFrame, model: CentroidModel, text_col: str = "text") -> DataFrame:
    """docs and lang_pred, score, rejected. The model, some hundred KB, goes with the tasks."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    # so marked, a filter by what is found doesn't have it found a second time
    found = docs.withColumn("__language", judged.asNondeterministic()(F.col(f"`{text_col}`")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")], "__language.lang_pred", "__language.score", "__language.rejected")


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 without an id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds, F.lit(-1))
