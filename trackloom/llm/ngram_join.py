"""Similarity self-join of documents on word shingles by rare-first prefix filtering.

Two documents link when |A & B| / |A | B| of their sets of five-word shingles is 0.8 or more. All figures below
are exact bounds, so no link is lost:

* Documents with equal sets are one class (a 64-bit hash of the sorted set); only classes are joined.
* Shingles are ordered rare first, by counts over all documents in a table of 2^22 counters, ties by hash. Any
  one order serves for the bounds; the counts, to a sixteenth of an octave, put what many documents share at the end,
  outside the prefix.
* A class posts its first n - ceil(0.8 n) + 1 shingles. Classes that can link share a posting, and the smaller one
  has it among its first n - ceil(8n/9) + 1 (prefix filter). Their sizes differ by no more than 0.8 (length
  filter), and the places of the shared shingle must leave room for the overlap needed (positional filter).
* What follows the shared shingle in both sets is cut at the same `PARTS` - 1 pivots of the one order. The parts of one set
  can only meet the like parts of the other, so the differences of their sizes add up to a lower bound of how far the
  suffixes differ (suffix filter, all levels of its recursion at once). A class carries only the sizes of its parts; those of
  any of its suffixes follow from them, for parts are ranges of the order.
* Where as many shingles were added as taken away in a part, its size tells nothing: 512 parity bits by hash bound the
  difference of the whole sets from below as well.
* What is left is verified on the whole texts, each pair once.

Lists are not expanded into pairs. First every class in a list is tried against the list's first (the class with
the fewest rarer shingles: an unedited original) and against the one before it, which is linear in the list;
verified links make components. Then only pairs of different components in a list are left, and those go through
the filters in blocks of at most about `BLOCK` rows squared. A list that outgrows a block is split over
block pairs, so no task ever holds an unbounded list. Pairs within one component are never formed: they cannot
change the result.

Defined results: words are runs of other than ASCII white space with A-Z in lower case; fewer than five words make
one shingle; null, empty or blank texts have no shingle and link with nothing; equal texts link; repeated rows are
documents like any other; rows without an id link like others, and their component_id is the least id of those they are linked
with, null if none has one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import discard, materialize, shuffle_partitions, shuffles_go
from trackloom.llm.components import components, merge

WORDS, PERCENT = 5, 80
COUNTER_BITS, COUNTER_BLOCKS, PARTS, PARITY, BLOCK = 22, 64, 32, 512, 1024
#: Counters are kept as steps of 1/16 octave. A part of more shingles than 16 bits hold leaves its class out of the suffix filter.
OCTAVE, FULL = 16, 65535
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    s = np.zeros(n, np.uint64)
    for k in range(words):
        s = (s ^ h[k : k + n]) * np.uint64(_FACTORS[k % len(_FACTORS)])
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a row is found again by: 64 bits of its id and text."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def class_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


class Order:
    """Rare first: shingles by (level of their counter, hash), and the parts that the pivots make of that order."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels
        kinds = np.bincount(levels)
        mass = kinds * (np.exp2(np.arange(len(kinds)) / OCTAVE) - 1)
        below = np.cumsum(mass) - mass
        self.below, self.mass = below / max(mass.sum(), 1e-9) * PARTS, mass / max(mass.sum(), 1e-9) * PARTS

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.levels[s >> np.uint64(64 - COUNTER_BITS)]

    def parts(self, s: np.ndarray) -> list[int]:
        """How many shingles each part has, four 16-bit numbers to a long."""
        level = self.of(s)
        part = np.minimum(self.below[level] + self.mass[level] * (s / 2.0**64), PARTS - 1).astype(np.int64)
        sizes = np.bincount(part, minlength=PARTS)
        return (sizes if sizes.max() < FULL else np.full(PARTS, FULL)).astype(np.uint16).view(np.int64).tolist()


def parities(s: np.ndarray) -> list[int]:
    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def suffix_sizes(parts: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Of rows of part sizes, the sizes of what follows the shingle at place pos in the order."""
    return np.clip(np.cumsum(parts, axis=1) - (pos[:, None] + 1), 0, parts)


def needed(na, nb, percent: int = PERCENT):
    """The least overlap of a link: ceil(percent / (100 + percent) * (na + nb))."""
    return -(-percent * (na + nb) // (100 + percent))


def possible(na, pa_, nb, pb, percent: int = PERCENT):
    """Length, prefix and positional filter of arrays (or numbers): sizes n and places p of a shared shingle."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    first = np.where(na <= nb, pa_, pb)
    within = (first <= small - needed(small, small, percent)) | ((na == nb) & (np.minimum(pa_, pb) <= small - needed(small, small, percent)))
    room = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (100 * small >= percent * large) & within & (room >= needed(na, nb, percent))


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _slices(batches: Iterator[pa.RecordBatch], n: int = 200) -> Iterator[list[list]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, n):
            yield [c.to_pylist() for c in batch.slice(lo, n).columns]


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """A written table: a row per document (doc_id, row, n, cls), and per task its counters in zipped blocks (block, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << COUNTER_BITS, np.uint32), [], 0

        def add() -> None:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            counts[found] += times.astype(np.uint32)
            held.clear()

        for ids, texts, row in _slices(batches):
            n, cls = [], []
            for text in texts:
                s = shingles(text, words)
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                held.append((s >> np.uint64(64 - COUNTER_BITS)).astype(np.int32))
                size += len(s)
            if size > 1 << 20:
                add()
                size = 0
            yield _rows([ids, row, n, cls, [None] * len(ids), [None] * len(ids)], schema)
        if held:
            add()
        blocks = [zlib.compress(b.tobytes(), 1) for b in np.split(counts, COUNTER_BLOCKS)]
        none = [None] * COUNTER_BLOCKS
        yield _rows([none, none, none, none, list(range(COUNTER_BLOCKS)), blocks], schema)

    return materialize(docs.mapInArrow(run, "doc_id long, row long, n long, cls long, block int, counts binary"), "join-docs")


def _add_counters(described: DataFrame) -> np.ndarray:
    """The levels of the counters of all documents: 2^22 numbers of 16 bits, whatever the size of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, zipped in zip(*(c.to_pylist() for c in batch.columns)):
                got = np.frombuffer(zlib.decompress(zipped), np.uint32).astype(np.int64)
                total[block] = total[block] + got if block in total else got
        for block, got in total.items():
            level = np.round(np.log2(1.0 + got) * OCTAVE).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "counts"])

    with shuffles_go(described.sparkSession):
        parts = described.where("block is not null").select("block", "counts").repartition(COUNTER_BLOCKS, "block").mapInArrow(run, "block int, counts binary").collect()
    out = np.zeros((COUNTER_BLOCKS, (1 << COUNTER_BITS) // COUNTER_BLOCKS), np.uint16)
    for r in parts:
        out[r["block"]] = np.frombuffer(r["counts"], np.uint16)
    return out.ravel()


def _postings(docs: DataFrame, counters, words: int, percent: int) -> DataFrame:
    """list (a shingle), cls, n, pos: the prefix of each class, once a task."""
    schema = pa.schema([("list", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(np.frombuffer(counters.value, np.uint16)), set()
        for _, texts, _ in _slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for text in texts:
                s = shingles(text, words)
                n = len(s)
                if not n or (cls := class_of(s)) in seen:
                    continue
                seen.add(cls)
                prefix = n - -(-percent * n // 100) + 1
                rare = np.argsort(order.of(s), kind="stable")[:prefix]  # s is sorted: ties by hash
                for c, x in zip(out, (s[rare].view(np.int64), np.full(prefix, cls), np.full(prefix, n, np.int32), np.arange(prefix, dtype=np.int32))):
                    c.append(x)
            if out[0]:
                yield _rows([np.concatenate(c) for c in out], schema)

    return docs.mapInArrow(run, "list long, cls long, n int, pos int")


LINKS = pa.schema([("kind", pa.int32()), ("list", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """A written table: postings of lists of two classes or more (kind 0), and pairs to try first (kind 1: a, b).

    Lists come sorted by place, so the first of a list has the fewest rarer shingles. Only that one and the last row are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held[0])
            x, cls, n, pos = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns))
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (cls[1:] != cls[:-1])
            new[:old] = True
            x, cls, n, pos = x[new], cls[new], n[new], pos[new]
            start = np.ones(len(x), bool)
            start[1:] = x[1:] != x[:-1]
            first = np.maximum.accumulate(np.where(start, np.arange(len(x)), 0))
            several = ~start
            several[:-1] |= ~start[1:]
            if old == 2:
                several[:2] = False
            at = np.flatnonzero(several)
            to_first = np.flatnonzero(~start)
            to_first = to_first[to_first >= old]
            to_last = to_first[to_first - 1 != first[to_first]]
            i, j = np.concatenate([to_first, to_last]), np.concatenate([first[to_first], to_last - 1])
            ok = possible(n[i].astype(np.int64), pos[i].astype(np.int64), n[j].astype(np.int64), pos[j].astype(np.int64), percent)
            pairs = np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1)[ok]
            pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
            k, m = len(at), len(pairs)
            if k or m:
                zero, none = np.zeros(m, np.int32), np.zeros(k, np.int64)
                yield _rows([np.concatenate([np.zeros(k, np.int32), np.ones(m, np.int32)]), np.concatenate([x[at], np.zeros(m, np.int64)]), np.concatenate([cls[at], pairs[:, 0]]), np.concatenate([none, pairs[:, 1]]), np.concatenate([n[at], zero]), np.concatenate([pos[at], zero])], LINKS)
            last = len(x) - 1
            keep = [first[last]] if first[last] == last else [first[last], last]
            held = [c[keep] for c in (x, cls, n, pos)]

    spark = postings.sparkSession
    dealt = postings.repartition(shuffle_partitions(spark), "list").sortWithinPartitions("list", "pos", "n", "cls")
    return materialize(dealt.mapInArrow(run, "kind int, list long, a long, b long, n int, pos int"), "join-lists")


def _texts(docs: DataFrame, described: DataFrame, lists: DataFrame, counters, words: int) -> DataFrame:
    """A written table: cls, n, parts, odd, text of one document of each class that is in a list."""
    wanted = lists.where("kind = 0").select(F.col("a").alias("cls")).distinct()
    chosen = described.where("cls is not null").groupBy("cls").agg(F.min("row").alias("chosen")).join(wanted, "cls", "left_semi")
    found = docs.join(chosen, F.col("row") == F.col("chosen")).select("cls", "text")
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("parts", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(np.frombuffer(counters.value, np.uint16)), set()
        for cls, texts in _slices(batches):
            sets = [shingles(t, words) if c not in seen else None for c, t in zip(cls, texts)]
            same = [k for k, s in enumerate(sets) if s is not None and len(s) and class_of(s) == cls[k]]  # another row may have the same 64-bit name
            seen.update(cls[k] for k in same)
            yield _rows([[cls[k] for k in same], [len(sets[k]) for k in same], [order.parts(sets[k]) for k in same], [parities(sets[k]) for k in same], [texts[k] for k in same]], schema)

    return materialize(found.mapInArrow(run, "cls long, n long, parts array<long>, odd array<long>, text string").dropDuplicates(["cls"]), "join-texts")


def _differ(a: Column, b: Column) -> Column:
    """At least how many shingles only one of two whole sets has, by (parts, odd): the sizes of their parts, unless beyond 16 bits, and their parities."""
    bits = F.zip_with(a["odd"], b["odd"], lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    by_bits = F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)
    a, b = a["parts"], b["parts"]
    part = lambda x, k: F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(FULL))
    off = F.zip_with(a, b, lambda x, y: sum((F.abs(part(x, k) - part(y, k)) for k in range(1, 4)), F.abs(part(x, 0) - part(y, 0))))
    full = lambda c: F.get(c, F.lit(0)).bitwiseAND(F.lit(FULL)) == FULL
    by_parts = F.aggregate(off, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.greatest(by_bits, F.when(~(full(a) | full(b)), by_parts))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """A written table: those of pairs(a, b) that link."""
    marks = texts.select("cls", "n", F.struct("parts", "odd").alias("m"))
    left = marks.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("m").alias("sa"))
    right = marks.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("m").alias("sb"))
    total = F.col("na") + F.col("nb")
    most = total - 2 * F.ceil(F.lit(percent) * total / F.lit(100 + percent))
    near = pairs.join(left, "a").join(right, "b").where(_differ(F.col("sa"), F.col("sb")) <= most).select("a", "b")
    near = near.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for a, b, ta, tb in _slices(batches):
            if sum(map(len, sets.values())) > 4_000_000:
                sets.clear()
            out: list[list[int]] = [[], []]
            for x, y, s, t in zip(a, b, ta, tb):
                if x not in sets:
                    sets[x] = shingles(s, words)
                if y not in sets:
                    sets[y] = shingles(t, words)
                p, q = sets[x], sets[y]
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    out[0].append(x)
                    out[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return materialize(near.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "join-links")


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """A written table: the postings with the component of their class."""
    rows = lists.where("kind = 0").select("list", F.col("a").alias("cls"), "n", "pos")
    rows = rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return materialize(rows, "join-rooted")


def _cross(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within a list that pass all filters."""
    spark = rows.sparkSession
    unsettled = rows.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("m > 2 and lo <> hi").select("list", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks"))
    rows = rows.join(unsettled, "list").join(texts.select("cls", "parts", "odd"), "cls")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "n", "pos", "root", *[F.col(c)[k].alias(f"{c}{k}") for c, n in (("parts", PARTS // 4), ("odd", PARITY // 64)) for k in range(n)])
    rows = rows.repartition(shuffle_partitions(spark), "list", "i", "j").sortWithinPartitions("list", "i", "j", "n")

    def compare(own, cls, n, pos, root, marks, i, j) -> Iterator[np.ndarray]:
        odd, parts = marks[:, PARTS // 4 :], np.ascontiguousarray(marks[:, : PARTS // 4]).view(np.uint16).astype(np.int64)
        full, after = parts[:, 0] == FULL, suffix_sizes(parts, pos)
        for k in range(len(cls) - 1):
            hi = int(np.searchsorted(n, 100 * n[k] // percent, side="right"))
            if hi <= k + 1:
                continue
            s = slice(k + 1, hi)
            ok = (root[s] != root[k]) & possible(n[k], pos[k], n[s], pos[s], percent)
            if i != j:
                ok &= own[s] != own[k]
            at = np.flatnonzero(ok) + k + 1
            if len(at):
                # what the suffixes may differ by at most, if all before them were common
                room = n[k] - pos[k] + n[at] - pos[at] - 2 - 2 * (needed(n[k], n[at], percent) - np.minimum(pos[k], pos[at]) - 1)
                at = at[full[k] | full[at] | (np.abs(after[at] - after[k]).sum(1) <= room)]
                gap = np.bitwise_count((odd[at] ^ odd[k]).view(np.uint64)).sum(1, dtype=np.int64)
                at = at[gap <= n[k] + n[at] - 2 * needed(n[k], n[at], percent)]
                if len(at):
                    yield np.stack([np.minimum(cls[at], cls[k]), np.maximum(cls[at], cls[k])], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def groups(cols: list[np.ndarray], edges: np.ndarray) -> Iterator[np.ndarray]:
            for lo, hi in zip(edges, edges[1:]):
                if hi - lo > 1:
                    g = [c[lo:hi] for c in cols]
                    yield from compare(g[3], g[4], g[5], g[6], g[7], np.stack(g[8:], axis=1), g[1][0], g[2][0])

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            edges = np.concatenate([[0], new])
            yield batch_of(list(groups(cols, edges)))
            held = [c[edges[-1] :] for c in cols]
        if held is not None:
            yield batch_of(list(groups(held, np.array([0, len(held[0])]))))

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, with_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    with_rows: and row (row_hash of the document) and root, which names its component and is null for texts without words.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), row_hash(id_col, text_col).alias("row"))
    written = _describe(base, words)
    counters = spark.sparkContext.broadcast(_add_counters(written).tobytes())
    described = written.where("block is null").select("doc_id", "row", "n", "cls")
    lists = _lists(_postings(base, counters, words, percent), percent)
    texts = _texts(base, described, lists, counters, words)
    counters.destroy()  # what was made with it is written
    tried = lists.where("kind = 1").select("a", "b").distinct()
    links = _verified(tried, texts, words, percent)
    roots = components(links)
    rooted = _rooted(lists, roots)
    more = _verified(_cross(rooted, texts, percent).join(tried, ["a", "b"], "left_anti"), texts, words, percent)
    discard(lists, rooted, texts)
    roots = merge(roots, more)

    least = described.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    of_class = materialize(least.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root")), "join-classes")
    discard(links, more)
    of_root = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = of_class.join(of_root, "root").select("cls", "root", "component_id")
    found = described.join(labels, "cls", "left")
    # a text without words has no class
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *(["row", "root"] if with_rows else []))
