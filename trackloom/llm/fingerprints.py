"""Context-triggered piecewise hashing of documents, compared by edit distance.

A rolling hash over seven bytes cuts a text wherever its value modulo the block size is the block size less one,
so cuts depend on the nearby bytes alone and an edit changes the chunks around it. A chunk leaves one character,
six bits of its hash. The block size is 3 * 2^k with the smallest k that leaves at most 63 cuts; the fingerprint is
"size:signature:signature at twice the size", so that texts whose sizes differ by a factor of two still compare.
Likeness is 1 less the edit distance (insertions and deletions 1, replacements 2) over both lengths, at the larger
compatible block size that both have, and 0 if no run of characters is common or no size is compatible.

Defined results: null counts as empty; the fingerprint of an empty text is "3::", alike (1) to itself and to
nothing else (0); equal texts have equal fingerprints and likeness 1; whole texts are read, however long; rows that repeat an
id lie in one range; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import shuffle_partitions, text_or_empty

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, SMALLEST, MOST_CUTS, RUN = 7, 3, 63, 5
#: Text of a range of ids, and how many ranges there are at most; how finely work is dealt, not what comes out.
RANGE_BYTES, MOST_RANGES = 32 << 20, 16_384


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Of the seven bytes that end at each position (fewer at the start), as uint32."""
    x = data.astype(np.uint32)
    h = x * np.uint32(0x9E3779B1)
    factor = 0x9E3779B1
    for back in range(1, WINDOW):
        factor = factor * 0x85EBCA6B & 0xFFFFFFFF
        if back < len(x):
            h[back:] += x[:-back] * np.uint32(factor)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _signature(data: bytes, cuts: np.ndarray) -> str:
    edges = [0, *(cuts + 1).tolist()]
    if edges[-1] < len(data):
        edges.append(len(data))
    return "".join([ALPHABET[xxhash.xxh3_64_intdigest(data[a:b]) & 63] for a, b in zip(edges, edges[1:])])


def fingerprint(data: bytes) -> str:
    if not data:
        return f"{SMALLEST}::"
    h = rolling_hash(np.frombuffer(data, np.uint8))
    size = SMALLEST
    while len(data) / (4 * size) > MOST_CUTS:  # far more cuts than fit are not worth finding
        size *= 2

    def cut(size: int) -> np.ndarray:
        return np.flatnonzero(h % np.uint32(size) == np.uint32(size - 1))

    cuts = cut(size)
    while size > SMALLEST and len(cuts) <= MOST_CUTS:  # a smaller size may do as well
        smaller = cut(size // 2)
        if len(smaller) > MOST_CUTS:
            break
        size, cuts = size // 2, smaller
    while len(cuts) > MOST_CUTS and size < SMALLEST << 28:
        size *= 2
        cuts = cuts[h[cuts] % np.uint32(size) == np.uint32(size - 1)]
    wide = cuts[h[cuts] % np.uint32(2 * size) == np.uint32(2 * size - 1)]
    return f"{size}:{_signature(data, cuts)}:{_signature(data, wide)}"


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest, with the rows of the table as bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(RUN, (min(len(a), len(b)) + 1) // 2)
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common_subsequence(a, b) / (len(a) + len(b))  # = 1 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1, of two fingerprints."""
    if a == b:
        return 1.0
    (na, sa, wa), (nb, sb, wb) = a.split(":"), b.split(":")
    na, nb = int(na), int(nb)
    if not sa or not sb:
        return 0.0
    if na == nb:
        return max(_alike(sa, sb), _alike(wa, wb))
    if na == 2 * nb:
        return _alike(sa, wb)
    if nb == 2 * na:
        return _alike(wa, sb)
    return 0.0


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs and a column with each text's fingerprint, in place of one that has its name."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint((t or "").encode()))

    return docs.withColumn(out, prints(F.col(f"`{text_col}`")))


def edges_below(value: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are below a value (0 for null), by binary search, native: a Python UDF would have each task hold its texts meanwhile."""
    if not edges:
        return F.lit(0)
    at = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<long>")  # a literal, once it is planned
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(at, n + step - 1) < value, step).otherwise(0))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against itself with the last third replaced by the start of the next document, and against that.

    Next is by descending id (ties: descending text; rows without an id last); after the last comes the first. Ids are cut into
    ranges at quantiles, one for every `RANGE_BYTES` of text; a range is one sorted run, each in a task of its own, and each range also gets a
    copy of the first row of the range after it, so every text is shuffled once and no task sees more than its range (those without an id share one).
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_RANGES, max(shuffle_partitions(spark), -(-size // RANGE_BYTES)))
    splits = base.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0]
    edges = sorted(set(splits or []))
    of_range = F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(len(edges) - edges_below(F.col("doc_id"), edges)).cast("int")
    base = base.withColumn("range", of_range)
    # one row for each range, of which there are as many as we asked for above (quantiles go through doubles, so edges needn't be ids)
    heads = sorted(((r["range"], r["head"]) for r in base.groupBy("range").agg(F.max("doc_id").alias("head")).collect()), key=lambda r: r[0])
    if not heads:
        return spark.createDataFrame([], OUT)
    follows = [(heads[i][0], heads[(i + 1) % len(heads)][1]) for i in range(len(heads))]
    first = F.broadcast(spark.createDataFrame(follows, "range int, head long"))
    guests = base.drop("range").join(first, F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("range", "doc_id").agg(F.max("text").alias("text"))
    rows = base.select("range", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests.select("range", "doc_id", "text", F.lit(True).alias("guest")))
    rows = rows.repartitionById(n, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row that waits for its next: doc_id, text, fingerprint
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out: list[tuple] = []
                for doc, text, guest in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    own = fingerprint(text.encode())
                    if before is not None:
                        doc0, text0, print0 = before
                        cut = len(text0) // 3
                        edited = (text0[: len(text0) - cut] + text[:cut]).encode()
                        print1 = fingerprint(edited)
                        out.append((doc0, len(text0), hashlib.sha256(edited).hexdigest(), print0, print1, likeness(print0, print1), likeness(print0, own)))
                    before = None if guest else (doc, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, OUT)
