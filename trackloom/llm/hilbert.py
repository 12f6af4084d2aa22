"""Sharding along a Hilbert curve, so that every shard covers a compact part of several metadata dimensions.

Each dimension is quantised by rank: a value's cell is the share of rows with smaller values, in 2^bits steps, so that every
step holds about as many rows whatever the values are. The cells' index on the curve is folded bit by bit, from the highest,
through a table of the curve's orientations that `curve_tables` makes from the rule. Rows sorted by that index are cut into runs, one a
shard: neighbours on the curve are neighbours in all dimensions, so the shards' smallest and largest values let a reader skip files by any of them.

Law `rows`: shard i holds the ranks from ceil(i * n / shards) on, so counts differ by one at most. Law `bytes`: the shard is
where the middle of a row lies among all bytes, so a run misses its share by less than a row at each end.

Running totals over all rows take no single task: rows are dealt by ranges of the order, whose last key is the row's place in a written table, so no key is
too hot to cut; totals of the ranges, one row a partition, are added up and joined back. A value that a third of
all rows share is one row when values are ranked, and a hot side of a join that Spark splits. All of it is DataFrame operations.

Defined results: null dimension values sort before all others; null text has no bytes and no checksum of its own (that of the
empty text); rows that are equal in all dimensions are ordered by a hash of their text and by id, so equal texts of one origin lie together; repeated
rows count as often as they occur; with fewer rows than shards some shards are empty; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm._common import materialize, shuffle_partitions, text_or_empty

SHARDS, BITS, EXTRA_BYTES = 24, 8, 8
DIMENSIONS: tuple[str, ...] = ("lang", "source", "size")


def curve_tables(dimensions: int) -> tuple[list[int], list[int]]:
    """Orientation table of the Hilbert curve: at orientation * 2^dimensions + the cell's bits, the next digit and the next orientation.

    An orientation is a corner to enter by and an axis to leave along. Cells of a level are visited in Gray-code order, turned so that
    they begin at that corner and end along that axis; bit j of a cell is that of dimension j.
    """
    size = 1 << dimensions
    turn = lambda x, k: ((x << (k % dimensions)) | (x >> (dimensions - k % dimensions))) & (size - 1)
    gray = lambda i: i ^ (i >> 1)
    place = {gray(i): i for i in range(size)}
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # noqa: E731 trailing ones of i
    digits, following = [], []
    for corner in range(size):
        for axis in range(dimensions):
            for cell in range(size):
                w = place[turn(cell ^ corner, dimensions - (axis + 1) % dimensions)]
                enter = gray(2 * ((w - 1) // 2)) if w else 0
                along = 0 if w == 0 else ones(w) if w % 2 else ones(w - 1)
                digits.append(w)
                following.append((corner ^ turn(enter, axis + 1)) * dimensions + (axis + along % dimensions + 1) % dimensions)
    return digits, following


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def curve_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates, each from 0 to 2^bits - 1."""
    n = len(cells)
    if n < 2 or n * bits > 62:
        raise ValueError("two dimensions at least, and 62 bits of index at most")
    digits, following = (F.array(*map(F.lit, t)) for t in curve_tables(n))

    def step(state: Column, bit: Column) -> Column:
        own = [F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)) * (1 << j) for j, c in enumerate(cells)]
        at = state["o"] * (1 << n) + reduce(lambda a, b: a + b, own) + 1
        return F.struct((state["h"] * (1 << n) + F.element_at(digits, at)).alias("h"), F.element_at(following, at).alias("o"))

    begin = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("o"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), begin, step, lambda s: s["h"])


def running_totals(rows: DataFrame, order: Sequence[Column], weights: dict[str, Column], label: str) -> DataFrame:
    """rows, and for each weight its sum over all rows that come before in the order. rows is a written table."""
    spark = rows.sparkSession
    # the place ends every tie, so no range of the order is too large to cut
    placed = rows.withColumn("__place", F.monotonically_increasing_id())
    keys = [*order, F.col("__place")]
    dealt = placed.withColumns({f"__w_{k}": w for k, w in weights.items()}).repartitionByRange(shuffle_partitions(spark), *keys)
    dealt = materialize(dealt.withColumn("__range", F.spark_partition_id()), label)
    ranges = dealt.groupBy("__range").agg(*[F.sum(f"__w_{k}").alias(f"__t_{k}") for k in weights])  # a row a partition
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("__range").alias("__of"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in weights])
    within = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({k: F.coalesce(F.sum(f"__w_{k}").over(within), F.lit(0)) for k in weights})
    out = summed.join(F.broadcast(ranges), F.col("__range") == F.col("__of"))  # as many rows as partitions
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(f"`{k}`") + F.col(f"__b_{k}")).alias(k) for k in weights])


def quantised(rows: DataFrame, column: str, n: int, bits: int = BITS) -> DataFrame:
    """value, cell: for each value of the column the share of the n rows with smaller values, in 2^bits steps."""
    values = materialize(rows.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("rows")), "hilbert-values")
    ranked = running_totals(values, [F.col("value").asc_nulls_first()], {"below": F.col("rows")}, "hilbert-ranks")
    return ranked.select("value", _div(F.col("below") * (1 << bits), max(n, 1)).cast("int").alias("cell"))


def shards_by_curve(docs: DataFrame, shards: int = SHARDS, law: str = "rows", dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: that is for a law by key), curve.

    size: bytes of the text and 8. dimensions: columns of docs, or size.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    text = text_or_empty(F.col(f"`{text_col}`"))
    size = (F.octet_length(text) + EXTRA_BYTES).cast("long")
    own = [(size if d == "size" else F.col(f"`{d}`")).alias(f"d{j}") for j, d in enumerate(dimensions)]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("hash"), *own)
    rows = materialize(rows, "hilbert-rows", F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    n, total = rows.figures["n"], rows.figures["bytes"] or 0
    for j in range(len(dimensions)):
        cells = materialize(quantised(rows, f"d{j}", n, bits), "hilbert-cells")
        rows = rows.join(cells.select(F.col("value").alias(f"v{j}"), F.col("cell").alias(f"c{j}")), F.col(f"d{j}").eqNullSafe(F.col(f"v{j}")))
    keyed = materialize(rows.select("doc_id", "size", "text_crc32", "hash", curve_index([F.col(f"c{j}") for j in range(len(dimensions))], bits).alias("curve")), "hilbert-keys")
    order = [F.col("curve"), F.col("hash"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    ranked = running_totals(keyed, order, {"rank": F.lit(1).cast("long"), "before": F.col("size")}, "hilbert-order")
    if law == "rows":
        ranked = ranked.withColumn("shard", _div(F.col("rank") * shards, max(n, 1)).cast("int"))
        first = _div(F.col("shard").cast("long") * n + shards - 1, shards)
    else:
        ranked = ranked.withColumn("shard", _div((2 * F.col("before") + F.col("size")) * shards, 2 * max(total, 1)).cast("int"))
        ranked = materialize(ranked, "hilbert-cut")
        heads = ranked.groupBy(F.col("shard").alias("of")).agg(F.min("rank").alias("first"))  # a row a shard
        ranked = ranked.join(F.broadcast(heads), F.col("shard") == F.col("of"))
        first = F.col("first")
    return ranked.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
