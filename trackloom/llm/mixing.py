"""Mix sources to target weights by Pareto order sampling.

Every source gets a target in words: a share of all words by its weight, at most `most_copies` times its own
words, the excess shared anew by weight until no source is above its cap. A source with target T and W words is
taken floor(T/W) times whole (the certain copies); what T needs beyond them is a sample of its documents without
replacement. Document i has the inclusion probability min(1, c * w_i), where w_i is its weight and c is such that the
expected words of the sample are what is needed. It draws a uniform u from a hash of its id, and documents are ranked by
u/(1-u) divided by p/(1-p). The sample is the start of that order that fits in what is needed, and one document more: of
the rest the one that comes nearest to the gap, where it makes the gap smaller. Its size is fixed by the words, not by chance.

Weights: a column, or by default 1 / (binary digits of the size), so that a sample is of more and shorter documents than an
even draw; rounded to sixteenths of an octave, so that c is found from the few weights there are in a source.

The order is never made by one task: words are counted by 65,536 ranges of the ranking key, and only the documents of the range
in which what is needed is reached are ordered exactly. What is decided comes to a row for each source, which all documents meet in one join.

Defined results: null text has size 0, and documents of size 0 take 0; null source is a source of its own, last; a weight that
is null or not above 0 counts as 2^-60; an empty table gives an empty result; rows that repeat an id draw the same u and are
ranked side by side, by size and text; rows without an id draw theirs from their text; extra columns are ignored. The same
input and seed give the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm._common import materialize, word_count

RANGES = 65_536
#: Sources up to this many are broadcast (some tens of bytes each).
BROADCAST_SOURCES = 20_000


def uniform(id_column: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of an MD5, so that any engine can draw the same."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), id_column.cast("string"))), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.0, most_copies: int = 3) -> DataFrame:
    """sizes(source, size) -> source, source_size, target; one row per source (windows run over that small table)."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    up_to = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(most_copies))
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("ratio", cap / F.col("w"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(up_to), F.lit(0.0))
    t = t.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0))))
    # the first source in the order of its ratio that stays below its cap; later levels are lower
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every), F.lit(float("inf")))
    return t.withColumn("target", F.least(cap, F.col("w") * level)).select("source", "source_size", "target")


def by_digits(size: Column) -> Column:
    """The default weight of a document of so many words."""
    return F.lit(1.0) / F.length(F.bin(size))


def stepped(weight: Column) -> Column:
    """A weight to the nearest sixteenth of an octave."""
    return F.pow(F.lit(2.0), F.coalesce(F.when(weight > 0, F.round(F.log2(weight) * 16) / 16), F.lit(-60.0)))


def inclusion_factor(kinds: DataFrame) -> DataFrame:
    """kinds(s, need, own, words: of all documents of that weight) -> s, c with sum(min(1, c * own) * words) = need.

    From the greatest weight down, those for which c * own would pass 1 are certain; c is the first that passes nobody.
    """
    down = Window.partitionBy("s").orderBy(F.col("own").desc())
    certain = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = kinds.withColumn("c", (F.col("need") - certain) / F.sum(F.col("own") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("c") * F.col("own") <= 1
    return k.groupBy("s").agg(F.coalesce(F.max_by(F.when(fits, F.col("c")), F.when(fits, F.col("own"))), F.lit(float("inf"))).alias("c"))


def ranking_key() -> Column:
    """Random odds over inclusion odds, brought to (0, 1); of u, own and c."""
    p = F.least(F.greatest(F.coalesce(F.col("c"), F.lit(0.0)) * F.col("own"), F.lit(1e-12)), F.lit(1 - 1e-12))
    order = (F.col("u") / (F.lit(1.0) - F.col("u"))) / (p / (F.lit(1.0) - p))
    return order / (F.lit(1.0) + order)


def draw(rows: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows(s, need, doc_id, size, hash, number, key), all drawable -> s, range, edge (the last that fits within the range), filler (number).

    A source that is needed whole has no row: none of its ranges reaches what is needed.
    """
    rows = materialize(rows.withColumn("range", F.least(F.floor(F.col("key") * RANGES), F.lit(RANGES - 1))), "mix-keys")
    w = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.groupBy("s", "range").agg(F.sum("size").alias("words"), F.first("need").alias("need")).withColumn("upto", F.sum("words").over(w))
    hit = F.when(F.col("upto") >= F.col("need"), F.struct("range", (F.col("upto") - F.col("words")).alias("before")))
    cross = run.groupBy("s").agg(F.min(hit).alias("hit")).where("hit is not null").select(F.col("s").alias("s1"), F.col("hit.range").alias("cross"), F.col("hit.before").alias("before"))
    last = rows.join(few(cross), F.col("s").eqNullSafe(F.col("s1")) & (F.col("range") == F.col("cross")))
    order = ["key", "doc_id", "size", "hash", "number"]
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("upto") <= F.col("need")
    gap = F.first("need") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before"))
    bounds = materialize(last.groupBy(F.col("s").alias("s2"), F.col("cross")).agg(F.max(F.when(fits, F.struct(*order))).alias("edge"), gap.alias("gap")), "mix-bounds")
    left = rows.join(few(bounds), F.col("s").eqNullSafe(F.col("s2"))).where(~taken(F.col("cross"), F.col("edge")))
    off = F.abs(F.col("size") - F.col("gap"))
    filler = left.where(off < F.col("gap")).groupBy("s").agg(F.min(F.struct(off.alias("off"), *order)).alias("f")).select(F.col("s").alias("s3"), F.col("f.number").alias("filler"))
    return bounds.join(filler, F.col("s2").eqNullSafe(F.col("s3")), "left").select(F.col("s2").alias("s"), "cross", "edge", "filler")


def taken(cross: Column, edge: Column) -> Column:
    """Whether a row lies before the edge of its source's sample."""
    own = F.struct("key", "doc_id", "size", "hash", "number")
    return (F.col("range") < cross) | ((F.col("range") == cross) & F.coalesce(own <= edge, F.lit(False)))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.0, most_copies: int = 3, seed: str = "mix", weight_col: str | None = None, weight_of: Callable[[Column], Column] = by_digits, whole_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    whole_rows: and row, a struct of all columns of docs, so that nobody need join back on an id.
    """
    text, whole = F.col(f"`{text_col}`"), [F.col(f"`{c}`") for c in docs.columns]
    drawn = F.coalesce(F.col(f"`{id_col}`").cast("string"), text)
    own = [F.col(f"`{weight_col}`").cast("double").alias("own")] if weight_col else []
    sizes = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), uniform(drawn, seed).alias("u"), F.xxhash64(text).alias("hash"), *own, *([F.struct(*whole).alias("row")] if whole_rows else []))
    sizes = sizes.withColumn("own", stepped(F.col("own") if weight_col else weight_of(F.col("size"))))
    # written, so that each row keeps its number
    sizes = materialize(sizes.withColumn("number", F.monotonically_increasing_id()), "mix-sizes")
    kinds = materialize(sizes.groupBy("source", "own").agg(F.sum("size").alias("size")), "mix-kinds")
    targets = source_targets(kinds, weights, share, most_copies).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s")
    needed = kinds.where("size > 0").join(targets.select("s", "need"), F.col("source").eqNullSafe(F.col("s"))).select("s", "need", "own", F.col("size").alias("words"))
    factors = inclusion_factor(needed).withColumnRenamed("s", "of")
    sources = materialize(targets.join(factors, F.col("s").eqNullSafe(F.col("of")), "left").drop("of"), "mix-sources", F.count(F.lit(1)).alias("n"))
    # a table of a row a source is broadcast up to a number of sources, and joined by shuffles beyond it
    few = F.broadcast if sources.figures["n"] <= BROADCAST_SOURCES else (lambda table: table)
    narrow = sizes.select("doc_id", "source", "size", "hash", "number", "u", "own").where("size > 0")
    drawable = narrow.join(few(sources.where("need > 0")), F.col("source").eqNullSafe(F.col("s"))).select("s", "need", "doc_id", "size", "hash", "number", ranking_key().alias("key"))
    bounds = draw(drawable, few).withColumnRenamed("s", "s4")
    known = materialize(sources.join(bounds, F.col("s").eqNullSafe(F.col("s4")), "left").drop("s4"), "mix-decided")
    rows = sizes.join(few(known), F.col("source").eqNullSafe(F.col("s"))).withColumn("key", ranking_key()).withColumn("range", F.least(F.floor(F.col("key") * RANGES), F.lit(RANGES - 1)))
    drawn = F.col("cross").isNull() | taken(F.col("cross"), F.col("edge")) | F.coalesce(F.col("number") == F.col("filler"), F.lit(False))
    extra = F.when((F.col("need") > 0) & (F.col("size") > 0) & drawn, 1).otherwise(0)
    copies = (F.col("whole") + extra).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if whole_rows else []))
