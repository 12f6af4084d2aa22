"""Exact deduplication by 128-bit content hash, confirmed by comparing bytes.

Rows are grouped by (hash, text): the hash spreads the groups, the text in the grouping key compares the
bytes, so texts that merely collide stay apart. The grouping combines map-side, so a text that a third of
all rows share leaves each task as one row. Rows find their group again by (hash, SHA-256, length), columns
of fixed width; Spark splits that join where one group is hot.

Defined results: null text counts as empty; empty texts are equal to each other; rows that repeat an id and a
text belong to one group and count separately in group_size, one of them is kept; where a group has no row with an id one without
is kept, and keep_id is null; `kept` is never null; drop_exact_copies() keeps a row without an id only where
no row of its text has one; an empty table gives an empty result; other
columns are ignored by exact_groups() and carried by drop_exact_copies(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import materialize, text_or_empty


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, content_hash: Callable[[Column], Column] = _md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    keep: "smallest" or "largest" id stays. content_hash: of the normalised text, 128 bits by default.
    """
    text = text_or_empty(F.col(f"`{text_col}`"))
    text = normalise(text) if normalise else text
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    pick = {"smallest": F.min, "largest": F.max}[keep]
    groups = (
        base.groupBy(content_hash(F.col("t")).alias("h"), "t")
        .agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
        .select("h", F.unhex(F.sha2("t", 256)).alias("sha"), F.length("t").alias("n"), "group_size", "keep_id")
    )
    rows = base.select("doc_id", content_hash(F.col("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("sha"), F.length("t").alias("n"), F.monotonically_increasing_id().alias("place"))
    rows = materialize(rows, "dedup-rows")  # places are what was written
    # rows that repeat an id and a text: of those only the first may stay
    again = rows.groupBy(*[F.col(c).alias(f"{c}2") for c in ("h", "sha", "n", "doc_id")]).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    again = materialize(again, "dedup-again")
    same = F.col("doc_id").eqNullSafe(F.col("doc_id2"))
    for c in ("h", "sha", "n"):
        same = same & (F.col(c) == F.col(f"{c}2"))
    rows = rows.join(again, same, "left").select("doc_id", "h", "sha", "n", (F.col("first").isNull() | (F.col("place") == F.col("first"))).alias("may"))
    return rows.join(groups, ["h", "sha", "n"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("may")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", content_hash: Callable[[Column], Column] = _md5) -> DataFrame:
    """The rows that stay, with the columns of docs: one shuffle, no join back."""
    key = text_or_empty(F.col(f"`{text_col}`"))
    best = {"smallest": F.min_by, "largest": F.max_by}[keep]
    own = F.col(f"`{id_col}`")
    order = F.struct(own.isNull() if keep == "smallest" else own.isNotNull(), own)  # never null itself: those orderings are ignored
    whole = F.struct(*[F.col(f"`{c}`") if c != text_col else F.col(f"`{c}`").isNull().alias(c) for c in docs.columns])
    kept = docs.groupBy(content_hash(key).alias("__h"), key.alias("__t")).agg(best(whole, order).alias("__r"))
    return kept.select(*[F.when(~F.col(f"__r.`{c}`"), F.col("__t")).alias(c) if c == text_col else F.col(f"__r.`{c}`").alias(c) for c in docs.columns])
