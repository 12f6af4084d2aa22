"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing; each stage written and reread.

Defined results, for every stage: other columns are carried whatever their names; rows without an id and rows that repeat one
are kept apart by their texts; an empty table gives an empty table. What each does with ties is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import exact_dedup, language_id, mixing, ngram_join, packing
from trackloom.llm._common import discard, materialize, table
from trackloom.llm.queries import public_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL can express neither the trained classifier nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def columns_of(row: str, docs: DataFrame) -> list[Column]:
    return [F.col(f"{row}.`{c}`").alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go; the others get the language it finds. A null, empty or letterless text is rejected."""
    model = language_id.fit(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = language_id.predict(rows, model).where("not rejected")
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else column for c, column in zip(docs.columns, columns_of("row", docs))])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; null texts count as empty, null ids come last."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group stays: that with the smallest id, null ids last (ties by a hash of the text).

    Texts without words are linked with nothing and stay. Rows are told apart by id and text, so of rows that share an id only
    the copies go; rows equal in both stay or go together.
    """
    found = ngram_join.near_duplicates(docs, with_rows=True)
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = found.where("root is not null").groupBy("root").agg(F.min(own).alias("first"))
    gone = found.join(first, "root").where(own != F.col("first")).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("__of"), ngram_join.row_hash().alias("__hash"))
    left = rows.join(gone, (F.col("__hash") == F.col("__row")) & F.col("__of").eqNullSafe(F.col("__id")), "left_anti")
    return left.select(*columns_of("row", docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; none where it takes none."""
    mixed = mixing.mix_sources(docs, whole_rows=True).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return mixed.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces; a document that the mix repeats is packed as often."""
    return packing.pack_documents(docs, public_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
