"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word: a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own; on a cluster there is no other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="trackloom-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return "file://" + _OWN_DIR[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/trackloom-{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made and run in here go as each ends, and not when the driver happens to collect its garbage.

    Only for what is run once: whoever runs the same DataFrame again has its shuffles written again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, *figures: Column) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives a lost executor. What it shuffles goes once it is written.

    figures: named aggregates over what was written; the result has them as the attribute `figures`.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with shuffles_go(spark):
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out.path, out.figures = path, out.agg(*figures).first().asDict() if figures else {}
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that materialize() has written and that nothing will read again."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast only after counting df (a written table) and finding it within the bound."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: Column) -> Column:
    """Number of words; null counts 0. A word begins where a non-blank follows a blank or the start."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches that go to Python hold about 4 MB, for texts may be long: Spark's own bound is by rows and 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def short_reads(spark: SparkSession, rows: int = 256) -> None:
    """Let the Parquet reader hold the texts of so many rows at once: Spark's own bound is 4,096, in arrays of bytes that double as they grow."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key, "4096")) > rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
