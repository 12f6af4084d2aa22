"""Sharding along a Hilbert curve."""

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackloom.llm import hilbert

from oracle import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_against_sql(spark):
    assert compare(spark, entry, "op12_hilbert_shards", SF) > 0


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_and_neighbours_in_turn(spark, n, bits):
    side = 1 << bits
    cells = spark.range(side**n).select(*[((F.col("id") / side**j).cast("long") % side).cast("int").alias(f"c{j}") for j in range(n)])
    rows = cells.select("*", hilbert.curve_index([F.col(f"c{j}") for j in range(n)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(side**n))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(x - y) for x, y in zip(a[:-1], b[:-1])) == 1


def test_running_totals_over_one_hot_value(spark):
    rows = hilbert.materialize(spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"), "id"), "t")
    got = hilbert.running_totals(rows, [F.col("k")], {"at": F.lit(1), "sum": F.col("id")}, "t").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(5000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert all(b["sum"] == a["sum"] + a["id"] for a, b in zip(got, got[1:]))


def docs_of(spark, n, hot=False):
    texts = ["" if i % 17 == 0 else "x" * (i * 37 % 900) for i in range(n)]
    return spark.createDataFrame([(i, texts[0 if hot and i % 3 == 0 else i], ["de", "en", "fr"][i % 3], f"s{0 if hot and i % 3 == 0 else i % 8}", 0) for i in range(n)], DOCS)


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("hot", [False, True])
def test_laws(spark, law, hot):
    got = hilbert.shards_by_curve(docs_of(spark, 1000, hot), law=law).collect()
    assert len(got) == 1000 and sorted(r["doc_id"] for r in got) == list(range(1000))
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) == set(range(24))
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    counts, sizes = [len(v) for v in shards.values()], [sum(r["size"] for r in v) for v in shards.values()]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    else:
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    # runs of the curve
    ranges = sorted((min(r["curve"] for r in v), max(r["curve"] for r in v)) for v in shards.values())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_shards_prune_by_every_dimension(spark):
    docs = docs_of(spark, 3000)
    got = hilbert.shards_by_curve(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    for dimension in ("lang", "source"):
        met = {(r["shard"], r[dimension]) for r in got}
        values = {r[dimension] for r in got}
        assert len(met) < 0.6 * 24 * len(values)
    spans = {}
    for r in got:
        spans.setdefault(r["shard"], []).append(r["size"])
    whole = max(r["size"] for r in got) - min(r["size"] for r in got)
    assert sum(max(v) - min(v) for v in spans.values()) < 0.75 * 24 * whole


def test_odd_rows(spark):
    long = "é" * 150_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (4, "x", "de", "b", 1), (4, "x", "de", "b", 1), (None, "x", None, "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for d in (df, df.select("*", *[F.lit("q").alias(c) for c in ("d0", "c0", "v0", "hash", "curve", "shard", "size", "rank")])):
        got = hilbert.shards_by_curve(d).collect()
        assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        assert len({r["shard"] for r in got}) == 6 and {r["slot"] for r in got} == {0} and {r["grown_shard"] for r in got} == {None}
    for law in ("rows", "bytes"):
        assert hilbert.shards_by_curve(df.limit(0), law=law).count() == 0
    with pytest.raises(ValueError):
        hilbert.shards_by_curve(df, law="key")
