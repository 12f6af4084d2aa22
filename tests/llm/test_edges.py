"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat, exact_dedup, fingerprints, language_id, mixing, ngram_join, packing, quality, url_filters, warc
from trackloom.llm.queries import URL_RULES, public_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000 + "end"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Every kind of odd row."""
    return docs_of(
        spark,
        [
            (1, None, None, None, None),
            (2, "", "en", "a", 0),
            (3, "  \n\t ", "en", None, 5),
            (4, LONG, "en", "a", len(LONG)),
            (5, "One two three four five six seven.", "en", "b", 34),
            (5, "One two three four five six seven.", "en", "b", 34),
            (6, "one TWO three four five six seven.", None, "b", 34),
            (7, "short", "de", "c", 5),
            (8, "😀 né <|endoftext|> \x85x", "fr", "c", 20),
            (9, "One two three four five six seven.", "en", "a", 34),
        ],
    )


@pytest.fixture(scope="module")
def clashing(odd):
    """Columns named as the operators' own."""
    names = ["h", "n", "t", "sha", "key", "size", "copies", "taken", "kept", "keep_id", "score", "rejected", "lang_pred", "block", "row", "piece", "cls", "range", "guest", "fingerprint", "verdict", "target", "u", "s", "__t", "__h", "a b"]
    return odd.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def model_of(spark):
    return language_id.fit(docs_of(spark, [(i, t, lg, "s", 1) for i, (t, lg) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 4)]))


def test_exact_dedup(spark, odd, clashing, empty):
    want = {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1), (5, 9, 3), (6, 6, 1), (7, 7, 1), (8, 8, 1), (9, 9, 3)}
    for d in (odd, clashing):
        got = exact_dedup.exact_groups(d, keep="largest").collect()
        assert len(got) == 10 and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == want
        assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted({k for _, k, _ in want}) and all(r["kept"] in (True, False) for r in got)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, "d"), (7, "d"), (7, None), (8, ""), (8, "")]
    for keep in ("smallest", "largest"):
        got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep).collect()
        assert len(got) == len(rows)
        kept = sorted(((r["doc_id"] is None, r["doc_id"], r["text_sha256"]) for r in got if r["kept"]), key=str)
        ids = [(1, "a"), (1, "b"), (None, "c"), (7, "d"), (7 if keep == "smallest" else 8, "")]
        assert kept == sorted(((i is None, i, hashlib.sha256(t.encode()).hexdigest()) for i, t in ids), key=str)


def test_exact_dedup_keeps_colliding_texts_apart(spark, odd):
    weak = lambda c: F.substring(F.md5(c), 1, 1)
    strong, got = exact_dedup.exact_groups(odd), exact_dedup.exact_groups(odd, content_hash=weak)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, strong.collect()))


def test_drop_exact_copies(spark, clashing, empty):
    got = exact_dedup.drop_exact_copies(clashing)
    assert got.columns == clashing.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert sorted(rows) == [1, 3, 4, 5, 6, 7, 8] and rows[1]["text"] is None and rows[5]["text"].startswith("One") and rows[7]["h"] == "x0"
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_near_duplicates(spark, odd, clashing, empty):
    for d in (odd, clashing):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(d).collect())
        assert [x for x in got if x[0] not in (4,)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 3, 5), (5, 3, 5), (6, 3, 5), (7, 1, 7), (8, 1, 8), (9, 3, 5)]
        assert (4, 2, 4) in got
    assert ngram_join.near_duplicates(empty).count() == 0


def test_mixing(spark, odd, clashing, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 10 and {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert sorted(tuple(r) for r in got if r["doc_id"] != 5) == sorted(tuple(r) for r in mixing.mix_sources(clashing).collect() if r["doc_id"] != 5)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    assert mixing.mix_sources(empty).count() == 0


def test_language(spark, odd, clashing, empty):
    model = model_of(spark)
    for d in (odd, clashing):
        got = language_id.predict(d, model)
        rows = {r["doc_id"]: r for r in got.collect()}
        assert len(rows) == 9 and all(rows[i]["lang_pred"] == "und" and rows[i]["rejected"] and rows[i]["score"] == 0 for i in (1, 2, 3))
        assert rows[4]["lang_pred"] in ("en", "de") and 0 <= rows[4]["score"] <= 1
        assert set(d.columns) <= set(got.columns)
    assert language_id.predict(empty, model).count() == 0
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}


def test_quality(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 0), (5, 0, 0), (7, 1, None), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    for d in (odd, clashing):
        rows = quality.score(d, model).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    untrained = quality.fit(empty, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, untrained).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_packing(spark, odd, clashing, empty):
    for d in (odd, clashing):
        rows = packing.pack_documents(d, public_tokenizer()).collect()
        assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2, 3)) == 3
        assert sum(1 for r in rows if r["doc_id"] == 5) == 2
        assert sorted(r["piece"] for r in rows if r["doc_id"] == 4) == list(range(10))
        places = {}
        for r in rows:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for p in places.values():
            p.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(p[-1]) <= 4096
    assert packing.pack_documents(empty, public_tokenizer()).count() == 0


def test_fingerprints(spark, odd, clashing, empty):
    for d in (odd, clashing):
        rows = fingerprints.against_next(d).collect()
        assert len(rows) == 10
        by = {r["doc_id"]: r for r in rows}
        assert by[1]["fingerprint"] == by[2]["fingerprint"] == "3::" and by[1]["near_edited"] == 1 and by[2]["near_next"] == 1
        assert by[5]["fingerprint"] == by[9]["fingerprint"] and by[3]["near_next"] == 0
        assert sorted(r["near_next"] for r in rows if r["doc_id"] == 5)[1] == 1
    assert fingerprints.against_next(empty).count() == 0
    assert fingerprints.with_fingerprint(odd).count() == 10


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "no scheme", ""), (3, "http://Www.EXAMPLE.com/en/x?q", "a" * 1000), (4, "http://example.com/en/#f", "a" * 1000), (4, "http://example.com/en/#f", "a" * 1000), (5, "x://a.net/es/1", "b" * 999), (6, "x://a.net", "b" * 999), (7, "http://com/", "é" * 3_000_000)],
        "page_id long, url string, html string",
    ).withColumn("host", F.lit("clash")).withColumn("payload", F.lit(1)).withColumn("trust", F.lit(2))
    rows = {r["page_id"]: r for r in url_filters.filter_urls(pages, URL_RULES).collect()}
    assert [(rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) for i in range(1, 8)] == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("example.com", "/en/", "example.com/en/", "block"),
        ("a.net", "/es/1", "net/es/", "block"),
        ("a.net", "", None, "block"),
        ("com", "/", "com/", "allow"),
    ]
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, chunk=1 << 16).collect())
    assert got[:3] == [(1, 0, "response", None), (2, 0, "response", None), (3, 1000, "revisit", 4)]
    assert got[3:] == [(4, 1000, "response", None)] * 2 + [(5, 999, "response", None), (6, 999, "response", None), (7, 6_000_000, "response", None)]
    assert url_filters.filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "?"), (1, 1, "ann", "hi"), (2, 0, "system", "alone"), (None, 0, "eve", "x"), (3, None, "zoe", "y" * 200_000)],
        "conv_id long, turn long, role string, text string",
    ).withColumn("c", F.lit(1)).withColumn("said", F.lit(2))
    rows = chat.perspectives(turns).collect()
    assert len(rows) == 2 * 5 + 1 + 1
    ann = sorted((r["turn"], r["segment"], r["train"]) for r in rows if r["perspective"] == "ann")
    assert ann[0] == (0, "<|im_start|>system\nbe kind<|im_end|>\n", False) and ann[1] == ann[2] == (1, "<|im_start|>assistant\nhi<|im_end|>\n", True)
    assert ann[3][1] == "<|im_start|>user name=bob\n<|im_end|>\n" and ann[4][1].startswith("<|im_start|>user name=unknown")
    for r in rows:
        if r["train"]:
            assert r["segment"][r["mask_start"] :][: r["mask_length"]] + "<|im_end|>\n" == r["segment"][r["mask_start"] :]
    for r in chat.dialogues(chat.perspectives(turns)).collect():
        assert all(r["rendered"][m["start"] :][: m["length"]] in ("hi", "", "x", "y" * 200_000) for m in r["masks"])
    assert chat.perspectives(turns.limit(0)).count() == 0
