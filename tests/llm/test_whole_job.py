"""Operators on what they once left out: foreign texts, popular blocked hosts, unsettled packing rounds, null and repeated ids."""

import collections
import random
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import _common, exact_dedup, language_id, packing, url_filters

FOREIGN = [
    "Wczoraj wieczorem poszliśmy z przyjaciółmi do małej restauracji nad rzeką, gdzie podano nam świeże ryby i ciepły chleb. Po kolacji długo rozmawialiśmy o podróżach, które chcielibyśmy odbyć w przyszłym roku, i o książkach, które ostatnio przeczytaliśmy.",
    "Dün akşam arkadaşlarımızla birlikte nehir kenarındaki küçük bir lokantaya gittik ve orada bize taze balık ile sıcak ekmek verdiler. Yemekten sonra gelecek yıl yapmak istediğimiz yolculuklar ve son zamanlarda okuduğumuz kitaplar hakkında uzun uzun konuştuk.",
    "Eilen illalla menimme ystävien kanssa pieneen ravintolaan joen rannalle, jossa meille tarjottiin tuoretta kalaa ja lämmintä leipää. Illallisen jälkeen juttelimme pitkään matkoista, joita haluaisimme tehdä ensi vuonna, ja kirjoista, joita olemme viime aikoina lukeneet.",
]


def test_language_rejects_by_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs, trainable=~held_out)
    rng = random.Random(1)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(60)), " ".join(f"{rng.getrandbits(32):08x}" for _ in range(60))]
    for text in [t for f in FOREIGN for t in (f, f * 8, f[:160], f[:80])] + junk:
        assert model.predict(text)[2], (text[:40], model.predict(text))
    short = [r["text"] for r in docs.where(held_out).collect() if r["text"] and len(r["text"]) < 120]
    assert len(short) >= 5
    for text in short:
        assert not model.predict(text)[2], (text, model.predict(text))


def test_every_labelled_row_is_learned_from(spark):
    """Centroids and thresholds against those of all rows, of which a language has more than any sample took."""
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60)] for lang, letters in (("aa", "abcdefgh"), ("bb", "fghijklm"))}
    rows = [(i, " ".join(rng.choices(words[lang][k : k + 20], k=rng.randint(1, 60))), lang) for i, (lang, k) in enumerate((lang, k) for lang in words for k in (0, 20, 40) for _ in range(250))]
    rows += [(-1, "a" * 70_000, "aa"), (-2, "12", "aa"), (-3, None, "bb"), (-4, "words of none", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    learned = [(lang, text, language_id.grams(text)) for _, text, lang in rows[:-3]]
    frequency = sum(c > 0 for _, _, c in learned)
    assert np.allclose(model.idf, np.log((1 + len(learned)) / (1 + frequency)) + 1, atol=1e-6) and model.languages == ["aa", "bb"]
    for i, lang in enumerate(model.languages):
        want = language_id.cluster(np.stack([np.log1p(c) * model.idf.astype(float) for of, _, c in learned if of == lang] / np.array([[np.linalg.norm(np.log1p(c) * model.idf.astype(float))] for of, _, c in learned if of == lang])), 4)
        assert (model.owner == i).sum() == len(want) == 4 and np.allclose(model.centroids[model.owner == i], want, atol=1e-5)
    near = {}
    for _, text, _ in learned:
        for begin in (text[:k] for k in language_id.BEGINNINGS if len(text) > k):
            counts = language_id.grams(begin)
            if counts is not None:
                near.setdefault(int(counts.sum()).bit_length() - 1, []).append(float((model.centroids @ model.vector(counts)).max()))
    for bucket, found in near.items():
        if len(found) >= language_id.LEAST_KNOWN:
            assert abs(model.thresholds[bucket] - language_id.REJECT_SHARE * np.percentile(found, 1)) < 1e-4
    assert len(near) > 5


def test_grams_of_many_texts():
    texts = ["  Ab c1é", "", "12", "a", " ", "\U0001d400x 𐐷 ", "a  ", "ß İ.", "1a2"]
    row, gram, n = language_id.grams_of(texts)
    for i, text in enumerate(texts):
        want = language_id.grams(text)
        assert (np.bincount(gram[row == i], n[row == i], language_id.DIMENSIONS) == (0 if want is None else want)).all(), text
    assert all(not len(x) for x in language_id.grams_of([])) and all(not len(x) for x in language_id.grams_of(["1", ""]))


def test_language_is_found_once_a_row(spark):
    """A filter by what is found has it found once, not a second time."""
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "der Hund", "de")], "doc_id long, text string, lang string")
    found = language_id.predict(docs, language_id.fit(docs)).where("not rejected").select("doc_id", "lang_pred")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan


def test_packed_counts_are_exact():
    texts = [language_id.grams(t) for t in ("a" * 70_000, "ab", "a b " * 200)]
    row, gram, n = language_id.unpack(*zip(*map(language_id.pack, texts)))
    back = np.zeros((3, language_id.DIMENSIONS), np.int64)
    back[row, gram] = n
    assert (back == np.stack(texts)).all() and back.max() > 65_535


def test_distrust_does_not_fade_with_many_linkers(spark):
    bad, many = '<a href="http://bad.net/es/">', "".join(f'<a href="http://fine{i}.org/">' for i in range(40))
    rows = [(0, "http://bad.net/es/", ""), (1, "http://good.com/a", "")]
    rows += [(10 + i, f"http://farm{i}.org/x", bad) for i in range(30)]
    rows += [(50, "http://second.org/x", '<a href="http://farm0.org/x">'), (51, "http://wide.org/x", many + bad)]
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [("com", "/", "allow"), ("net", "/es/", "block")]).collect()}
    assert all(got[10 + i] == "block" for i in range(30)) and got[0] == got[50] == "block"
    assert got[1] == got[51] == "allow"


def test_packing_goes_on_where_little_settles(spark):
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.randint(1, 100), 0, i) for i in range(500)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    got = packing.pack(pieces, capacity=100, block=60).collect()
    assert sorted(r["row"] for r in got) == list(range(500))
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in seqs.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 100
    assert len(seqs) <= 279  # stopped early: 283; one pass over all: 284; no packing has less than 273


def test_null_and_repeated_ids_stay_whole(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(None, words(0), "en", "a", 1), (None, words(0), "en", "a", 1), (None, words(1), "en", "a", 1), (7, words(2), "en", "a", 1), (7, words(3), "en", "a", 1), (8, words(4), "en", "a", 1), (None, words(4), "en", "a", 1), (9, None, None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for keep in ("smallest", "largest"):
        kept = exact_dedup.drop_exact_copies(docs, keep=keep)
        assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(None, words(0)), (None, words(1)), (7, words(2)), (7, words(3)), (8, words(4)), (9, None)])
    left = corpus_pipeline.drop_near_copies(spark, kept, "")
    assert left.count() == 6
    mixed = corpus_pipeline.mix_sources(spark, left, "")
    assert mixed.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == collections.Counter((r["doc_id"], r["text"]) for r in left.collect())


def test_shuffles_of_written_tables_go(spark):
    """After a table is written, of its shuffles nothing is left to await the driver's garbage collection; what is built on it can be run again."""
    store = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    left = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.getAllFiles()))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = left(), spark.conf.get(key, None)
    rows = spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    written = _common.materialize(rows, "test-shuffles", F.sum("count").alias("n"))
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before
    assert written.figures == {"n": 10_000} and spark.conf.get(key, None) == kept
    again = written.groupBy("k").sum("count")
    assert len(again.collect()) == len(again.collect()) == 10
