"""Thresholds of long texts are learned from long beginnings."""

import random
from collections import defaultdict

import numpy as np

from trackloom.llm import language_id


def test_long_texts_have_thresholds_of_their_own(spark):
    rng = random.Random(3)
    words = {lang: ["".join(rng.choices(letters, k=5)) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "qrstuvwx"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.choice((50, 200, 900)))), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows.append((-1, "." * 600 + " ".join(words["aa"]), "aa"))
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    by_bucket = defaultdict(list)
    for _, text, _ in rows:
        for k in (2**i for i in range(20) if 2**i < len(text)):
            counts = language_id.grams(text[:k])
            if counts is not None:
                by_bucket[int(counts.sum()).bit_length() - 1].append(float((model.centroids @ model.vector(counts)).max()))
    long = [b for b, found in by_bucket.items() if len(found) >= language_id.LEAST_KNOWN and b >= 11]
    assert len(long) >= 2
    for b in long:
        assert abs(model.thresholds[b] - language_id.REJECT_SHARE * np.percentile(by_bucket[b], 1)) < 1e-4
        assert model.threshold(1 << b) == model.thresholds[b]
