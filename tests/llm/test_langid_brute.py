import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import langid

TEXTS = ["The cat sat on the mat", "Über schöne Straßen", "el niño come", "x", "12 !", "", None, "the the the the", "Ωmega и мир", "a" * 5000 + " b"]


def brute_features(text):
    """n-gram counts by plain loops, with the hash written out in Python integers."""
    data = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").lower().encode())
    grams = Counter()
    for order in langid.ORDERS:
        for i in range(len(data) - order + 1):
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for b in data[i : i + order]:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            h ^= h >> 15
            grams[(h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - langid.DIMENSIONS.bit_length() + 1] += 1
    return grams


def brute_predict(model, text):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    x = {k: math.sqrt(n) for k, n in brute_features(text).items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    losses = []
    for word in model.code:
        loss = 0.0
        for j, bit in enumerate(word):
            margin = sum(v / size * float(model.weights[k, j]) for k, v in x.items()) + float(model.bias[j])
            loss += float(model.reliability[j]) * math.log1p(math.exp(-margin if bit else margin))
        losses.append(loss)
    best = min(range(len(losses)), key=losses.__getitem__)
    return model.languages[best], 1 / sum(math.exp(-4 * (v - losses[best])) for v in losses)


@pytest.mark.parametrize("languages", ["en de", "en de es", "aa bb cc dd ee ff gg hh"])
def test_features_and_decoding_equal_brute_force(languages):
    names = languages.split()
    rng = np.random.default_rng(4)
    x, _ = langid.features(pa.array([f"{n} " * 9 + " ".join(rng.choice([n + "or", "die", "los"], 20)) for n in names for _ in range(12)]))
    model = langid.Model.fit(x, [n for n in names for _ in range(12)])
    got, letters = langid.features(pa.array(TEXTS))
    for row, text in zip(got, TEXTS):
        grams = brute_features(text)
        assert {int(k) for k in np.flatnonzero(row)} == set(grams)
        total = math.sqrt(sum(grams.values())) or 1
        assert all(abs(row[k] - math.sqrt(n) / total) < 1e-5 for k, n in grams.items())
    langs, scores, _ = model.predict(pa.array(TEXTS))
    want = [brute_predict(model, t) for t in TEXTS]
    assert langs == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want], atol=1e-4)


def test_a_tie_goes_to_the_first_language():
    code = langid.codewords(3)
    model = langid.Model(["a", "b", "c"], code, np.zeros((langid.DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.full(code.shape[1], 1 / code.shape[1], np.float32))
    langs, scores, close = model.predict(pa.array(["word"]))
    assert langs == ["a"] and abs(scores[0] - 1 / 3) < 1e-6 and close[0]


def test_no_language_is_lost(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 4)
    rows = [(1, f"uno dos tres {i}", "es") for i in range(6000)] + [(1, "ein zwei drei", "de")] * 3000 + [(i, f"one two three {i}", "en") for i in range(300)] + [(9, "un deux trois", "fr"), (7, "12", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    assert {r.lang_pred for r in langid.predict(docs.filter("lang = 'es'"), model).collect()} == {"es"}
    with pytest.raises(ValueError):
        langid.fit(docs.unionByName(spark.createDataFrame([(5, "yksi kaksi", "fi")], docs.schema)))


def test_sample_is_bounded(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("en").alias("lang"))
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) + 1) / float(1 << 53)
    counts = {"en": {r.o: r["count"] for r in docs.groupBy(langid._octave(place).alias("o")).count().collect()}}
    got = langid._draw(docs, 100, counts, place)
    want = sorted((r.p, r.text) for r in docs.select(place.alias("p"), "text").collect())[:100]
    assert sorted(r.text for r in got.collect()) == sorted(t for _, t in want)
