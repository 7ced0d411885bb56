import numpy as np
import pytest

from graphloom.llm import scoring
from tests.llm.test_scoring import brute


@pytest.mark.parametrize("held", [scoring.HELD, 0])
def test_many_distinct_bigrams_keep_their_own_counts(spark, held, monkeypatch):
    rng = np.random.default_rng(3)
    words = "the of and to in is that it was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who its now find long down day did get come made may part".split()
    texts = [" ".join(rng.choice(words, 60)) for _ in range(1500)] + [None, "", "lone"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "the of and"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = set(range(0, 400))
    model = scoring.fit(docs, spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int"))
    got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in scoring.score(docs, model, held=held).collect())
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute(rows, good)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[k] - w[k]) for g, w in zip(got, want) for k in (2, 3)) < 1e-5


def test_sums_merge_in_parts(monkeypatch):
    monkeypatch.setattr(scoring, "PENDING", 50)
    rng = np.random.default_rng(1)
    sums, want = scoring._Sums(), np.zeros((40, 2), np.int64)
    for _ in range(20):
        keys, counts = rng.integers(0, 40, 30), rng.integers(1, 9, (30, 2))
        np.add.at(want, keys, counts)
        sums.add(keys.astype(np.uint64), counts)
    keys, counts = sums.merge()
    assert (counts == want[keys.astype(np.int64)]).all() and counts.sum() == want.sum()
