import math
from collections import Counter

import pytest

from graphloom.llm import scoring
from graphloom.llm.tokens import encoder

GOOD = ["the cat sat on the mat", "the cat ate the rat on the mat", "a cat sat"]
BAD = ["buy cheap pills now now now", "cheap cheap pills", "win win money now"]


def brute(docs, good):
    """Losses from plain dictionaries of bigrams."""
    v = encoder().tokenizer.get_vocab_size()
    ids = [encoder().tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in docs]
    models = []
    for rows in ([x for (i, _), x in zip(docs, ids) if i in good], ids):
        pair, ctx, word = Counter(), Counter(), Counter()
        for x in rows:
            for a, b in zip([-1, *x], x):
                pair[a, b] += 1
                ctx[a] += 1
                word[b] += 1
        models.append((pair, ctx, word))
    masses = [sum(m[2].values()) for m in models]
    scales = [1.0, masses[0] / masses[1] if all(masses) else 1.0]
    out = []
    for x in ids:
        losses = []
        for (pair, ctx, word), s in zip(models, scales):
            n = sum(word.values()) * s
            loss = 0.0
            for a, b in zip([-1, *x], x):
                uni = (word[b] * s + 0.5) / (n + 0.5 * v)
                loss -= math.log((pair[a, b] * s + 50 * uni) / (ctx[a] * s + 50))
            losses.append(loss / max(1, len(x)))
        out.append((len(x), *losses))
    return out


@pytest.mark.parametrize("with_labels", [True, False])
def test_scores_equal_brute_force(spark, with_labels):
    texts = GOOD + BAD + [None, "", "the cat sat on the mat", "word " * 20_000]
    docs = list(enumerate(texts)) + [(0, "the cat again"), (None, "no id")]
    labels = [(0, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 1), (3, 0, 0), (8, 1, None), (None, 1, 0), (4, None, 0)] if with_labels else []
    good = {0, 1, 8} if with_labels else set()
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, target string")
    model = scoring.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = scoring.score(table, model).collect()
    got = sorted((str(r.doc_id), r.n_tokens, round(r.target_loss, 4), round(r.background_loss, 4)) for r in rows)
    want = sorted((str(i), n, round(a, 4), round(b, 4)) for (i, _), (n, a, b) in zip(docs, brute(docs, good)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[k] - w[k]) < 2e-3 for g, w in zip(got, want) for k in (2, 3))
    if with_labels:
        by = {r.doc_id: r.score for r in rows}
        assert by[1] < by[3] and by[8] < by[5]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert scoring.score(docs, scoring.fit(docs, labels)).count() == 0
