import math
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import scoring
from graphloom.llm.tokens import encoder
from tests.llm.test_scoring import BAD, GOOD


def brute(docs, good):
    """Losses of each document by dictionaries counted over all other documents; scales are those of all."""
    v = encoder().tokenizer.get_vocab_size()
    ids = [encoder().tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in docs]
    mine = [i in good for i, _ in docs]
    masses = [sum(len(x) for x, m in zip(ids, mine) if m), sum(map(len, ids))]
    scales = [1.0, masses[0] / masses[1] if all(masses) else 1.0]
    out = []
    for k, x in enumerate(ids):
        losses = []
        for side, s in enumerate(scales):
            pair, ctx, word = Counter(), Counter(), Counter()
            for j, y in enumerate(ids):
                if j != k and (side or mine[j]):
                    pair.update(zip([-1, *y], y))
                    ctx.update([-1, *y][: len(y)])
                    word.update(y)
            n = sum(word.values()) * s
            loss = 0.0
            for a, b in zip([-1, *x], x):
                uni = (word[b] * s + 0.5) / (n + 0.5 * v)
                loss -= math.log((pair[a, b] * s + 50 * uni) / (ctx[a] * s + 50))
            losses.append(loss / max(1, len(x)))
        out.append((len(x), *losses))
    return out


@pytest.mark.parametrize("held", [scoring.HELD, 0])
def test_each_document_is_scored_by_all_others(spark, held):
    rng = np.random.default_rng(3)
    words = " ".join(GOOD + BAD).split()
    texts = GOOD + BAD + [" ".join(rng.choice(words, 30)) for _ in range(30)] + [None, "", GOOD[0]]
    docs = [*enumerate(texts), (0, "the cat again"), (None, "no id")]
    labels = [(0, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 1), (3, 0, 0), (8, 1, None), (None, 1, 0), (4, None, 0)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, target string, file int")
    rows = scoring.score_corpus(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held=held).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss, r.score) for r in rows)
    want = sorted((str(i), *x) for (i, _), x in zip(docs, brute(docs, {0, 1, 8})))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[k] - w[k]) for g, w in zip(got, want) for k in (2, 3)) < 1e-5
    assert all(abs(g[2] - g[3] - g[4]) < 1e-9 for g in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert scoring.score_corpus(docs, labels).count() == 0
