import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\x0babé#日", max_size=60)), max_size=8))
def test_counts_equal_brute_force(texts):
    got = quality.count_texts(pa.array(texts, pa.large_string()))
    assert got[:, :5].tolist() == [brute(t) for t in texts]


@pytest.fixture
def docs(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(4000)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words, 80))
        if i % 10 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, 1.5))
    rows += [(300, None, 0.0), (301, "", 0.0), (302, "short text", 0.0), (303, "same words here " * 40, 0.0), (299, rows[299][1], 1.5), (None, rows[1][1], 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words double")


def test_forest_finds_odd_rows_and_keeps_clean_ones(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(0, 300, 2)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    stats = quality.statistics(docs)
    rows = quality.judge(stats, quality.fit(stats, labels)).collect()
    assert len(rows) == docs.count()
    verdict = {r.doc_id: r for r in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert [r[c] for c in quality.COUNTS] == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert all(verdict[i].base_failed and not verdict[i].kept for i in (300, 301, 302, 303))
    assert sum(verdict[i].kept for i in range(0, 300, 10)) <= 3
    assert sum(not verdict[i].kept for i in range(300) if i % 10) <= 3
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in rows if r.kept)


def test_no_labels_and_no_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep(docs, none).count() > 200
    assert quality.keep(docs.limit(0), none).count() == 0


def test_thresholds_weigh_clean_rows():
    hist = [(0, 700, 0, 10), (0, 600, 1, 1), (0, 600, 0, 20), (3, 800, 1, 5), (3, 800, 0, 20)]
    cut = quality.thresholds(hist)
    assert cut[0] == 0.6 and cut[3] == np.inf and cut[1] == np.inf
