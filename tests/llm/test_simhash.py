import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash


def brute_fp(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    sh = [" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    n = len(rows)
    adj = [[j for j in range(n) if j != i and (rows[i][1] ^ rows[j][1]).bit_count() <= 6] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in adj[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted((str(rows[i][0]), f"{rows[i][1]:016x}", len(adj[i]), root[i]) for i in range(n))


def test_fingerprints_and_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"W{i}é" for i in range(500)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    for t in list(texts):
        parts = t.split()
        for _ in range(3):
            parts[int(rng.integers(len(parts)))] = "changed"
            texts.append(" ".join(parts))
    texts += [None, "", " \n", "Word", "word", "two words", texts[0], texts[0], "long " * 50_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, "repeated id", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = brute([(i, brute_fp(t)) for i, t, _ in rows])
    got = sorted((str(r.doc_id), r.fingerprint, r.n_near, r.component_id) for r in simhash.cluster(docs).collect())
    assert got == want
    first = simhash.first_of_groups(docs)
    assert first.columns == docs.columns
    assert sorted(str(r.doc_id) for r in first.collect()) == sorted({str(r[3]) for r in want})


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)
    near = [base]
    for k in range(1, 8):
        x = base[: n // 2].copy()
        for i in range(len(x)):
            for b in rng.choice(64, k, replace=False):
                x[i] ^= np.uint64(1) << np.uint64(b)
        near.append(x)
    near.append(np.arange(256, dtype=np.uint64) << np.uint64(20))  # a crowd on few bits
    return np.unique(np.concatenate(near))


def test_links_lose_nothing(spark):
    for n, bucket in ((150, 1_000_000), (150, 2000), (150, 40)):
        fps = planted(n, n)
        want = {(a, b) for i, a in enumerate(fps.tolist()) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 6].tolist()}
        table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(table, len(fps), bucket=bucket).collect()}
        assert got == want


def test_every_plan_is_exact():
    fps = planted(60, 9)
    pairs = {(a, b) for i, a in enumerate(fps.tolist()) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 6].tolist()}
    plans = [simhash.make_plan(fps, n) for n in (10**2, 10**5, 10**7, 10**9)]
    assert len({tuple(p.thresholds) for p in plans}) > 1
    for plan in plans:
        assert sum(t + 1 for t in plan.thresholds) == 7 and sum(plan.masks) == (1 << 64) - 1
        sides = []
        for side in (0, 1):
            keys = np.concatenate([plan.keys(fps, side, k) for k in range(len(plan.entries[side]))])
            sides.append((keys, np.tile(fps, len(plan.entries[side]))))
        order = np.argsort(sides[0][0])
        got = simhash.match((sides[0][0][order], sides[0][1][order]), sides[1], 6)
        assert {tuple(p) for p in got.tolist()} == pairs


def test_hot_key_way_is_exact():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 3000).astype(np.uint64))
    want = {(a, b) for i, a in enumerate(fps.tolist()) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 6].tolist()}
    keys = np.zeros(len(fps), np.uint64)
    assert {tuple(p) for p in simhash.match((keys, fps), (keys, fps), 6).tolist()} == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.cluster(none).count() == 0 and simhash.first_of_groups(none).count() == 0
    zero = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert [(r.n_near, r.component_id) for r in simhash.cluster(zero).collect()] == [(2, 0)] * 3
