"""Greedy modularity from a heap gives the merges of the plain search, in little time."""

import random
import time

from graphloom.operators import arch


def plain(ids, weights):
    """Merge the best pair, least first, by looking at all pairs of groups."""
    groups = {x: [x] for x in ids}
    between = {tuple(sorted(p)): w for p, w in weights.items()}
    m = sum(between.values())
    degree = {x: sum(w for p, w in between.items() if x in p) for x in ids}
    while m:
        gains = [(-2.0 * (w / m - degree[a] * degree[b] / (2.0 * m * m)), a, b) for (a, b), w in between.items()]
        if not gains or min(gains)[0] >= 0:
            break
        _, i, j = min(gains)
        groups[i] += groups.pop(j)
        degree[i] += degree.pop(j)
        old, between = between, {}
        for (a, b), w in old.items():
            pair = tuple(sorted(i if x == j else x for x in (a, b)))
            if pair[0] != pair[1]:
                between[pair] = between.get(pair, 0.0) + w
    return sorted(map(sorted, groups.values()))


def drawn(n, seed):
    rnd = random.Random(seed)
    ids = [f"p{i:05}" for i in range(n)]
    return ids, {(ids[int(i * rnd.random())], ids[i]): float(rnd.choice((1, 1, 2))) for i in range(1, n) for _ in range(2)}


def test_heap_takes_the_same_merges():
    for seed in range(60):
        ids, weights = drawn(2 + seed % 23, seed)
        assert arch.greedy_modularity(ids, weights) == plain(ids, weights)


def test_many_packages():
    began = time.time()
    assert sum(map(len, arch.greedy_modularity(*drawn(10_000, 1)))) == 10_000
    assert time.time() - began < 15
