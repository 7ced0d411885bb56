"""Architecture: package dependencies, layers, domains, communities."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import connected_components, longest_layers, strong_components
from graphloom.operators.lookups import module_dependencies, owning_package
from graphloom.session import materialize


def package_edges(c: DataFrame, r: DataFrame) -> DataFrame:
    """(src, dst) packages, one row for each dependent pair of modules; only real packages count."""
    packages = c.filter("kind = 'Package'").select(F.col("id").alias("package"))
    owner = owning_package(c, r).join(packages, "package", "left_semi")
    a = owner.select(F.col("id").alias("src"), F.col("package").alias("a"))
    b = owner.select(F.col("id").alias("dst"), F.col("package").alias("b"))
    edges = module_dependencies(c, r).join(a, "src").join(b, "dst").filter("a <> b")
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def package_dependencies(c: DataFrame, r: DataFrame) -> DataFrame:
    return package_edges(c, r).distinct()


def layers(c: DataFrame, r: DataFrame) -> DataFrame:
    """(id, layer): 0 without dependencies, else above all of them; a cycle shares one layer."""
    packages = c.filter("kind = 'Package'").select(F.col("id").alias("node"))
    edges = materialize(package_dependencies(c, r), "package-edges")
    scc = materialize(strong_components(edges.unionByName(packages.select(F.col("node").alias("src"), F.col("node").alias("dst")))), "package-scc")
    a = scc.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = scc.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    condensed = edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    depth = longest_layers(condensed, scc.select(F.col("component").alias("node")).distinct())
    return scc.join(depth.withColumnRenamed("node", "component"), "component").select(F.col("node").alias("id"), "layer")


def domains(c: DataFrame, r: DataFrame) -> DataFrame:
    """(domain, id): packages connected by dependencies in any direction; lone ones are kept."""
    loops = c.filter("kind = 'Package'").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return connected_components(package_dependencies(c, r).unionByName(loops)).select(F.col("component").alias("domain"), F.col("node").alias("id"))


def weighted_package_edges(c: DataFrame, r: DataFrame) -> DataFrame:
    """(a, b, weight): how many directed module pairs join two packages."""
    return package_edges(c, r).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))


def greedy_modularity(ids: list[str], weights: dict[tuple[str, str], float]) -> list[list[str]]:
    """Merge the pair with the largest modularity gain while there is one.

    Gain: 2 (w / m - d_a d_b / (2 m^2)); equal gains go to the least pair, and b joins a. Pairs
    wait in a heap, and the smaller neighbourhood is moved.
    """
    ids = sorted(ids)
    place = {x: i for i, x in enumerate(ids)}
    between: dict[tuple[int, int], float] = {}
    for (a, b), w in weights.items():
        i, j = sorted((place[a], place[b]))
        between[i, j] = between.get((i, j), 0.0) + w
    m = sum(between.values())
    groups = [[x] for x in ids]
    degree, near = [0.0] * len(ids), [{} for _ in ids]
    for (i, j), w in between.items():
        degree[i] += w
        degree[j] += w
        if i != j:
            near[i][j] = near[j][i] = w
    label = list(range(len(ids)))  # the least place in the group that a slot holds, and back; -1 of slots that are gone
    slot = list(range(len(ids)))

    def entry(s: int, t: int, w: float) -> tuple[float, int, int, float]:
        i, j = sorted((label[s], label[t]))
        return -2.0 * (w / m - degree[s] * degree[t] / (2.0 * m * m)), i, j, w

    # degrees only grow, so an old gain is never too small; pairs with another weight or label are entered anew
    heap = [entry(s, t, w) for (s, t), w in between.items() if s != t] if m > 0 else []
    heapq.heapify(heap)
    while heap:
        found = heapq.heappop(heap)
        _, i, j, w = found
        s, t = slot[i], slot[j]
        if found[0] >= 0 or s < 0 or t < 0 or near[s].get(t) != w:
            continue
        now = entry(s, t, w)
        if now != found:
            heapq.heappush(heap, now)
            continue
        if len(near[s]) < len(near[t]):
            s, t = t, s
        renamed = label[s] != i  # s stays, t goes; i names both
        label[s], slot[i], slot[j] = i, s, -1
        degree[s] += degree[t]
        del near[s][t], near[t][s]
        for x, w in near[t].items():
            del near[x][t]
            near[s][x] = near[x][s] = near[s].get(x, 0.0) + w
        moved = near[s] if renamed else near[t]
        for x in moved:
            heapq.heappush(heap, entry(s, x, near[s][x]))
        near[t] = {}
        if len(groups[s]) < len(groups[t]):
            groups[s], groups[t] = groups[t], groups[s]
        groups[s] += groups[t]
        groups[t] = []
    return sorted(sorted(g) for g in groups if g)


def communities(c: DataFrame, r: DataFrame) -> DataFrame:
    """(community, id): greedy modularity over packages, in one task.

    Each merge depends on the one before; the input is one row a package and dependent pair,
    an aggregate that is small beside the call graph.
    """
    edges = weighted_package_edges(c, r).select(F.lit(0).alias("k"), "a", "b", F.col("weight").cast("double").alias("weight"))
    lone = c.filter("kind = 'Package'").select(F.lit(0).alias("k"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("weight"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [t for pdf in batches for t in pdf.itertuples(index=False)]
        ids = {x for t in rows for x in (t.a, t.b)}
        groups = greedy_modularity(list(ids), {(t.a, t.b): t.weight for t in rows if t.a != t.b})
        yield pd.DataFrame([(g[0], x) for g in groups for x in g], columns=["community", "id"])

    return edges.unionByName(lone).coalesce(1).mapInPandas(solve, "community string, id string")
