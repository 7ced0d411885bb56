"""Graphs above the size of one task: whole components in parts, long paths, slices of starts."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import fixpoint


def many(spark, seed=3):
    """Components of 1 to 9 nodes and one of 40."""
    rnd = random.Random(seed)
    groups = [[f"g{i}_{j}" for j in range(rnd.randint(1, 9))] for i in range(30)] + [[f"h{j}" for j in range(40)]]
    pairs = [(rnd.choice(g), rnd.choice(g)) for g in groups for _ in range(round(1.5 * len(g)))]
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.mark.parametrize("hashed", [True, False])
def test_parts_agree_with_one_task(spark, monkeypatch, hashed):
    if not hashed:  # all hashes are equal
        monkeypatch.setattr(fixpoint, "_hash", lambda c: F.lit(1).cast("long"))
    edges = many(spark)
    for f in (fixpoint.connected_components, fixpoint.strong_components):
        assert {tuple(x) for x in f(edges, 20).collect()} == {tuple(x) for x in f(edges, 1000).collect()}


def test_reach_in_parts_and_slices(spark, monkeypatch):
    edges = many(spark)
    nodes = [x[0] for x in edges.select("src").union(edges.select("dst")).distinct().collect()]
    seeds = spark.createDataFrame([(n, n) for n in nodes] + [("all", n) for n in nodes[::3]] + [("lone", "lone"), ("all", "lone")], "start string, node string")
    monkeypatch.setattr(fixpoint, "SLICE_ROWS", 20)
    monkeypatch.setattr(fixpoint, "SLICED_EDGES", 3)
    for depth, small in ((None, 20), (2, 100)):
        want = [tuple(x) for x in fixpoint.reachable(edges, seeds, depth).collect()]
        assert sorted(map(tuple, fixpoint.reachable(edges, seeds, depth, small).collect())) == sorted(want)
        counts = {x.start: x.n for x in fixpoint.reachable(edges, seeds, depth, small, counted=True).collect()}
        assert counts == {s: sum(x[0] == s for x in want) for s in {x[0] for x in want}}


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """Driver rounds do not grow with the length of a path."""
    written, real = [], fixpoint.materialize
    monkeypatch.setattr(fixpoint, "materialize", lambda df, name: written.append(name) or real(df, name))
    edges = spark.range(1200).filter("id % 300 < 299").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seeds = spark.createDataFrame([(0, 0), (0, 300), (5, 5)], "start long, node long")
    assert fixpoint.strong_components(edges, 400).filter("node = component").count() == 1200
    assert fixpoint.reachable(edges, seeds, small=400).agg(F.count("*"), F.max("depth")).first() == (895, 299)
    assert {x.component for x in fixpoint.connected_components(edges, 400).collect()} == {0, 300, 600, 900}
    assert len(written) < 40
