"""Hand-built graphs; the driver's queries are compared with SQL elsewhere."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.operators import arch, diff, fixpoint, lookups, paths, stats
from graphloom.schema import CONCEPT_SCHEMA, RELATION_SCHEMA, conform


def graph(spark, calls, concepts=None, members=(), extra=()):
    ids = sorted({x for e in calls for x in e}) if concepts is None else concepts
    rows = [x if isinstance(x, tuple) else (x, "Function", x, f"{x}.src", True) for x in ids]
    c = conform(spark.createDataFrame(rows, "id string, kind string, name string, file string, is_public boolean"), CONCEPT_SCHEMA)
    rel = [(a, "Calls", b) for a, b in calls] + [(b, "CalledBy", a) for a, b in calls] + [(a, "MemberOf", b) for a, b in members] + list(extra)
    rel = [(a, i + 1, k, b, "tree-sitter", "exact") for i, (a, k, b) in enumerate(rel)]
    r = conform(spark.createDataFrame(rel, "src string, pos int, kind string, target string, resolved_by string, confidence string"), RELATION_SCHEMA)
    return c, r


def sets(df, key, value="id"):
    out = {}
    for row in df.collect():
        out.setdefault(row[key], set()).add(row[value])
    return sorted(map(sorted, out.values()))


def test_components_and_isolated(spark):
    c, r = graph(spark, [("a", "b"), ("c", "d"), ("e", "e")], ["a", "b", "c", "d", "e", "lone"], extra=[("dangling", "Calls", "nowhere")])
    assert sets(stats.components(c, r), "component") == [["a", "b"], ["c", "d"], ["e"]]
    assert [x.id for x in lookups.isolated_concepts(c, r).collect()] == ["lone"]


def test_cycles(spark):
    c, r = graph(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("a", "d")])
    assert sets(stats.cycles(c, r), "cycle") == [["a", "b"], ["c"]]


def test_transitive_callers(spark):
    c, r = graph(spark, [("c", "b"), ("b", "a"), ("a", "c")])
    start = spark.createDataFrame([("a",), ("unknown",)], "start string")
    assert sorted(x.id for x in paths.transitive_callers(c, r, start).collect()) == ["b", "c"]
    assert [x.id for x in paths.transitive_callers(c, r, start, 1).collect()] == ["b"]


def test_asymmetric_calls_are_not_derived(spark):
    c, r = graph(spark, [], ["a", "b"], extra=[("a", "Calls", "b"), ("a", "Calls", "b"), ("a", "Calls", "gone")])
    assert lookups.callers(c, r).count() == 0 and lookups.callees(c, r).count() == 2


def brute_path(edges, a, b):
    seen, queue = {a: [a]}, [a]
    for x in queue:
        for y in edges.get(x, []):
            if y not in seen:
                seen[y] = seen[x] + [y]
                queue.append(y)
    return seen.get(b)


def test_shortest_path_takes_the_first_found(spark):
    rnd = random.Random(2)
    names = [f"n{i}" for i in range(12)]
    calls = [(rnd.choice(names), rnd.choice(names)) for _ in range(30)]
    c, r = graph(spark, calls, names)
    edges = {}
    for a, b in calls:
        edges.setdefault(a, []).append(b)
    got = {x.id: x.path for x in paths.shortest_call_paths(c, r, "n0").collect()}
    assert got == {n: p for n in names if (p := brute_path(edges, "n0", n))}
    assert paths.shortest_call_paths(c, r, "n0", "n0").first().path == ["n0"]


@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_of_fixpoints_agree(spark, seed):
    rnd = random.Random(seed)
    edges = spark.createDataFrame([(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(45)], "src long, dst long")
    for f in (fixpoint.connected_components, fixpoint.strong_components):
        small, large = ({(x.node, x.component) for x in f(edges, n).collect()} for n in (1000, 0))
        assert small == large
    seeds = spark.createDataFrame([(s, n) for s, n in ((0, 0), (1, 1), (2, 2), (9, 3), (9, 4), (8, 999))], "start long, node long")
    for depth in (None, 2):
        small, large = ({tuple(x) for x in fixpoint.reachable(edges, seeds, depth, n).collect()} for n in (1000, 0))
        assert small == large and (8, 999, 0) in small
    dag = edges.filter("src > dst")
    nodes = spark.range(50).withColumnRenamed("id", "node")
    small, large = ({tuple(x) for x in fixpoint.longest_layers(dag, nodes, n).collect()} for n in (1000, 0))
    assert small == large and len(small) == 50
    none = edges.limit(0)
    assert fixpoint.reachable(none, seeds).count() == 6 and fixpoint.longest_layers(none, nodes).count() == 50
    assert fixpoint.connected_components(none).count() == 0 and fixpoint.strong_components(none).count() == 0


def packaged(spark, deps):
    names = sorted({x for d in deps for x in d})
    concepts = [(f"packages/{n}", "Package", n, f"{n}/manifest", True) for n in names] + [(f"modules/{n}", "Module", n, f"{n}.src", True) for n in names]
    concepts += [(f"functions/{n}", "Function", n, f"{n}.src", True) for n in names]
    return graph(spark, [(f"functions/{a}", f"functions/{b}") for a, b in deps if a != b], concepts, [(f"modules/{n}", f"packages/{n}") for n in names])


def test_layers_share_a_cycle(spark):
    c, r = packaged(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("d", "d")])
    assert {x.id[9:]: x.layer for x in arch.layers(c, r).collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}
    assert sets(arch.domains(c, r), "domain") == [["packages/a", "packages/b", "packages/c"], ["packages/d"]]


def test_communities_split_two_triangles():
    w = {("a1", "a2"): 10.0, ("a2", "a3"): 10.0, ("a1", "a3"): 10.0, ("b1", "b2"): 10.0, ("b2", "b3"): 10.0, ("b1", "b3"): 10.0, ("a1", "b1"): 1.0}
    ids = ["a1", "a2", "a3", "b1", "b2", "b3", "lone"]
    assert arch.greedy_modularity(ids, w) == [["a1", "a2", "a3"], ["b1", "b2", "b3"], ["lone"]]
    assert arch.greedy_modularity(ids[:2], {}) == [["a1"], ["a2"]]


@pytest.mark.parametrize(
    "before, after, want",
    [
        ([("bar", "ts", "exact", None)], [("bar", "ts", "exact", None)], []),
        ([("bar", "ts", "exact", None)], [("bar", "ts", "exact", None), ("baz", "ts", "exact", None)], ["Source"]),
        ([("bar", "ts", "exact", None), ("baz", "ts", "exact", None)], [("bar", "ts", "exact", None)], ["Source"]),
        ([("bar", "ra", "semantic", "1.88.0")], [("bar", "ra", "semantic", "1.89.0")], ["Resolver"]),
        ([("bar", "ra", "semantic", "1.88.0")], [("baz", "ra", "semantic", "1.89.0")], ["Source", "Source"]),
        ([("bar", "ra", "semantic", "1")], [("bar", "ra", "exact", "1")], ["Confidence"]),
        ([("bar", "ra", "semantic", "1")], [("bar", "ts", "exact", None)], ["Provenance"]),
    ],
)
def test_provenance_classes(spark, before, after, want):
    c, _ = graph(spark, [], ["foo"])
    side = lambda rows: (c, spark.createDataFrame([("foo", i, "Calls", *x) for i, x in enumerate(rows)], "src string, pos int, kind string, target string, resolved_by string, confidence string, resolver_version string"))
    assert sorted(x.change for x in diff.relationship_changes(side(before), side(after)).collect()) == want
    summary = diff.ci_summary(side(before), side(after)).first()
    assert summary.source == want.count("Source") and summary.resolver + summary.confidence == len(want) - want.count("Source")


def test_review_and_freshness(spark):
    c, r = graph(spark, [("b", "a"), ("c", "b")])
    later, r2 = graph(spark, [("b", "a"), ("c", "b"), ("c", "d")])
    found = diff.impact((c, r), (later, r2))
    rows = {x.id: (x.change, x.n_blast) for x in found.collect()}
    assert rows == {"d": ("added", 1), "c": ("changed", 0)}
    assert diff.review(found, 1) and not diff.review(found, 2)
    assert "| d | added | 1 | yes | no |" in diff.render_review(found)
    assert diff.blast_total(c, r, spark.createDataFrame([("a",), ("b",)], "start string")).first().n == 2
    one = spark.createDataFrame([("index.md", "x\nsource_revision: a\ny"), ("f.md", "1")], "path string, content string")
    two = spark.createDataFrame([("index.md", "x\nsource_revision: b\ny"), ("f.md", "2")], "path string, content string")
    assert [(x.path, x.outcome) for x in diff.check_fresh(one, two).collect()] == [("f.md", "differs")]
    assert diff.render_ci_report(0, 2, 0, 0.5, {"resolver": "fail"}) == ("source changes: 0\nresolver changes: 2 (fail)\nresolver-only rate: 50.0%", True)


def test_dispatch_checks_arguments_first(spark):
    c, r = graph(spark, [("a", "b")])
    assert [x.id for x in api.dispatch(c, r, "callees", id="a").collect()] == ["b"]
    assert "Calls" in [x.kind for x in api.dispatch(c, r, "explain", id="a", to="b").collect()]
    assert api.lines(api.dispatch(c, r, "cycles"), "no cycles") == "no cycles"
    for bad in ({"relation": "nothing"}, {"relation": "callees"}, {"relation": "api", "id": "a"}):
        with pytest.raises(ValueError):
            api.dispatch(c, r, **bad)
    with pytest.raises(api.UnknownConcept):
        api.dispatch(c, r, "callers", id="zzz")


def test_percent_and_empty_coverage(spark):
    c, _ = graph(spark, [], [("packages/x", "Package", "x", "f", True)])
    row = stats.coverage(c).first()
    assert row.total == 1 and row.with_signature is None and row.described_pct == 0
    assert spark.range(1).select(stats.percent(F.lit(1), F.lit(3)).alias("p"), stats.percent(F.lit(1), F.lit(0)).alias("z")).first() == (33, 0)
