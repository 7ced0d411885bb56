"""From a source tree to a graph, and one entry point for all queries on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.extract import extract
from graphloom.operators import arch, assemble, lookups, paths, patterns, search, stats
from graphloom.schema import CONCEPT_SCHEMA, KIND_ORDER, RELATION_ORDER, RELATION_SCHEMA, conform, ordinal
from graphloom.session import materialize
from graphloom.sources import project


def analyze(spark: SparkSession, root: str, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Concepts and relationships of a source tree; ``answers`` settle ambiguous calls."""
    files = project.with_text(project.files(spark, root), root)
    found, calls, imports = extract(files)
    packs = project.packages(spark, root)
    made = packs.select("id", F.lit("Package").alias("kind"), F.lit("").alias("language"), "name", F.col("name").alias("qualified_name"), F.col("manifest").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(True).alias("is_public"))
    c = assemble.disambiguate_ids(found, ["file", "start_line", "qualified_name"]).drop("raw_id").unionByName(made, allowMissingColumns=True)
    c = materialize(c.withColumn("kind_ord", ordinal("kind", KIND_ORDER)), "concepts")
    sure, open_ = assemble.split_ambiguous_calls(materialize(calls, "calls"), c)
    edges = sure.select("caller_id", "callee", F.lit("tree-sitter").alias("resolved_by"), F.lit("exact").alias("confidence"))
    if answers is not None:
        more = assemble.resolve_by_answers(open_, answers, c)
        edges = edges.unionByName(more.select("caller_id", "callee", F.lit("resolver").alias("resolved_by"), F.lit("semantic").alias("confidence")))
    r = assemble.call_relations(edges)
    modules = assemble.link_modules(materialize(c.filter("kind = 'Module'").select("id", "file"), "modules"), packs)
    plain = lambda df, kind, src, target: df.select(F.col(src).alias("src"), F.lit(kind).alias("kind"), F.col(target).alias("target"), F.lit("tree-sitter").alias("resolved_by"), F.lit("exact").alias("confidence"))
    r = r.unionByName(plain(imports, "Imports", "src", "target")).unionByName(plain(modules, "MemberOf", "id", "package"))
    order = Window.partitionBy("src").orderBy(ordinal("kind", RELATION_ORDER), "target")
    r = r.withColumn("pos", F.row_number().over(order)).withColumn("rel_ord", ordinal("kind", RELATION_ORDER))
    titles = c.select(F.col("id").alias("target"), F.col("name").alias("_t"))
    r = r.join(titles, "target", "left").withColumn("target_display", F.coalesce("_t", "target"))
    return conform(c.withColumn("tags", F.array().cast("array<string>")), CONCEPT_SCHEMA), conform(r, RELATION_SCHEMA)


class UnknownConcept(KeyError):
    """The id names no concept."""


def _need(c: DataFrame, *ids: str) -> None:
    known = {r.id for r in lookups.get(c, list(ids)).select("id").collect()}
    for i in ids:
        if i not in known:
            raise UnknownConcept(i)


def explore(c: DataFrame, r: DataFrame, text: str) -> dict[str, DataFrame]:
    """All about one concept: by id, else the best text match."""
    if lookups.get(c, [text]).isEmpty():
        best = search.bm25(search.concept_fields(c), text, 1).first()
        if best is None:
            raise UnknownConcept(text)
        text = best.id
    start = c.sparkSession.createDataFrame([(text,)], "start string")
    return {
        "concept": lookups.get(c, [text]),
        "callees": lookups.callees(c, r).filter(F.col("src") == text),
        "callers": lookups.callers(c, r).filter(F.col("src") == text),
        "blast_radius": paths.transitive_callers(c, r, start),
        "cycles": stats.cycles(c, r).filter(F.col("id") == text),
    }


_RELATIONS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "callers": (("id",), lambda c, r, id: lookups.callers(c, r).filter(F.col("src") == id)),
    "callees": (("id",), lambda c, r, id: lookups.callees(c, r).filter(F.col("src") == id)),
    "path": (("id", "to"), lambda c, r, id, to: paths.shortest_call_paths(c, r, id, to)),
    "explain": (("id", "to"), lambda c, r, id, to: paths.explain(c, r, id, to)),
    "api": ((), lambda c, r: lookups.public_api(c)),
    "cycles": ((), stats.cycles),
    "modules": ((), lookups.module_dependencies),
    "isolated": ((), lookups.isolated_concepts),
    "stats": ((), stats.graph_stats),
    "layers": ((), arch.layers),
    "domains": ((), arch.domains),
    "communities": ((), arch.communities),
    "patterns": ((), lambda c, r: patterns.detect_patterns(c)),
    "features": ((), lambda c, r: patterns.detect_features(c)),
    "components": ((), stats.components),
    "coverage": ((), lambda c, r: stats.coverage(c)),
    "suggest_links": ((), search.link_candidates),
    "search": (("text",), lambda c, r, text: search.tiered(c.select("id", F.col("name").alias("title"), F.concat_ws(" ", "language", "kind").alias("type"), "tags"), text)),
    "search_ranked": (("text",), lambda c, r, text: search.bm25(search.concept_fields(c), text, 25)),
}


def dispatch(c: DataFrame, r: DataFrame, relation: str, **args: str) -> DataFrame:
    """One relation of the graph; arguments are checked before the graph is touched."""
    if relation not in _RELATIONS:
        raise ValueError(f"unknown relation {relation}; one of {', '.join(sorted(_RELATIONS))}")
    names, run = _RELATIONS[relation]
    if set(args) != set(names):
        raise ValueError(f"{relation} takes {', '.join(names) or 'no arguments'}")
    _need(c, *(v for k, v in args.items() if k in ("id", "to")))
    return run(c, r, **args)


def lines(df: DataFrame, empty: str, limit: int = 200) -> str:
    """A short report as text; ``empty`` tells that nothing was found."""
    rows = df.limit(limit).collect()
    return "\n".join("  ".join("" if v is None else str(v) for v in row) for row in rows) if rows else empty


def enrich(c: DataFrame, previous: DataFrame | None, describe: Callable[[str, str], str | None], workers: int = 4) -> DataFrame:
    """Fill blank descriptions: from an earlier bundle where it has one, else by ``describe(id, signature)``."""
    from pyspark.sql import types as T
    import pyarrow as pa

    def ask(ids: pa.Array, signs: pa.Array) -> pa.Array:
        return pa.array([describe(i, s) for i, s in zip(ids.to_pylist(), signs.to_pylist())], pa.string())

    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    todo = blank & F.col("kind").isin("Function", "Method", "Module", "Package")
    if previous is not None:
        old = previous.filter(~blank).select("id", F.col("description").alias("_old"))
        c = c.join(old, "id", "left").withColumn("description", F.when(todo & F.col("_old").isNotNull(), F.col("_old")).otherwise(F.col("description"))).drop("_old")
    rest = c.filter(todo).repartition(workers)
    asked = rest.withColumn("description", F.coalesce(F.arrow_udf(ask, T.StringType())("id", "signature"), "description"))
    return c.filter(~todo).unionByName(asked)
