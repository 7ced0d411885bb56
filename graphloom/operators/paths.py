"""Reachability and shortest paths over calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import reachable
from graphloom.operators.lookups import call_edges, related
from graphloom.session import materialize


def transitive_callers(c: DataFrame, r: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, id, depth): all that call a start, directly or not; the start itself is left out.

    ``starts`` has a column ``start``; unknown ids give nothing.
    """
    found = reachable(call_edges(c, r, ("CalledBy",)), _known(c, starts), max_depth)
    return found.filter("node <> start").select("start", F.col("node").alias("id"), "depth")


def _known(c: DataFrame, starts: DataFrame) -> DataFrame:
    return starts.join(c.select(F.col("id").alias("start")), "start", "left_semi").select("start", F.col("start").alias("node"))


def transitive_caller_counts(c: DataFrame, r: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, n): the rows that ``transitive_callers`` has of each known start, counted by the tasks that find them."""
    found = reachable(call_edges(c, r, ("CalledBy",)), _known(c, starts), max_depth, counted=True)
    return found.select("start", (F.col("n") - 1).alias("n"))


def shortest_call_paths(c: DataFrame, r: DataFrame, start: str, goal: str | None = None, max_hops: int = 10_000) -> DataFrame:
    """(id, hops, path): the first path that a breadth-first search in list order finds.

    That is the least sequence of edge places among the shortest ones, so each round keeps the
    least (places, ids) of every new node. Stops early when ``goal`` is reached.
    """
    edges = related(c, r, "Calls").select("src", "pos", F.col("id").alias("dst"))
    edges = materialize(edges.groupBy("src", "dst").agg(F.min("pos").alias("pos")), "path-edges")
    first = c.filter(F.col("id") == start).select(F.col("id").alias("node"), F.array().cast("array<int>").alias("places"), F.array("id").alias("path"))
    seen = front = materialize(first, "paths")
    for hop in range(max_hops):
        if goal is not None and not front.filter(F.col("node") == goal).isEmpty():
            break
        grown = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), F.concat("places", F.array("pos")).alias("places"), F.concat("path", F.array("dst")).alias("path"))
        grown = grown.join(seen.select("node"), "node", "left_anti")
        best = grown.groupBy("node").agg(F.min(F.struct("places", "path")).alias("best")).select("node", "best.*")
        front = materialize(best, "paths")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 8 == 7:
            seen = materialize(seen, "paths-seen")
    out = seen.select(F.col("node").alias("id"), (F.size("path") - 1).alias("hops"), "path")
    return out if goal is None else out.filter(F.col("id") == goal)


def explain(c: DataFrame, r: DataFrame, a: str, b: str) -> DataFrame:
    """The first relation of any kind from a to b, else from b to a, else one row a hop of the path."""
    cols = ["src", "kind", "target", "resolved_by", "confidence", "resolver_version"]
    for x, y in ((a, b), (b, a)):
        direct = r.filter((F.col("src") == x) & (F.col("target") == y)).orderBy("pos").limit(1).select(*cols)
        if not direct.isEmpty():
            return direct.withColumn("explanation", explanation())
    path = shortest_call_paths(c, r, a, b)
    hops = path.select(F.posexplode("path").alias("at", "src"), "path").withColumn("target", F.try_element_at("path", F.col("at") + 2)).filter("target is not null")
    first = r.filter("kind = 'Calls'").groupBy("src", "target").agg(F.min_by(F.struct("kind", "resolved_by", "confidence", "resolver_version"), "pos").alias("rel"))
    return hops.join(first, ["src", "target"]).orderBy("at").select("src", "rel.kind", "target", "rel.resolved_by", "rel.confidence", "rel.resolver_version").withColumn("explanation", explanation())


def explanation():
    by = F.when(F.col("resolver_version").isNotNull(), F.concat(F.col("resolved_by"), F.lit(" "), F.col("resolver_version"))).otherwise(F.col("resolved_by"))
    return F.when(F.col("confidence") == "exact", F.concat(F.lit("found in the syntax tree by "), by)).when(
        F.col("confidence") == "semantic", F.concat(F.lit("resolved from meaning by "), by)
    ).otherwise(F.concat(F.lit("stated by "), by))
