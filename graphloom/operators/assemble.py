"""From extracted rows to a resolved graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import last_segment
from graphloom.operators.skew import join_unique
from graphloom.schema import ascii_lower


def disambiguate_ids(c: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Ids made unique, ignoring ASCII case: the n-th by (file, line, input) gets ``-n`` from 2 on.

    An id that ends in ``index`` starts at 2. The new id is ``id``, the old one ``raw_id``.
    """
    key = ascii_lower("id")
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["file", "start_line"])))
    n = place + F.when(last_segment(key) == "index", 1).otherwise(0)
    out = c.withColumn("_n", n).withColumnRenamed("id", "raw_id")
    new = F.when(F.col("_n") > 1, F.concat("raw_id", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("raw_id"))
    return out.withColumn("id", new).drop("_n")


def symbol_table(c: DataFrame) -> DataFrame:
    """(name, n, id): functions and methods by name, over all languages; id where there is one."""
    named = c.filter(F.col("kind").isin("Function", "Method"))
    return named.groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("n"), F.min("id").alias("callee"))


def split_ambiguous_calls(calls: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (caller_id, callee_name, ...) with one candidate, self-calls dropped; and those with several."""
    found = join_unique(calls, symbol_table(c), ["callee_name"])
    sure = found.filter((F.col("n") == 1) & (F.col("caller_id") != F.col("callee"))).drop("n")
    return sure, found.filter("n > 1").drop("n", "callee")


def resolve_by_answers(calls: DataFrame, answers: DataFrame, c: DataFrame) -> DataFrame:
    """(caller_id, callee) of ambiguous calls (caller_id, callee_name, file, line, character).

    ``answers`` (file, line, character, target_file, target_line) come from an external resolver;
    a candidate is taken when its lines hold the answer. Equal keys come before the range test.
    """
    asked = calls.join(answers, ["file", "line", "character"])
    named = c.filter(F.col("kind").isin("Function", "Method")).select(F.col("id").alias("callee"), F.col("name").alias("callee_name"), F.col("file").alias("target_file"), "start_line", "end_line")
    hit = asked.join(named, ["callee_name", "target_file"]).filter(F.col("target_line").between(F.col("start_line"), F.col("end_line")))
    return hit.filter("caller_id <> callee").select("caller_id", "callee").distinct()


def smallest_containing(points: DataFrame, spans: DataFrame, on: str = "file") -> DataFrame:
    """Points (file, at, ...) with the narrowest span (file, id, start, end) around: start <= at < end.

    Spans of one file nest or are apart, as source spans do, so the last begun one that has not
    ended is the narrowest: one sorted pass over both, no range join. For spans that overlap
    otherwise use ``smallest_containing_any``.
    """
    s = spans.select(F.col(on), F.col("start").alias("_at"), F.lit(0).alias("_side"), F.struct("end", "id").alias("_span"))
    cols = [x for x in points.columns if x not in (on, "at")]
    p = points.select(F.col(on), F.col("at").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(s.schema["_span"].dataType).alias("_span"), F.struct("at", *cols).alias("_p"))
    both = s.withColumn("_p", F.lit(None).cast(p.schema["_p"].dataType)).unionByName(p)
    before = Window.partitionBy(on).orderBy("_at", "_side", F.desc("_span.end")).rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.filter(F.collect_list("_span").over(before), lambda x: x["end"] > F.col("_at"))
    found = both.withColumn("_open", open_).filter("_side = 1")
    best = F.try_element_at("_open", F.lit(-1))
    return found.select(F.col(on), "_p.*", best["id"].alias("id")).filter("id is not null")


def smallest_containing_any(points: DataFrame, spans: DataFrame, on: str = "file") -> DataFrame:
    """The same for any spans: range test after the equal file, least (width, id) per point."""
    keyed = points.withColumn("_uid", F.monotonically_increasing_id())
    pairs = keyed.join(spans, on).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    best = F.min_by(F.struct(*[F.col(x) for x in points.columns if x != on], F.col("id")), F.struct(F.col("end") - F.col("start"), "id"))
    return pairs.groupBy("_uid", on).agg(best.alias("x")).select(on, "x.*")


def link_modules(modules: DataFrame, packages: DataFrame) -> DataFrame:
    """(id, package): the package whose directory is the longest prefix of a module's file.

    Every module is asked for each of its own directories, so the longest prefix is an equal
    join on directories; the root directory is the empty one.
    """
    parts = F.split("file", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    asked = modules.select("id", F.explode(F.array_distinct(dirs)).alias("dir"))
    first = packages.groupBy("dir").agg(F.min_by("id", "pos").alias("package"))
    hit = join_unique(asked, first, ["dir"])
    return hit.groupBy("id").agg(F.max_by("package", F.length("dir")).alias("package"))


def call_relations(edges: DataFrame) -> DataFrame:
    """Calls on the caller and CalledBy on the callee for every resolved call, repeats kept."""
    how = [x for x in ("resolved_by", "confidence", "resolver_version") if x in edges.columns]
    there = edges.select(F.col("caller_id").alias("src"), F.lit("Calls").alias("kind"), F.col("callee").alias("target"), *how)
    back = edges.select(F.col("callee").alias("src"), F.lit("CalledBy").alias("kind"), F.col("caller_id").alias("target"), *how)
    return there.unionByName(back)


def split_by_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, hash, ...) already in the cache (path, hash), and those to extract anew."""
    keys = cache.select("path", "hash").distinct()
    return files.join(keys, ["path", "hash"], "left_semi"), files.join(keys, ["path", "hash"], "left_anti")


def content_hash(col):
    return F.xxhash64(col)
