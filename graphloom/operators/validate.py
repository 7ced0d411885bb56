"""Integrity passes over a bundle; each gives issue rows (severity, kind, file, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_date, is_rfc3339, normalize_path
from graphloom.operators.fixpoint import reachable
from graphloom.schema import ascii_lower

ERROR, WARNING = "error", "warning"


def issues(rows: DataFrame, severity: str, kind: str, message: Column, file: str = "path") -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col(file).alias("file"), message.alias("message"))


def required_index(files: DataFrame) -> DataFrame:
    """The root needs an ``index.md``."""
    has = files.agg(F.count_if(F.col("path") == "index.md").alias("n")).filter("n = 0").withColumn("path", F.lit("index.md"))
    return issues(has, ERROR, "MissingIndex", F.lit("the bundle has no root index"))


_STATUS = ("draft", "stable", "deprecated", "experimental")


def frontmatter(fm: DataFrame) -> DataFrame:
    """Rules on (path, has_block, parse_error, is_mapping, type, tags_ok, timestamp, status, stale_after, kind_of, runtime)."""
    ok = F.col("has_block") & F.col("parse_error").isNull() & F.col("is_mapping")
    rules = [
        (~F.col("has_block"), "NoFrontmatter", F.lit("no frontmatter block")),
        (F.col("has_block") & F.col("parse_error").isNotNull(), "BadYaml", F.col("parse_error")),
        (F.col("has_block") & F.col("parse_error").isNull() & ~F.col("is_mapping"), "BadYaml", F.lit("frontmatter is not a mapping")),
        (ok & (F.trim(F.coalesce("type", F.lit(""))) == ""), "MissingType", F.lit("type is missing or blank")),
        (ok & ~F.coalesce("tags_ok", F.lit(True)), "BadTags", F.lit("tags must be a list of strings")),
        (ok & F.col("timestamp").isNotNull() & ~is_rfc3339(F.col("timestamp")), "BadTimestamp", F.concat(F.lit("not RFC 3339: "), F.col("timestamp"))),
        (ok & F.col("status").isNotNull() & ~F.col("status").isin(*_STATUS), "BadStatus", F.concat(F.lit("unknown status "), F.col("status"))),
        (ok & F.col("stale_after").isNotNull() & ~is_date(F.col("stale_after")), "BadDate", F.concat(F.lit("not a date: "), F.col("stale_after"))),
        (ok & (F.col("type") == "Attested Computation") & F.col("runtime").isNull(), "MissingRuntime", F.lit("an attested computation names its runtime")),
    ]
    return union([issues(fm.filter(F.coalesce(cond, F.lit(False))), ERROR, kind, text) for cond, kind, text in rules])


def actor_format(actors: DataFrame) -> DataFrame:
    """Actors (path, actor) are ``human:x``, ``process:x`` or ``a/b``."""
    bad = actors.filter(~F.col("actor").rlike(r"^(human:.+|process:.+|[^/\s]+/[^/\s]+)$"))
    return issues(bad, WARNING, "ActorFormat", F.concat(F.lit("unusual actor "), F.col("actor")))


def stamps(rows: DataFrame, what: str) -> DataFrame:
    """Entries (path, is_mapping, by, at) of ``generated`` and ``verified``."""
    mapping = F.coalesce("is_mapping", F.lit(False))
    blank = F.trim(F.coalesce("by", F.lit(""))) == ""
    return union(
        [
            issues(rows.filter(~mapping), ERROR, "BadStamp", F.lit(f"{what} must be a mapping")),
            issues(rows.filter(mapping & blank), ERROR, "BadStamp", F.lit(f"{what} has no by")),
            issues(rows.filter(mapping & F.col("at").isNotNull() & ~is_rfc3339(F.col("at"))), ERROR, "BadStamp", F.lit(f"{what} has a bad time")),
        ]
    )


def sources(rows: DataFrame) -> DataFrame:
    """Entries (path, is_mapping, resource, date, count)."""
    mapping = F.coalesce("is_mapping", F.lit(False))
    return union(
        [
            issues(rows.filter(~mapping), ERROR, "BadSource", F.lit("a source must be a mapping")),
            issues(rows.filter(mapping & (F.trim(F.coalesce("resource", F.lit(""))) == "")), ERROR, "BadSource", F.lit("a source has no resource")),
            issues(rows.filter(mapping & F.col("date").isNotNull() & ~is_date(F.col("date"))), ERROR, "BadSource", F.lit("a source has a bad date")),
            issues(rows.filter(mapping & F.col("count").isNotNull() & ~F.col("count").rlike(r"^\d+$")), ERROR, "BadSource", F.lit("a source has a bad count")),
        ]
    )


def usage_window(rows: DataFrame) -> DataFrame:
    bad = rows.filter(~(is_date(F.col("from")) & is_date(F.col("to"))))
    return issues(bad, ERROR, "BadUsageWindow", F.lit("from and to must be dates"))


def index_frontmatter(index: DataFrame) -> DataFrame:
    """Index files (path, has_block, bundle_version): only the root's has a block, with digits.digits."""
    other = index.filter("has_block and path <> 'index.md'")
    version = index.filter((F.col("path") == "index.md") & F.col("has_block") & ~F.coalesce(F.col("bundle_version").rlike(r"^\d+\.\d+$"), F.lit(False)))
    return union([issues(other, ERROR, "IndexFrontmatter", F.lit("only the root index has frontmatter")), issues(version, ERROR, "IndexVersion", F.lit("the version must be digits.digits"))])


def _shared(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows whose key others have too; keys of many rows are counted before the join."""
    keyed = rows.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    names = [f"_k{i}" for i in range(len(keys))]
    often = keyed.groupBy(*names).agg(F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(often, names).drop(*names)


def duplicate_ids(files: DataFrame) -> DataFrame:
    """Paths that differ at most in ASCII case; one issue a file."""
    return issues(_shared(files.select("path"), [ascii_lower("path")]), ERROR, "DuplicateId", F.concat(F.lit("also written in "), (F.col("_n") - 1).cast("string"), F.lit(" other ways")))


def duplicate_resources(rows: DataFrame) -> DataFrame:
    """The same resource in several concepts (path, resource, is_module); modules apart from others."""
    rows = rows.filter("resource is not null").select("path", "resource", "is_module")
    return issues(_shared(rows, [F.col("resource"), F.col("is_module")]), ERROR, "DuplicateResource", F.concat(F.lit("shared resource "), F.col("resource")))


def relation_targets(c: DataFrame, r: DataFrame) -> DataFrame:
    """Targets inside the bundle that name no concept."""
    inside = r.filter(~F.startswith("target", F.lit("external/")))
    missing = inside.join(c.select(F.col("id").alias("target")), "target", "left_anti")
    return issues(missing, ERROR, "MissingTarget", F.concat("kind", F.lit(" "), "target"), "src")


def relation_symmetry(c: DataFrame, r: DataFrame) -> DataFrame:
    """Calls without CalledBy on the other side, and the other way round; the target's file is to blame."""
    ids = c.select(F.col("id").alias("target"))
    calls = r.filter(F.col("kind").isin("Calls", "CalledBy")).select("src", "kind", "target").distinct()
    back = F.when(F.col("kind") == "Calls", "CalledBy").otherwise("Calls")
    mirror = calls.select(F.col("target").alias("src"), back.alias("kind"), F.col("src").alias("target"))
    lone = calls.join(mirror, ["src", "kind", "target"], "left_anti").join(ids, "target", "left_semi")
    return issues(lone, WARNING, "Asymmetric", F.concat(F.lit("no reverse of "), "kind", F.lit(" from "), "src"), "target")


def relation_provenance(r: DataFrame) -> DataFrame:
    real = (F.col("resolved_by") != "tree-sitter") & (F.col("resolved_by") != "")
    return union(
        [
            issues(r.filter(~F.coalesce(F.col("confidence").isin("exact", "semantic"), F.lit(False))), ERROR, "BadConfidence", F.concat(F.lit("confidence of "), "target"), "src"),
            issues(r.filter(F.col("resolved_by") == ""), ERROR, "NoResolver", F.concat(F.lit("no resolver for "), "target"), "src"),
            issues(r.filter(F.col("resolver_version").isNotNull() & ~F.coalesce(real, F.lit(False))), WARNING, "StrayVersion", F.concat(F.lit("version without a resolver for "), "target"), "src"),
        ]
    )


def local_links(files: DataFrame) -> DataFrame:
    """(path, section, at, link): markdown links to local files, fragments cut off; sections begin at ``# ``."""
    body = F.regexp_replace("content", "\r\n", "\n")
    parts = F.split(body, r"(?m)^(?=# )")
    sections = files.select("path", F.posexplode(parts).alias("section", "body"))
    found = sections.select("path", "section", F.posexplode(F.regexp_extract_all("body", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))).alias("at", "link"))
    local = found.filter(~F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    return local.withColumn("link", F.regexp_replace("link", "#.*$", "")).filter(F.endswith("link", F.lit(".md")))


def resolved_links(links: DataFrame) -> DataFrame:
    """Adds ``target``: the file a link leads to, null when it leaves the root."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    whole = F.when(F.startswith("link", F.lit("/")), F.expr("substring(link, 2)")).otherwise(F.concat(folder, F.col("link")))
    return links.withColumn("target", normalize_path(whole))


def repeated(links: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Links that occurred before under the same keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return links.withColumn("_n", n).filter("_n > 1").drop("_n")


def dangling(links: DataFrame, known: DataFrame, on: str = "target") -> DataFrame:
    return links.join(known.select(on).distinct(), on, "left_anti")


def link_issues(files: DataFrame) -> DataFrame:
    links = resolved_links(local_links(files))
    known = files.select(F.col("path").alias("target"))
    out = links.filter("target is null")
    lost = dangling(links.filter("target is not null"), known)
    again = repeated(links, ["path", "section", "link"], ["at"])
    return union(
        [
            issues(out, ERROR, "LinkEscapes", F.col("link")),
            issues(lost, ERROR, "DanglingLink", F.col("link")),
            issues(again, WARNING, "RepeatedLink", F.col("link")),
        ]
    )


def orphans(files: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (path) that no chain of edges (src, dst) from the roots (path) reaches."""
    seen = reachable(edges, roots.select(F.lit(0).alias("start"), F.col("path").alias("node")))
    return files.select("path").join(seen.select(F.col("node").alias("path")), "path", "left_anti")


def reachability(files: DataFrame) -> DataFrame:
    links = resolved_links(local_links(files)).filter("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    lost = orphans(files.filter(F.endswith("path", F.lit(".md"))), links, files.filter("path = 'index.md'"))
    lost = lost.filter(~F.col("path").rlike("(^|/)index\\.md$"))
    return issues(lost, WARNING, "Orphan", F.lit("not reachable from the root index"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fails(found: DataFrame, ci: bool = False) -> bool:
    """Any error fails; with ``ci`` an orphan does too."""
    bad = F.col("severity") == ERROR
    if ci:
        bad = bad | (F.col("kind") == "Orphan")
    return not found.filter(bad).isEmpty()
