"""Reading a bundle: a folder of markdown files with YAML frontmatter.

One pass parses every file once; readers, search and validation are projections of that. The
reader drops files it can't parse, search keeps all with a ``type``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.files import listing, read_below
from graphloom.schema import CONCEPT_SCHEMA, KIND_ORDER, LANGUAGES, RELATION_KEYS, RELATION_ORDER, RELATION_SCHEMA, conform

SIGNATURE_HEADING = "# Signature"


def bundle_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all markdown files, paths relative to the folder, line ends as \\n."""
    names = [(p,) for p, *_ in listing(folder) if p.endswith(".md")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [read_below(folder, p).decode("utf-8", "replace").replace("\r\n", "\n") for p in part.column("path").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(texts, pa.string())], ["path", "content"])

    return spark.createDataFrame(names, "path string").mapInArrow(read, "path string, content string")


def split_frontmatter(content: str) -> tuple[str | None, str]:
    """The YAML between the first two ``---`` lines, and the rest."""
    m = re.match(r"---\n(.*?)(?:\n)?^---\s*$\n?", content, re.S | re.M)
    return (m[1], content[m.end() :]) if m else (None, content)


def load_yaml(text: str) -> Any:
    import yaml

    class Plain(yaml.SafeLoader):
        """Dates stay text."""

    Plain.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return yaml.load(text, Loader=Plain)  # noqa: S506


def parse_relations(entry: Any) -> list[dict]:
    """Relations in list order; entries are plain targets or mappings, unknown kinds are skipped."""
    out: list[dict] = []
    for key, targets in (entry or {}).items() if isinstance(entry, dict) else ():
        kind = RELATION_KEYS.get(key)
        for t in targets if kind and isinstance(targets, list) else ():
            how = t if isinstance(t, dict) else {"target": t}
            if not isinstance(how.get("target"), str):
                continue
            sure = how.get("confidence")
            version = how.get("resolver_version")
            out.append(
                {
                    "pos": len(out) + 1,
                    "kind": kind,
                    "rel_ord": RELATION_ORDER[kind],
                    "target": how["target"],
                    "resolved_by": how["resolved_by"] if isinstance(how.get("resolved_by"), str) else "tree-sitter",
                    "confidence": sure if sure in ("exact", "semantic") else "exact",
                    "resolver_version": str(version) if version is not None else None,
                }
            )
    return out


def parse_concept(path: str, content: str) -> dict | None:
    """One file as a row with its relations, or None."""
    head, body = split_frontmatter(content)
    if head is None:
        return None
    try:
        fm = load_yaml(head)
    except Exception:  # malformed YAML: not a concept
        return None
    if not isinstance(fm, dict) or not isinstance(fm.get("type"), str) or " " not in fm["type"]:
        return None
    language, kind = fm["type"].split(" ", 1)
    if language not in LANGUAGES or kind not in KIND_ORDER:
        return None
    ident = path.removesuffix(".md")
    m = re.fullmatch(r"(.*)#L(\d+)(?:-L(\d+))?", str(fm.get("resource") or ""))
    sign = re.search(rf"^{re.escape(SIGNATURE_HEADING)}\n+`([^`]*)`", body, re.M)
    made = fm.get("generated")
    at = made.get("at") if isinstance(made, dict) else fm.get("timestamp")
    return {
        "id": ident,
        "kind": kind,
        "kind_ord": KIND_ORDER[kind],
        "language": language,
        "name": fm["title"] if isinstance(fm.get("title"), str) else ident.rsplit("/", 1)[-1],
        "qualified_name": ident.split("/", 1)[-1].replace("/", "::"),
        "description": fm["description"] if isinstance(fm.get("description"), str) else None,
        "file": m[1] if m else "",
        "start_line": int(m[2]) if m else 0,
        "end_line": int(m[3] or m[2]) if m else 0,
        "signature": sign[1] if sign else None,
        "tags": [t for t in fm.get("tags") or [] if isinstance(t, str)] if isinstance(fm.get("tags"), list) else [],
        "is_public": fm.get("visibility") != "private",
        "generated_at": str(at) if at is not None else None,
        "relations": parse_relations(fm.get("relationships")),
    }


_REL = "array<struct<pos:int,kind:string,rel_ord:int,target:string,resolved_by:string,confidence:string,resolver_version:string>>"


def read_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and relationships; a target's title is shown with it, or its id where it has none."""
    schema = CONCEPT_SCHEMA.replace("generated_at timestamp", "generated_at string") + f", relations {_REL}"
    names = [c.split(" ", 1)[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["content"]) if p.rsplit("/", 1)[-1] != "index.md" and (r := parse_concept(p, t))]
            yield pd.DataFrame(rows, columns=names)

    rows = bundle_files(spark, folder).mapInPandas(run, schema).cache()
    concepts = conform(rows.withColumn("generated_at", F.try_to_timestamp("generated_at")), CONCEPT_SCHEMA)
    edges = rows.select(F.col("id").alias("src"), F.explode("relations").alias("r")).select("src", "r.*")
    titles = concepts.select(F.col("id").alias("target"), F.col("name").alias("_title"))
    shown = edges.join(titles, "target", "left").withColumn("target_display", F.coalesce("_title", "target"))
    return concepts, conform(shown, RELATION_SCHEMA)


def search_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, type, tags) of every file with a text ``type``, known or not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    fm = load_yaml(split_frontmatter(content)[0] or "")
                except Exception:  # malformed YAML: not searchable
                    continue
                if isinstance(fm, dict) and isinstance(fm.get("type"), str):
                    ident = path.removesuffix(".md")
                    tags = [t for t in fm["tags"] if isinstance(t, str)] if isinstance(fm.get("tags"), list) else []
                    rows.append((ident, str(fm.get("title") or ident.rsplit("/", 1)[-1]), fm["type"], tags))
            yield pd.DataFrame(rows, columns=["id", "title", "type", "tags"])

    return bundle_files(spark, folder).mapInPandas(run, "id string, title string, type string, tags array<string>")


def frontmatter_rows(files: DataFrame) -> DataFrame:
    """Fields that the frontmatter rules look at, one row a file (path, content)."""
    schema = (
        "path string, has_block boolean, parse_error string, is_mapping boolean, type string, tags_ok boolean, timestamp string, status string, "
        "stale_after string, runtime string, resource string, bundle_version string"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    text = lambda v: None if v is None else str(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                head, _ = split_frontmatter(content.replace("\r\n", "\n"))
                fm, error = None, None
                if head is not None:
                    try:
                        fm = load_yaml(head)
                    except Exception as e:  # reported as an issue
                        error = str(e).split("\n")[0]
                fields = fm if isinstance(fm, dict) else {}
                tags = fields.get("tags")
                rows.append(
                    {
                        "path": path,
                        "has_block": head is not None,
                        "parse_error": error,
                        "is_mapping": isinstance(fm, dict),
                        "type": fields["type"] if isinstance(fields.get("type"), str) else None,
                        "tags_ok": tags is None or isinstance(tags, list) and all(isinstance(t, str) for t in tags),
                        **{k: text(fields.get(k)) for k in ("timestamp", "status", "stale_after", "runtime", "resource")},
                        "bundle_version": text(fields.get("bundle_version")),
                    }
                )
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)
