"""Scanning a source tree: files by language, manifests, configuration, revision."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.files import listing, read_below
from graphloom.schema import EXTENSION

VENDORED = ("node_modules", "vendor", "target", "dist", "third_party")
MANIFESTS = {"Cargo.toml": "cargo", "package.json": "npm", "pyproject.toml": "python", "go.mod": "go"}


def _ignored(rules: list[tuple[str, str, bool]], path: str, folder: bool) -> bool:
    """Whether the last matching rule (base folder, pattern, negated) ignores a path."""
    hidden = False
    for base, pattern, negated in rules:
        if base and not path.startswith(base + "/"):
            continue
        rel = path[len(base) + 1 :] if base else path
        p = pattern.rstrip("/")
        if pattern.endswith("/") and not folder:
            continue
        anchored = "/" in p
        p = p.lstrip("/")
        if fnmatch.fnmatch(rel, p) if anchored else any(fnmatch.fnmatch(x, p) for x in [rel.rsplit("/", 1)[-1]]):
            hidden = not negated
    return hidden


def walk(root: str) -> Iterator[str]:
    """Relative paths of files that no .gitignore hides, in order; .git is skipped."""
    rules: dict[str, list[tuple[str, str, bool]]] = {}
    for here, folders, names in os.walk(root):
        rel = os.path.relpath(here, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        own = list(rules.get(rel.rsplit("/", 1)[0] if "/" in rel else "", [])) if rel else []
        if ".gitignore" in names:
            with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="replace") as f:
                for line in f.read().splitlines():
                    if line.strip() and not line.startswith("#"):
                        own.append((rel, line.strip().lstrip("!"), line.startswith("!")))
        rules[rel] = own
        join = lambda n: f"{rel}/{n}" if rel else n  # noqa: B023, E731
        folders[:] = sorted(d for d in folders if d != ".git" and not _ignored(own, join(d), True))
        yield from (join(n) for n in sorted(names) if not _ignored(own, join(n), False))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, language) of source files; the listing is made once, contents are read by tasks."""
    rows = [(p, EXTENSION[os.path.splitext(p)[1]]) for p in walk(root) if os.path.splitext(p)[1] in EXTENSION]
    return spark.createDataFrame(sorted(rows), "path string, language string")


def decode_lossy(raw: bytes) -> str:
    """UTF-8, with only the invalid bytes read as Windows-1254."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode())
            out.append(raw[at + e.start : at + e.end].decode("cp1254", "replace"))
            at += e.end
    return "".join(out)


def with_text(table: DataFrame, root: str) -> DataFrame:
    """Adds ``text`` and its ``hash``."""

    def read(paths: pa.Array) -> pa.Array:
        out = []
        for p in paths.to_pylist():
            with open(os.path.join(root, p), "rb") as f:
                out.append(decode_lossy(f.read()))
        return pa.array(out, pa.string())

    return table.withColumn("text", F.arrow_udf(read, T.StringType())("path")).withColumn("hash", F.xxhash64("text"))


def manifest_name(kind: str, text: str) -> str | None:
    """The package name that a manifest states."""
    try:
        if kind == "cargo":
            return tomllib.loads(text).get("package", {}).get("name")
        if kind == "npm":
            import json

            return json.loads(text).get("name")
        if kind == "python":
            doc = tomllib.loads(text)
            return doc.get("project", {}).get("name") or doc.get("tool", {}).get("poetry", {}).get("name")
    except (ValueError, AttributeError):
        return None
    m = re.search(r"^module\s+(\S+)", text, re.M)
    return m[1] if m else None


def packages(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, dir, pos, manifest): one package a manifest outside vendored folders.

    The id has the name at the root, else the folder with dots, and the kind of manifest where
    a folder has several.
    """
    rows = []
    for p in walk(root):
        folder, _, name = p.rpartition("/")
        if name in MANIFESTS and not set(folder.split("/")) & set(VENDORED):
            with open(os.path.join(root, p), "rb") as f:
                title = manifest_name(MANIFESTS[name], decode_lossy(f.read()))
            if title:
                rows.append((folder, title, MANIFESTS[name], p))
    several = {d for d in {r[0] for r in rows} if sum(r[0] == d for r in rows) > 1}
    out = []
    for pos, (folder, title, kind, path) in enumerate(sorted(rows)):
        base = (folder.replace("/", ".") or title) + (f".{kind}" if folder in several else "")
        out.append((f"packages/{base}", title, folder, pos, path))
    return spark.createDataFrame(out, "id string, name string, dir string, pos int, manifest string")


def config(root: str, name: str = "graphloom.toml") -> dict:
    """Output folder and diff policy; defaults where the file is missing or wrong."""
    out = {"output": "bundle", "policy": {"resolver": "warn", "confidence": "ignore"}}
    try:
        with open(os.path.join(root, name), "rb") as f:
            doc = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return out
    if isinstance(doc.get("output"), str):
        out["output"] = doc["output"]
    diff = doc.get("diff") if isinstance(doc.get("diff"), dict) else {}
    out["policy"] |= {k: v for k, v in diff.items() if k in out["policy"] and v in ("warn", "fail", "ignore")}
    return out


def write_config(root: str, output: str = "bundle", name: str = "graphloom.toml") -> None:
    with open(os.path.join(root, name), "w", encoding="utf-8") as f:
        f.write(f'output = "{output}"\n\n[diff]\nresolver = "warn"\nconfidence = "ignore"\n')


def head_revision(root: str) -> str | None:
    done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() or None if done.returncode == 0 else None


def import_dita(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Topics as Document concepts (id, name, description, file), and (file, error) of the skipped ones."""
    import xml.etree.ElementTree as ET

    names = spark.createDataFrame([(p,) for p, *_ in listing(folder) if p.endswith((".dita", ".xml"))], "file string")

    def parse(path: pa.Array) -> pa.Array:
        out = []
        for p in path.to_pylist():
            try:
                top = ET.fromstring(read_below(folder, p))
            except ET.ParseError as e:
                out.append({"id": None, "name": None, "description": None, "error": str(e)})
                continue
            found = {tag: top.find(f".//{tag}") for tag in ("title", "shortdesc")}
            words = {tag: "".join(x.itertext()).strip() if x is not None else "" for tag, x in found.items()}
            stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            ident = top.get("id") or p.rsplit(".", 1)[0].replace("/", ".")
            out.append({"id": f"documents/{ident}", "name": words["title"] or stem, "description": words["shortdesc"] or None, "error": None})
        return pa.array(out, pa.struct([(k, pa.string()) for k in ("id", "name", "description", "error")]))

    kind = T.StructType([T.StructField(k, T.StringType()) for k in ("id", "name", "description", "error")])
    rows = names.select("file", F.arrow_udf(parse, kind)("file").alias("x")).select("file", "x.*").cache()
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("file", "error")
