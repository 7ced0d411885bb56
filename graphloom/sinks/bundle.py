"""Writing bundles and documents: markdown, HTML, GraphML, vaults, DITA.

All files are rendered by tasks; what one file needs is gathered by its concept's own keys.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.files import writing
from graphloom.operators.assemble import disambiguate_ids
from graphloom.schema import RELATION_NAMES, RELATION_ORDER, ascii_lower, location
from graphloom.session import materialize

GENERATOR = "graphloom"
BUNDLE_VERSION = "0.2"


def unique_relations(r: DataFrame) -> DataFrame:
    """The first of each (src, kind, target)."""
    first = r.groupBy("src", "kind", "target").agg(F.min_by(F.struct("pos", "target_display", "resolved_by", "confidence", "resolver_version"), "pos").alias("x"))
    return first.select("src", "kind", "target", "x.*")


def pages(c: DataFrame, r: DataFrame, unique: bool = True) -> DataFrame:
    """Concepts with their relations as an array in list order."""
    r = unique_relations(r) if unique else r
    item = F.struct("pos", "kind", "target", "target_display", "resolved_by", "confidence", "resolver_version")
    rels = r.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("relations"))
    return c.join(rels, "id", "left").withColumn("resource", location())


def _q(value: str) -> str:
    return json.dumps(value, ensure_ascii=False)


def relative(path: str, target: str) -> str:
    return "../" * path.count("/") + target


def render_concept(row: dict) -> str:
    """Frontmatter and sections of one concept."""
    out = ["---", f"type: {_q(row['language'] + ' ' + row['kind'])}", f"title: {_q(row['name'])}"]
    if row["description"]:
        out.append(f"description: {_q(row['description'])}")
    if row["resource"]:
        out.append(f"resource: {_q(row['resource'])}")
    if row["tags"]:
        out.append("tags: [" + ", ".join(map(_q, row["tags"])) + "]")
    if row["is_public"] is False:
        out.append("visibility: private")
    if row["generated_at"] is not None:
        out += ["generated:", f"  by: {_q(GENERATOR)}", f"  at: {_q(row['generated_at'].strftime('%Y-%m-%dT%H:%M:%SZ'))}"]
    rels = row["relations"] or []
    kinds = sorted({x["kind"] for x in rels}, key=RELATION_ORDER.__getitem__)
    if rels:
        out.append("relationships:")
    for kind in kinds:
        out.append(f"  {RELATION_NAMES[kind]}:")
        for x in (x for x in rels if x["kind"] == kind):
            out.append(f"    - target: {_q(x['target'])}")
            out += [f"      {k}: {_q(x[k])}" for k in ("resolved_by", "confidence", "resolver_version") if x[k] is not None]
    out += ["---", ""]
    if row["signature"]:
        out += ["# Signature", "", f"`{row['signature']}`", ""]
    for kind in kinds:
        out += [f"# {kind}", ""]
        for x in (x for x in rels if x["kind"] == kind):
            name = x["target_display"] or x["target"]
            out.append(f"- {name}" if x["target"].startswith("external/") else f"- [{name}]({relative(row['id'], x['target'])}.md)")
        out.append("")
    return "\n".join(out)


def render_html(row: dict) -> str:
    links = "".join(
        f"<li>{x['kind']}: " + (html.escape(x["target_display"] or x["target"]) if x["target"].startswith("external/") else f'<a href="{html.escape(relative(row["id"], x["target"]))}.html">{html.escape(x["target_display"] or x["target"])}</a>') + "</li>"
        for x in row["relations"] or []
    )
    sign = f"<pre>{html.escape(row['signature'])}</pre>" if row["signature"] else ""
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(row['name'])}</title></head><body><h1>{html.escape(row['name'])}</h1><p>{html.escape(row['description'] or '')}</p>{sign}<ul>{links}</ul></body></html>\n"


def render_vault(row: dict) -> str:
    lines = [f"# {row['name']}", "", row["description"] or "", ""]
    lines += [f"- {x['kind']}: [[{x['target']}|{x['target_display'] or x['target']}]]" for x in row["relations"] or []]
    return "\n".join(lines) + "\n"


def render_dita(row: dict) -> str:
    items = "".join(f"<li>{x['kind']}: {html.escape(x['target_display'] or x['target'])}</li>" for x in row["relations"] or [])
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE topic PUBLIC "-//OASIS//DTD DITA Topic//EN" "topic.dtd">\n'
        f'<topic id="{html.escape(row["id"].replace("/", "."))}"><title>{html.escape(row["name"])}</title><shortdesc>{html.escape(row["description"] or "")}</shortdesc><body><ul>{items}</ul></body></topic>\n'
    )


def write_pages(table: DataFrame, root: str, render: Callable[[dict], str], suffix: str) -> int:
    """One file a row, at its id; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                with writing(f"{root}/{row['id']}{suffix}") as out:
                    out.write(render(row).encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return materialize(table.mapInArrow(run, "n long"), "pages").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def directory(col: str = "id"):
    return F.regexp_extract(col, r"^(.*)/[^/]*$", 1)


def write_indexes(c: DataFrame, root: str, revision: str | None = None, suffix: str = ".md", name: str = "index") -> None:
    """A listing for each folder, and the root's with version, generator and counts."""
    rows = c.select(directory().alias("dir"), F.struct("id", "name").alias("x"))
    listed = rows.groupBy("dir").agg(F.sort_array(F.collect_list("x")).alias("entries"), F.count("*").alias("n")).withColumn("id", F.concat_ws("/", "dir", F.lit(name)))

    def render(row: dict) -> str:
        lines = [f"# {row['dir']}", ""]
        return "\n".join(lines + [f"- [{e['name']}]({e['id'].rsplit('/', 1)[-1]}{suffix})" for e in row["entries"]]) + "\n"

    write_pages(listed, root, render, suffix)
    counts = sorted(tuple(r) for r in listed.select("dir", "n").collect())  # one row a folder
    head = ["---", f'bundle_version: "{BUNDLE_VERSION}"', f"generator: {GENERATOR}", *([f"source_revision: {revision}"] if revision else []), "---", "", "# Index", ""]
    with writing(f"{root}/{name}{suffix}") as out:
        out.write(("\n".join([*head, *(f"- [{d}]({d}/{name}{suffix}) ({n})" for d, n in counts)]) + "\n").encode())


def write_bundle(c: DataFrame, r: DataFrame, root: str, revision: str | None = None) -> int:
    """A file for each concept and the indexes; ids that clash but for case are refused."""
    clash = c.groupBy(ascii_lower("id")).count().filter("count > 1")
    if not clash.isEmpty():
        c = disambiguate_ids(c).drop("raw_id")
        if not c.groupBy(ascii_lower("id")).count().filter("count > 1").isEmpty():
            raise ValueError("ids still clash after numbering")
    n = write_pages(pages(c, r), root, render_concept, ".md")
    write_indexes(c, root, revision)
    return n


def write_html(c: DataFrame, r: DataFrame, root: str) -> int:
    n = write_pages(pages(c, r, unique=False), root, render_html, ".html")
    write_indexes(c, root, suffix=".html", name="@index")
    return n


def write_vault(c: DataFrame, r: DataFrame, root: str) -> int:
    return write_pages(pages(c, r, unique=False), root, render_vault, ".md")


def write_dita(c: DataFrame, r: DataFrame, root: str) -> int:
    n = write_pages(pages(c, r, unique=False), root, render_dita, ".dita")
    lines = [f'<topicref href="{html.escape(i)}.dita"/>' for i in _stream(c.select("id").orderBy("id"))]
    with writing(f"{root}/map.ditamap") as out:
        out.write(('<?xml version="1.0" encoding="UTF-8"?>\n<map>\n' + "\n".join(lines) + "\n</map>\n").encode())
    return n


def _stream(df: DataFrame) -> Iterator[str]:
    """Values of the first column, fetched partition by partition."""
    for row in df.toLocalIterator():
        yield row[0]


def graphml_parts(c: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge elements; CalledBy and targets outside are left out."""
    esc = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    node = F.concat(F.lit('<node id="'), esc(F.col("id")), F.lit('"><data key="name">'), esc(F.col("name")), F.lit('</data><data key="kind">'), F.col("kind"), F.lit("</data></node>"))
    edges = r.filter("kind <> 'CalledBy'").join(c.select(F.col("id").alias("target")), "target", "left_semi")
    edge = F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("target")), F.lit('"><data key="kind">'), F.col("kind"), F.lit("</data></edge>"))
    return c.orderBy("id").select(node.alias("xml")), edges.orderBy("src", "pos").select(edge.alias("xml"))


def write_graphml(c: DataFrame, r: DataFrame, uri: str) -> None:
    nodes, edges = graphml_parts(c, r)
    with writing(uri) as out:
        out.write(b'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><key id="kind" for="all" attr.name="kind" attr.type="string"/><graph edgedefault="directed">\n')
        for part in (nodes, edges):
            for line in _stream(part):
                out.write(line.encode() + b"\n")
        out.write(b"</graph></graphml>\n")


def write_markdown(c: DataFrame, r: DataFrame, uri: str) -> None:
    """One document with a table of contents, streamed in id order."""
    table = pages(c, r, unique=False).orderBy("id")
    with writing(uri) as out:
        out.write(b"# Contents\n\n")
        for i in _stream(table.select("id")):
            out.write(f"- {i}\n".encode())
        for row in table.toLocalIterator():
            lines = ["", f"## {row.name} ({row.id})", "", row.description or ""]
            lines += [f"- {x['kind']}: {x['target_display'] or x['target']}" for x in row.relations or []]
            out.write(("\n".join(lines) + "\n").encode())


BEGIN, END = "<!-- graphloom:begin -->", "<!-- graphloom:end -->"


def merge_section(text: str, section: str) -> str:
    """Put a marked section into a document, in place of an earlier one."""
    block = f"{BEGIN}\n{section}\n{END}"
    if BEGIN in text and END in text:
        head, rest = text.split(BEGIN, 1)
        return head + block + rest.split(END, 1)[1]
    return text.rstrip("\n") + ("\n\n" if text.strip() else "") + block + "\n"
