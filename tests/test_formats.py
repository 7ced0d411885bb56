"""Bundles, exports, extraction, validation, search and increments on small inputs."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.extract import extract_source
from graphloom.functions.text import normalize_path, split_identifier_words
from graphloom.operators import assemble, patterns, search, validate
from graphloom.sinks import bundle as sinks
from graphloom.sources import bundle, project
from graphloom.streaming import incremental

SOURCES = {
    "Rust": ("src/lib.rs", "use std::fmt;\n// fn no() {}\npub struct S { x: u8 }\nenum E { A }\npub trait T { fn t(&self); }\nimpl fmt::Display for S {\n  fn fmt(&self) { help(\"a { b\"); }\n}\nimpl S { pub fn new() -> S { S::make() } }\npub(crate) fn help() {}\n", {("Struct", "S", True), ("Enum", "E", False), ("Trait", "T", True), ("Method", "t", False), ("Method", "fmt", False), ("Method", "new", True), ("Function", "help", True)}, {"help", "make"}),
    "Python": ("pkg/__init__.py", "import os\nfrom a.b import c\n\nclass K:\n    @property\n    def m(self):\n        return helper(self.x())\n\ndef _private():\n    pass\n\nasync def helper(x=1):\n    return K().m\n", {("Class", "K", True), ("Method", "m", True), ("Function", "_private", False), ("Function", "helper", True)}, {"helper", "x", "K"}),
    "TypeScript": ("a.ts", "import { x } from 'lib/x';\nexport class A extends B {\n  constructor(private y: number) { super(); }\n  private run(): void { go(1); }\n}\ninterface I { z(): void }\nexport function f<T>(a: T) { return g(a); }\nconst h = (q: number) => { f(q); };\n", {("Class", "A", True), ("Method", "constructor", True), ("Method", "run", True), ("Interface", "I", True), ("Function", "f", True), ("Function", "h", True)}, {"go", "g", "f"}),
    "JavaScript": ("b.js", "const x = require('y');\nclass A { m() { return n(); } }\nfunction _f() { m(); }\n", {("Class", "A", True), ("Method", "m", True), ("Function", "_f", False)}, {"n", "m"}),
    "Go": ("m.go", 'package m\nimport "fmt"\ntype P struct { X int }\ntype R interface { Read() }\nfunc (p *P) String() string { return fmt.Sprint(p) }\nfunc run() { String() }\n', {("Struct", "P", True), ("Interface", "R", True), ("Method", "String", True), ("Function", "run", False)}, {"Sprint", "String"}),
    "Java": ("A.java", "import java.util.List;\npublic class A {\n  public A() { init(); }\n  private void init() { new B(); }\n  public <T> List<T> all(int a) throws X { return find(a); }\n}\ninterface I { void run(); }\nenum E { X }\n", {("Class", "A", True), ("Method", "A", True), ("Method", "init", False), ("Method", "all", True), ("Interface", "I", False), ("Method", "run", False), ("Enum", "E", False)}, {"init", "B", "find"}),
    "C#": ("A.cs", "using System;\npublic class A {\n  public A() : base() { }\n  internal int Go(int x) => Run(x);\n  public void Run(int x) { Console.Write(x); }\n}\npublic struct S { }\n", {("Class", "A", True), ("Method", "A", True), ("Method", "Go", False), ("Method", "Run", True), ("Struct", "S", True)}, {"Write"}),
    "PHP": ("a.php", "<?php\nuse App\\X;\ninterface I { public function i(); }\ntrait T { }\nclass A {\n  private function p() { q(); }\n  function r() { }\n}\nfunction q() { }\n", {("Interface", "I", True), ("Method", "i", True), ("Trait", "T", True), ("Class", "A", True), ("Method", "p", False), ("Method", "r", True), ("Function", "q", True)}, {"q"}),
    "Kotlin": ("a.kt", "import a.b\ninterface I\nenum class E { A }\nobject O { fun o() { p() } }\nprivate fun p() { }\nclass C(val x: Int) { internal fun q() { o() } }\n", {("Interface", "I", True), ("Enum", "E", True), ("Class", "O", True), ("Method", "o", True), ("Function", "p", False), ("Class", "C", True), ("Method", "q", False)}, {"p", "o"}),
    "C++": ("a.cpp", "#include <vector>\nclass A {\npublic:\n  void f() { g(); }\nprivate:\n  int h() { return 1; }\n};\nstruct S { void m() { } };\nvoid A::out() { f(); }\nint main(int c) { return helper(c); }\nint declared(int);\n", {("Class", "A", False), ("Method", "f", True), ("Method", "h", False), ("Struct", "S", True), ("Method", "m", True), ("Method", "out", False), ("Function", "main", True)}, {"g", "f", "helper"}),
    "Swift": ("a.swift", "import Foundation\npublic protocol P { func p() }\npublic struct S { public func s() { t() } }\nclass C { func c() { } }\nenum E { case a }\nextension S { func u() { s() } }\nfunc t() { }\n", {("Interface", "P", True), ("Method", "p", False), ("Struct", "S", True), ("Method", "s", True), ("Class", "C", False), ("Method", "c", False), ("Enum", "E", False), ("Method", "u", False), ("Function", "t", False)}, {"t", "s"}),
}


@pytest.mark.parametrize("language", SOURCES)
def test_extractors(language):
    path, text, want, called = SOURCES[language]
    concepts, calls, imports = extract_source(path, language, text)
    assert concepts[0]["kind"] == "Module" and imports
    assert {(c["kind"], c["name"], c["is_public"]) for c in concepts[1:]} == want
    assert {c["callee_name"] for c in calls} == called
    for c in calls:
        line = text.split("\n")[c["line"]]
        assert line[c["character"] :].startswith(c["callee_name"])


def test_rust_trait_impls_are_told_apart():
    concepts, *_ = extract_source("src/a.rs", "Rust", "struct S;\nimpl From<u8> for S { fn from(x: u8) -> S { S } }\nimpl From<u16> for S { fn from(x: u16) -> S { S } }\n")
    ids = [c["id"] for c in concepts if c["name"] == "from"]
    assert len(set(ids)) == 2


def test_analyze_write_read(spark, tmp_path):
    for path, text in (("pkg/Cargo.toml", '[package]\nname = "demo"\n'), (".gitignore", "skip/\n*.tmp\n"), ("skip/x.rs", "fn hidden() {}"), ("node_modules/package.json", '{"name": "no"}')):
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    for language in ("Rust", "Python", "Go"):
        path, text, *_ = SOURCES[language]
        (tmp_path / "src" / "pkg" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / "pkg" / path).write_text(text)
    c, r = api.analyze(spark, str(tmp_path / "src"))
    names = {x.name for x in c.collect()}
    assert "hidden" not in names and "demo" in names and "no" not in names
    assert r.filter("kind = 'MemberOf'").count() == 3
    root = f"file://{tmp_path}/out"
    assert sinks.write_bundle(c, r, root, "abc") == c.count()
    c2, r2 = bundle.read_bundle(spark, root)
    key = lambda df: sorted((x.id, x.kind, x.language, x.name, x.file, x.start_line, x.end_line, x.signature, x.is_public) for x in df.filter("kind <> 'Package'").collect())
    assert key(c2) == key(c)
    edges = lambda df: sorted({(x.src, x.kind, x.target, x.resolved_by, x.confidence) for x in df.filter("src not like 'packages/%'").collect()})
    assert edges(r2) == edges(r)
    files = bundle.bundle_files(spark, root)
    found = validate.union([validate.required_index(files), validate.link_issues(files), validate.duplicate_ids(files), validate.frontmatter(bundle.frontmatter_rows(files.filter("path not like '%index.md'")))])
    assert [x for x in found.collect() if x.severity == "error" and "packages" not in x.message] == []
    sinks.write_graphml(c, r, f"{root}/g.graphml")
    tree = ET.parse(tmp_path / "out/g.graphml").getroot()
    assert len([e for e in tree.iter() if e.tag.endswith("node")]) == c.count()
    for write, name in ((sinks.write_html, "html"), (sinks.write_vault, "vault"), (sinks.write_dita, "dita")):
        assert write(c, r, f"{root}-{name}") == c.count()
    sinks.write_markdown(c, r, f"{root}/all.md")
    topics, skipped = project.import_dita(spark, f"{root}-dita")
    assert topics.count() == c.count() and skipped.count() == 0
    assert sinks.merge_section(sinks.merge_section("x", "a"), "b").count(sinks.BEGIN) == 1


def test_reader_is_lenient_and_search_more_so(spark, tmp_path):
    pages = {
        "index.md": "---\nbundle_version: 1\n---\n",
        "functions/a.md": '---\r\ntype: "Rust Function"\r\nrelationships:\r\n  calls:\r\n    - functions/b\r\n    - target: functions/gone\r\n      confidence: semantic\r\n  odd: [x]\r\n---\r\n# Signature\r\n\r\n`fn a()`\r\n',
        "functions/b.md": '---\ntype: "Rust Function"\ntitle: Bee\nvisibility: private\nresource: src/b.rs#L3-L9\n---\n[a](a.md) [a](a.md) [no](none.md) [out](../../x.md)\n',
        "functions/bad.md": "---\ntype: [\n---\n",
        "things/t.md": "---\ntype: Other Thing\ntimestamp: never\ntags: [1]\n---\n",
        "plain.md": "no block",
    }
    for p, t in pages.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t.encode())
    root = f"file://{tmp_path}"
    c, r = bundle.read_bundle(spark, root)
    by = {x.id: x for x in c.collect()}
    assert set(by) == {"functions/a", "functions/b"}
    assert by["functions/a"].signature == "fn a()" and by["functions/a"].file == "" and by["functions/b"].start_line == 3 and not by["functions/b"].is_public
    assert [(x.target, x.target_display, x.resolved_by, x.confidence) for x in r.orderBy("pos").collect()] == [("functions/b", "Bee", "tree-sitter", "exact"), ("functions/gone", "functions/gone", "tree-sitter", "semantic")]
    assert {x.id for x in bundle.search_entries(spark, root).collect()} == {"functions/a", "functions/b", "things/t"}
    files = bundle.bundle_files(spark, root)
    kinds = lambda df: sorted((x.kind, x.file) for x in df.collect())
    assert kinds(validate.link_issues(files)) == [("DanglingLink", "functions/b.md"), ("LinkEscapes", "functions/b.md"), ("RepeatedLink", "functions/b.md")]
    fm = bundle.frontmatter_rows(files)
    assert kinds(validate.frontmatter(fm.filter("path <> 'index.md'"))) == [("BadTags", "things/t.md"), ("BadTimestamp", "things/t.md"), ("BadYaml", "functions/bad.md"), ("NoFrontmatter", "plain.md")]
    assert kinds(validate.index_frontmatter(fm.filter("path = 'index.md'"))) == [("IndexVersion", "index.md")]
    lost = validate.reachability(files)
    assert len(kinds(lost)) == 5 and not validate.fails(lost) and validate.fails(lost, ci=True)
    assert kinds(validate.relation_targets(c, r)) == [("MissingTarget", "functions/a")]


def test_search_order(spark):
    rows = [("functions/a", "parseConfig", "Rust Function", "reads"), ("functions/b", "other", "Rust Function", "parse parse config"), ("functions/c", "HTTPServer", "Go Struct", "")]
    d = spark.createDataFrame(rows, "id string, title string, type string, body string").withColumn("title", split_identifier_words(F.col("title")))
    assert [x.id for x in search.bm25(d, "config parse").collect()] == ["functions/a", "functions/b"]
    assert d.filter("id = 'functions/c'").first().title == "HTTP Server" and search.bm25(d, "  ").count() == 0
    assert [x.id for x in search.bm25(d, "server", 5).collect()] == ["functions/c"]


def test_patterns(spark):
    rows = [("classes/m/XBuilder", "Class", "XBuilder", True), ("functions/m/XBuilder/build", "Method", "build", True), ("classes/m/V", "Class", "V", True), ("functions/m/V/visit_a", "Method", "visit_a", True), ("classes/m/W", "Class", "W", True), ("functions/m/W/visit_a", "Method", "visit_a", True), ("functions/m/W/visitB", "Method", "visitB", True), ("functions/m/make_it", "Function", "make_it", True), ("classes/m/UserController", "Class", "UserController", True), ("functions/m/UserController/get", "Method", "get", True), ("functions/m/UserController/hid", "Method", "hid", False), ("enums/m/XModel", "Enum", "XModel", True), ("functions/m/on_click", "Function", "on_click", True)]
    c = spark.createDataFrame([(*r, 1) for r in rows], "id string, kind string, name string, is_public boolean, start_line int")
    assert [(x.pattern, x.id) for x in patterns.detect_patterns(c).collect()] == [("Builder", "classes/m/XBuilder"), ("Factory", "functions/m/make_it"), ("Visitor", "classes/m/W")]
    assert [(x.feature, x.id) for x in patterns.detect_features(c).collect()] == [("RestEndpoint", "functions/m/UserController/get"), ("EventFlow", "functions/m/on_click")]


def test_ids_and_spans(spark):
    rows = [("functions/a/index", "f", 1), ("functions/A/Index", "f", 2), ("functions/x", "b", 9), ("functions/X", "a", 1)]
    c = spark.createDataFrame(rows, "id string, file string, start_line int")
    assert sorted((x.raw_id, x.id) for x in assemble.disambiguate_ids(c).collect()) == [("functions/A/Index", "functions/A/Index-3"), ("functions/X", "functions/X"), ("functions/a/index", "functions/a/index-2"), ("functions/x", "functions/x-2")]
    spans = spark.createDataFrame([("f", "outer", 0, 100), ("f", "inner", 10, 20), ("g", "other", 0, 5)], "file string, id string, start int, end int")
    points = spark.createDataFrame([("f", 15, "p"), ("f", 20, "q"), ("f", 100, "r"), ("g", 0, "s"), ("h", 1, "t")], "file string, at int, what string")
    for find in (assemble.smallest_containing, assemble.smallest_containing_any):
        assert sorted((x.what, x.id) for x in find(points, spans).collect()) == [("p", "inner"), ("q", "outer"), ("s", "other")]
    paths = spark.createDataFrame([("a/../b/./c",), ("../x",), ("a/b",)], "p string")
    assert [x.n for x in paths.select(normalize_path(F.col("p")).alias("n")).collect()] == ["b/c", None, "a/b"]


def test_cache_reuses_unchanged_files(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, hash long")
    cache, schema = incremental.ExtractionCache(spark), "path string, hash long, value string"
    make = lambda df: df.withColumn("value", F.concat(F.lit("v"), "path"))
    assert incremental.refresh(files, cache, make, schema)[1] == {"reused": 0, "parsed": 2}
    assert incremental.refresh(files, cache, make, schema)[1] == {"reused": 2, "parsed": 0}
    changed = spark.createDataFrame([("a", 1), ("b", 3)], "path string, hash long")
    rows, counts = incremental.refresh(changed, cache, make, schema)
    assert counts == {"reused": 1, "parsed": 1} and rows.count() == 2


def test_bundles_are_read_again_only_after_a_change(spark, tmp_path):
    (tmp_path / "functions").mkdir()
    (tmp_path / "functions/_a.md").write_text('---\ntype: "Rust Function"\n---\n')
    held, n = incremental.BundleCache(spark, bundle.read_bundle), []
    for text in ("", "more"):
        first = held.get(f"file://{tmp_path}")
        assert held.get(f"file://{tmp_path}") is first
        n.append(first[0].count())
        (tmp_path / "functions/b.md").write_text('---\ntype: "Rust Function"\n---\n' + text)
    assert n == [1, 2]


def test_watch_fires_once_a_burst(spark, tmp_path):
    folder = f"{tmp_path}/changes"
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01"), ("c", "2024-01-01 00:01:00"), ("d", "2024-01-01 00:30:00")]
    spark.createDataFrame(rows, "path string, ts string").select("path", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(folder)
    seen = []
    stream = spark.readStream.schema("path string, ts timestamp").parquet(folder)
    incremental.watch(stream, "ts", "5 seconds", lambda df, _: seen.extend(sorted(r.paths) for r in df.collect()), f"{tmp_path}/ck", available_now=True).awaitTermination(120)
    assert sorted(seen) == [["a", "b"], ["c"]]


def test_lossy_text_and_manifests():
    assert project.decode_lossy("ığ é".encode() + b"\xfd\xfe x") == "ığ éış x"
    assert project.manifest_name("go", "// c\nmodule a/b\n") == "a/b" and project.manifest_name("npm", "{") is None
    assert project.manifest_name("python", '[tool.poetry]\nname = "p"\n') == "p"
