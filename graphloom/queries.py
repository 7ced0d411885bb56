"""Registered queries of the graph, search, diff and validation operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import arch, diff, lookups, paths, stats
from graphloom.plans.views import view, with_views
from graphloom.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_GRAPH = ("concepts", "relationships")


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "concepts"), view(spark, sf_dir, "relationships")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Both snapshots, written once: every comparison reads them several times."""
    named = lambda n: materialize(view(spark, sf_dir, n), n)
    return (named("concepts_before"), named("relationships")), (named("concepts_after"), named("relationships_after"))


_JOINED = """q AS (SELECT r.src, r.pos, r.kind, r.target AS id FROM relationships r JOIN concepts c ON r.target = c.id),
 callc AS (SELECT DISTINCT r.src, r.target AS dst FROM relationships r JOIN concepts a ON r.src = a.id JOIN concepts b ON r.target = b.id WHERE r.kind = 'Calls')"""


@query(f"{_JOINED} SELECT src, pos, id FROM q WHERE kind = 'CalledBy'", _GRAPH)
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.callers(*graph(spark, sf_dir))


@query(f"{_JOINED} SELECT src, pos, id FROM q WHERE kind = 'Calls'", _GRAPH)
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.callees(*graph(spark, sf_dir))


@query("m AS (SELECT id AS module, file FROM concepts WHERE kind = 'Module') SELECT m.module, c.id FROM m JOIN concepts c ON m.file = c.file WHERE c.id <> m.module", ("concepts",))
def members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.members_of(view(spark, sf_dir, "concepts"))


_OWNER = f"""{_JOINED},
 first AS (SELECT src, arg_min(id, pos) AS package FROM q WHERE kind = 'MemberOf' GROUP BY src),
 module AS (SELECT file, max(id) AS module FROM concepts WHERE kind = 'Module' GROUP BY file),
 owner AS (SELECT c.id, m.module, coalesce(o.package, v.package) AS package FROM concepts c LEFT JOIN first o ON c.id = o.src
           LEFT JOIN module m ON m.file = c.file LEFT JOIN first v ON m.module = v.src)"""


@query(f"{_OWNER} SELECT id, package FROM owner WHERE package IS NOT NULL", _GRAPH)
def owning_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.owning_package(*graph(spark, sf_dir))


@query(
    """m AS (SELECT id AS owner, file FROM concepts WHERE kind = 'Module')
    SELECT m.owner, c.id FROM m JOIN concepts c ON m.file = c.file WHERE c.id <> m.owner
    UNION ALL SELECT DISTINCT p.id, r.src FROM relationships r JOIN concepts p ON r.target = p.id AND p.kind = 'Package' JOIN concepts s ON s.id = r.src WHERE r.kind = 'MemberOf'""",
    _GRAPH,
)
def contains_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.contains_members(*graph(spark, sf_dir))


@query("x AS (SELECT 1) SELECT id, name FROM concepts WHERE kind = 'Package'", ("concepts",))
def of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.of_kind(view(spark, sf_dir, "concepts"), "Package").select("id", "name")


@query("x AS (SELECT 1) SELECT id FROM concepts WHERE is_public AND kind NOT IN ('Module', 'Package', 'Document')", ("concepts",))
def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.public_api(view(spark, sf_dir, "concepts")).select("id")


@query(
    """x AS (SELECT 1) SELECT id FROM concepts c WHERE kind NOT IN ('Module', 'Package', 'Document')
    AND NOT EXISTS (SELECT 1 FROM relationships r WHERE r.src = c.id AND r.kind IN ('Calls', 'CalledBy'))""",
    _GRAPH,
)
def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.isolated_concepts(*graph(spark, sf_dir)).select("id")


_MODULE = f"{_OWNER}, dep AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM callc JOIN owner a ON a.id = callc.src JOIN owner b ON b.id = callc.dst WHERE a.module <> b.module)"
_PACKAGE = f"""{_MODULE}, pedge AS (SELECT a.package AS src, b.package AS dst FROM dep JOIN owner a ON a.id = dep.src JOIN owner b ON b.id = dep.dst
   JOIN concepts pa ON pa.id = a.package AND pa.kind = 'Package' JOIN concepts pb ON pb.id = b.package AND pb.kind = 'Package' WHERE a.package <> b.package),
 pdep AS (SELECT DISTINCT src, dst FROM pedge), pk AS (SELECT id FROM concepts WHERE kind = 'Package')"""


@query(f"{_MODULE} SELECT src, dst FROM dep", _GRAPH)
def module_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.module_dependencies(*graph(spark, sf_dir))


@query(f"{_PACKAGE} SELECT src, dst FROM pdep", _GRAPH)
def package_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.package_dependencies(*graph(spark, sf_dir))


@query(f"{_PACKAGE} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM pedge GROUP BY 1, 2", _GRAPH)
def weighted_package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.weighted_package_edges(*graph(spark, sf_dir))


_REACH = f"{_PACKAGE}, reach AS (SELECT src, dst FROM pdep UNION SELECT r.src, d.dst FROM reach r JOIN pdep d ON r.dst = d.src)"


@query(
    f"""{_REACH}, scc AS (SELECT p.id, least(p.id, coalesce((SELECT min(r.dst) FROM reach r JOIN reach b ON b.src = r.dst AND b.dst = r.src WHERE r.src = p.id), p.id)) AS comp FROM pk p),
    ce AS (SELECT DISTINCT a.comp AS src, b.comp AS dst FROM pdep d JOIN scc a ON a.id = d.src JOIN scc b ON b.id = d.dst WHERE a.comp <> b.comp),
    walk AS (SELECT DISTINCT comp AS src, comp AS at, 0 AS n FROM scc UNION SELECT w.src, ce.dst, w.n + 1 FROM walk w JOIN ce ON ce.src = w.at)
    SELECT s.id, CAST(max(w.n) AS INT) AS layer FROM scc s JOIN walk w ON w.src = s.comp GROUP BY s.id""",
    _GRAPH,
)
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.layers(*graph(spark, sf_dir))


@query(
    f"""{_PACKAGE}, sym AS (SELECT src, dst FROM pdep UNION SELECT dst, src FROM pdep),
    near AS (SELECT id AS src, id AS dst FROM pk UNION SELECT n.src, s.dst FROM near n JOIN sym s ON n.dst = s.src)
    SELECT min(dst) AS domain, src AS id FROM near GROUP BY src""",
    _GRAPH,
)
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.domains(*graph(spark, sf_dir))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.communities(*graph(spark, sf_dir))


@query("x AS (SELECT 1) SELECT kind, count(*) AS n FROM concepts GROUP BY kind", ("concepts",))
def graph_stats_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_kind(view(spark, sf_dir, "concepts"))


@query("x AS (SELECT 1) SELECT kind, count(*) AS n FROM relationships GROUP BY kind", _GRAPH)
def graph_stats_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_relation(view(spark, sf_dir, "relationships"))


@query(
    """t AS (SELECT count(*) AS total, count(*) FILTER (trim(coalesce(description, '')) <> '') AS described,
      count(*) FILTER (kind NOT IN ('Module', 'Package', 'Document')) AS eligible,
      count(*) FILTER (kind NOT IN ('Module', 'Package', 'Document') AND signature IS NOT NULL) AS with_signature,
      count(*) FILTER (kind NOT IN ('Module', 'Package', 'Document') AND is_public) AS public FROM concepts)
    SELECT total, described, described * 100 // total AS described_pct, with_signature, with_signature * 100 // eligible AS signature_pct, public, public * 100 // eligible AS public_pct FROM t""",
    ("concepts",),
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coverage(view(spark, sf_dir, "concepts"))


# component of a node: the least node that meets it through edges in both directions
_COMP = f"""{_JOINED}, sym AS (SELECT src, dst FROM callc UNION SELECT dst, src FROM callc),
 lab(node, comp) USING KEY (node) AS (
   SELECT src, min(least(src, dst)) FROM sym GROUP BY src
   UNION SELECT s.src, min(l.comp) FROM lab l JOIN sym s ON s.dst = l.node JOIN recurring.lab own ON own.node = s.src WHERE l.comp < own.comp GROUP BY s.src)"""


@query(f"{_COMP} SELECT comp AS component, node AS id FROM lab", _GRAPH)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.components(*graph(spark, sf_dir))


_CLOSURE = f"{_JOINED}, reach AS (SELECT src, dst FROM callc UNION SELECT r.src, d.dst FROM reach r JOIN callc d ON r.dst = d.src)"


@query(f"{_CLOSURE} SELECT min(a.dst) AS cycle, a.src AS id FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src", _GRAPH)
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cycles(*graph(spark, sf_dir))


@query(
    f"""{_COMP} SELECT (SELECT count(*) FROM concepts) AS concepts, (SELECT count(*) FROM relationships) AS relations, (SELECT count(DISTINCT comp) FROM lab) AS components,
    (SELECT count(*) FROM concepts c WHERE kind NOT IN ('Module', 'Package', 'Document') AND NOT EXISTS (SELECT 1 FROM relationships r WHERE r.src = c.id AND r.kind IN ('Calls', 'CalledBy'))) AS isolated""",
    _GRAPH,
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = (materialize(x, "graph") for x in graph(spark, sf_dir))
    return stats.graph_stats(c, r)


_BLAST = f"""{_JOINED}, up AS (SELECT src, id FROM q WHERE kind = 'CalledBy'),
 reach AS (SELECT src AS start, id, 1 AS depth FROM up UNION SELECT r.start, u.id, r.depth + 1 FROM reach r JOIN up u ON u.src = r.id WHERE r.depth < {{}})"""


@query(f"{_CLOSURE} SELECT dst AS start, src AS id FROM reach WHERE src <> dst", _GRAPH)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive callers of every concept."""
    c, r = (materialize(x, "graph") for x in graph(spark, sf_dir))
    return paths.transitive_callers(c, r, c.select(F.col("id").alias("start"))).select("start", "id")


@query(f"{_BLAST.format(2)} SELECT start, id, CAST(min(depth) AS INT) AS depth FROM reach WHERE id <> start GROUP BY start, id", _GRAPH)
def blast_radius_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = (materialize(x, "graph") for x in graph(spark, sf_dir))
    return paths.transitive_callers(c, r, c.select(F.col("id").alias("start")), 2)


_FROM = "(SELECT arg_max(o_orderkey, o_totalprice) FROM orders WHERE o_orderpriority <> '1-URGENT')"


@query(
    f"""{_JOINED}, e AS (SELECT src, id AS dst, min(pos) AS pos FROM q WHERE kind = 'Calls' GROUP BY 1, 2),
    walk AS (SELECT concat('functions/o', {_FROM}) AS id, [concat('functions/o', {_FROM})] AS path, CAST([] AS INT[]) AS places
             UNION SELECT e.dst, list_append(w.path, e.dst), list_append(w.places, e.pos) FROM walk w JOIN e ON e.src = w.id WHERE NOT list_contains(w.path, e.dst)),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(path), places) AS k FROM walk)
    SELECT id, CAST(len(path) - 1 AS INT) AS hops, array_to_string(path, ' > ') AS path FROM best WHERE k = 1""",
    _GRAPH,
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest call paths from the dearest order to everything it reaches."""
    c, r = (materialize(x, "graph") for x in graph(spark, sf_dir))
    start = table(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'").agg(F.max_by("o_orderkey", "o_totalprice")).first()[0]
    out = paths.shortest_call_paths(c, r, f"functions/o{start}")
    return out.withColumn("path", F.array_join("path", " > "))


@query(
    """f AS (SELECT src, target, arg_min(kind, pos) AS kind, arg_min(resolved_by, pos) AS resolved_by FROM relationships GROUP BY 1, 2)
    SELECT src, target, kind, resolved_by FROM f""",
    _GRAPH,
)
def explain_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first direct relation of every related pair."""
    r = view(spark, sf_dir, "relationships")
    return r.groupBy("src", "target").agg(F.min_by("kind", "pos").alias("kind"), F.min_by("resolved_by", "pos").alias("resolved_by"))


_SNAP = ("concepts", "concepts_before", "relationships", "concepts_after", "relationships_after")


@query("x AS (SELECT 1) SELECT id FROM concepts_after WHERE id NOT IN (SELECT id FROM concepts_before)", _SNAP)
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.added(view(spark, sf_dir, "concepts_before"), view(spark, sf_dir, "concepts_after")).select("id")


@query("x AS (SELECT 1) SELECT id FROM concepts_before WHERE id NOT IN (SELECT id FROM concepts_after)", _SNAP)
def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.removed(view(spark, sf_dir, "concepts_before"), view(spark, sf_dir, "concepts_after")).select("id")


_PAIRS = """both_ AS (SELECT id FROM concepts_before INTERSECT SELECT id FROM concepts_after),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, kind, target ORDER BY pos) AS k FROM relationships) WHERE k = 1 AND src IN (SELECT id FROM both_)),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, kind, target ORDER BY pos) AS k FROM relationships_after) WHERE k = 1 AND src IN (SELECT id FROM both_)),
 pairs AS (SELECT * FROM (SELECT coalesce(b.src, a.src) AS src, coalesce(b.kind, a.kind) AS kind, coalesce(b.target, a.target) AS target,
   CASE WHEN b.src IS NULL OR a.src IS NULL THEN 'Source'
        WHEN b.resolved_by IS NOT DISTINCT FROM a.resolved_by AND b.resolver_version IS NOT DISTINCT FROM a.resolver_version
          THEN CASE WHEN b.confidence IS NOT DISTINCT FROM a.confidence THEN 'Unchanged' ELSE 'Confidence' END
        WHEN b.confidence IS NOT DISTINCT FROM a.confidence THEN 'Resolver' ELSE 'Provenance' END AS change
   FROM b FULL OUTER JOIN a ON b.src = a.src AND b.kind = a.kind AND b.target = a.target) WHERE change <> 'Unchanged'),
 sig AS (SELECT x.id, x.signature IS DISTINCT FROM y.signature AS signature_changed FROM concepts_before x JOIN concepts_after y ON x.id = y.id),
 listed AS (SELECT src, string_agg(concat(kind, '|', target, '|', change), ';' ORDER BY CASE kind WHEN 'Calls' THEN 1 WHEN 'CalledBy' THEN 2 ELSE 6 END, target) AS changes FROM pairs GROUP BY src),
 chg AS (SELECT s.id, s.signature_changed, coalesce(l.changes, '') AS changes FROM sig s LEFT JOIN listed l ON l.src = s.id WHERE s.signature_changed OR l.src IS NOT NULL)"""


@query(f"{_PAIRS} SELECT src, kind, target, change FROM pairs", _SNAP)
def diff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.relationship_changes(*snapshots(spark, sf_dir))


@query(f"{_PAIRS} SELECT id, signature_changed, changes FROM chg", _SNAP)
def diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed(*snapshots(spark, sf_dir))


@query(
    f"""{_PAIRS}, w AS (
      SELECT greatest(count(r.src), 1) AS n FROM concepts_after c LEFT JOIN relationships_after r ON r.src = c.id WHERE c.id NOT IN (SELECT id FROM concepts_before) GROUP BY c.id
      UNION ALL SELECT greatest(count(r.src), 1) FROM concepts_before c LEFT JOIN relationships r ON r.src = c.id WHERE c.id NOT IN (SELECT id FROM concepts_after) GROUP BY c.id)
    SELECT CAST((SELECT coalesce(sum(n), 0) FROM w) + (SELECT count(*) FROM sig WHERE signature_changed) + (SELECT count(*) FROM pairs WHERE change = 'Source') AS BIGINT) AS source,
      (SELECT count(*) FROM pairs WHERE change IN ('Resolver', 'Provenance')) AS resolver, (SELECT count(*) FROM pairs WHERE change = 'Confidence') AS confidence""",
    _SNAP,
)
def ci_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.ci_summary(*snapshots(spark, sf_dir))


@query(f"{_PAIRS} SELECT count(*) FILTER (change IN ('Resolver', 'Provenance')) / nullif(count(*), 0) AS rate FROM pairs", _SNAP)
def resolver_only_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.resolver_only_rate(*snapshots(spark, sf_dir))


_EDGE = "SELECT DISTINCT r.src, r.target AS dst FROM {r} r JOIN {c} a ON r.src = a.id JOIN {c} b ON r.target = b.id WHERE r.kind = '{k}'"


@query(
    f"""{_PAIRS}, s AS (SELECT id, 'removed' AS change FROM concepts_before WHERE id NOT IN (SELECT id FROM concepts_after)),
    t AS (SELECT id, 'added' AS change FROM concepts_after WHERE id NOT IN (SELECT id FROM concepts_before) UNION ALL SELECT id, 'changed' FROM chg),
    eb AS ({_EDGE.format(r='relationships', c='concepts_before', k='CalledBy')}), ea AS ({_EDGE.format(r='relationships_after', c='concepts_after', k='CalledBy')}),
    rb AS (SELECT src, dst FROM eb UNION SELECT x.src, e.dst FROM rb x JOIN eb e ON x.dst = e.src),
    ra AS (SELECT src, dst FROM ea UNION SELECT x.src, e.dst FROM ra x JOIN ea e ON x.dst = e.src)
    SELECT s.id, s.change, (SELECT count(*) FROM rb WHERE rb.src = s.id AND rb.dst <> s.id) AS n_blast, c.is_public AND c.kind NOT IN ('Module', 'Package', 'Document') AS is_public_api,
      EXISTS (SELECT 1 FROM rb WHERE rb.src = s.id AND rb.dst = s.id) AS in_cycle FROM s JOIN concepts_before c ON c.id = s.id
    UNION ALL SELECT t.id, t.change, (SELECT count(*) FROM ra WHERE ra.src = t.id AND ra.dst <> t.id), c.is_public AND c.kind NOT IN ('Module', 'Package', 'Document'),
      EXISTS (SELECT 1 FROM ra WHERE ra.src = t.id AND ra.dst = t.id) FROM t JOIN concepts_after c ON c.id = t.id""",
    _SNAP,
)
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.impact(*snapshots(spark, sf_dir))


# ---- search ----------------------------------------------------------------------------------

from graphloom.operators import assemble, patterns, search, validate  # noqa: E402
from graphloom.streaming import incremental  # noqa: E402

_TIER = """SELECT concat('functions/p', p_partkey) AS id,
  CASE WHEN lower(p_name) = 'ring' THEN 100 WHEN starts_with(lower(p_name), 'ring') THEN 80 WHEN lower(p_brand) = 'ring' THEN 70
       WHEN contains(lower(p_name), 'ring') THEN 60 WHEN contains(lower(p_type), 'ring') THEN 40 WHEN contains(concat('functions/p', p_partkey), 'ring') THEN 20 END AS score FROM part"""


@query(f"SELECT id, score FROM ({_TIER}) WHERE score IS NOT NULL")
def search_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    entries = p.select(F.concat(F.lit("functions/p"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.array("p_brand").alias("tags"))
    return search.tiered(entries, "Ring ")


_BM25 = """WITH d AS (SELECT doc_id AS id, 'title' AS field, 3.0 AS boost, list_filter(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND octet_length(encode(x)) <= 40) AS terms FROM documents
  UNION ALL SELECT doc_id, 'body', 1.0, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND octet_length(encode(x)) <= 40) FROM documents),
 s AS (SELECT field, count(*) AS docs, avg(len(terms)) AS mean FROM d GROUP BY field),
 w AS (SELECT unnest(['the', 'license', 'src3', 'erea']) AS word),
 t AS (SELECT d.id, d.field, d.boost, w.word, len(list_filter(d.terms, lambda x: x = w.word)) AS tf, len(d.terms) AS n FROM d CROSS JOIN w),
 f AS (SELECT field, word, count(*) FILTER (tf > 0) AS df FROM t GROUP BY field, word)
 SELECT t.id, round(sum(t.boost * ln(1 + (s.docs - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.n / s.mean))), 6) AS score
 FROM t JOIN s ON s.field = t.field JOIN f ON f.field = t.field AND f.word = t.word WHERE t.tf > 0 GROUP BY t.id"""


@query(_BM25)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("body"))
    return search.bm25(d, "the license src3 erea").select("id", F.round("score", 6).alias("score"))


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q"""
)
def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector by its cosine to the first one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = [float(x) for x in v.filter("id = 0").first().embedding]
    return search.nearest(v, q).select("id", F.round("score", 6).alias("score"))


@query()
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of described concepts that may belong together."""
    c, r = graph(spark, sf_dir)
    c = c.select("*", F.lit("SQL").alias("language"), F.col("name").alias("qualified_name"), F.array().cast("array<string>").alias("tags"))
    c = c.withColumn("description", F.coalesce("description", F.lit(None)))
    return search.link_candidates(materialize(c, "link-concepts"), r).withColumn("score", F.round("score", 6))


# ---- validation ------------------------------------------------------------------------------


@query("SELECT 'error' AS severity, 'DuplicateId' AS kind, p_name AS file FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part GROUP BY lower(p_name) HAVING count(*) > 1)")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_ids(table(spark, sf_dir, "part").select(F.col("p_name").alias("path"))).drop("message")


@query(
    """SELECT 'error' AS severity, 'DuplicateResource' AS kind, CAST(p_partkey AS VARCHAR) AS file, concat('shared resource ', p_name) AS message FROM part
    WHERE (p_name, p_size < 10) IN (SELECT p_name, p_size < 10 FROM part GROUP BY 1, 2 HAVING count(*) > 1)"""
)
def dup_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return validate.duplicate_resources(p.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("resource"), (F.col("p_size") < 10).alias("is_module")))


@query("x AS (SELECT 1) SELECT 'error' AS severity, 'MissingTarget' AS kind, src AS file, concat(kind, ' ', target) AS message FROM relationships_after WHERE target NOT IN (SELECT id FROM concepts_after)", _SNAP)
def relation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.relation_targets(view(spark, sf_dir, "concepts_after"), view(spark, sf_dir, "relationships_after"))


# the calls of one snapshot with the called-by of the other: asymmetric where they differ
_ASYM = "mixed AS (SELECT src, kind, target FROM relationships WHERE kind = 'Calls' UNION SELECT src, kind, target FROM relationships_after WHERE kind = 'CalledBy')"


@query(
    f"""{_ASYM} SELECT 'warning' AS severity, 'Asymmetric' AS kind, m.target AS file, concat('no reverse of ', m.kind, ' from ', m.src) AS message FROM mixed m
    WHERE m.target IN (SELECT id FROM concepts) AND NOT EXISTS (SELECT 1 FROM mixed b WHERE b.src = m.target AND b.target = m.src AND b.kind <> m.kind)""",
    _SNAP,
)
def relation_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = view(spark, sf_dir, "relationships").filter("kind = 'Calls'")
    mixed = materialize(calls.unionByName(view(spark, sf_dir, "relationships_after").filter("kind = 'CalledBy'")), "mixed")
    return validate.relation_symmetry(view(spark, sf_dir, "concepts"), mixed)


@query(
    """x AS (SELECT src, target, resolved_by, CASE WHEN resolver_version IS NULL AND kind = 'CalledBy' THEN 'likely' ELSE confidence END AS confidence,
       CASE WHEN kind = 'MemberOf' THEN '1' WHEN resolved_by = 'tree-sitter' AND kind = 'Calls' THEN '2' ELSE resolver_version END AS resolver_version FROM relationships)
    SELECT 'error' AS severity, 'BadConfidence' AS kind, src AS file, concat('confidence of ', target) AS message FROM x WHERE confidence NOT IN ('exact', 'semantic')
    UNION ALL SELECT 'warning', 'StrayVersion', src, concat('version without a resolver for ', target) FROM x WHERE resolver_version IS NOT NULL AND resolved_by IN ('tree-sitter', '')""",
    _GRAPH,
)
def relation_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "relationships")
    odd = F.when(F.col("resolver_version").isNull() & (F.col("kind") == "CalledBy"), "likely").otherwise(F.col("confidence"))
    version = F.when(F.col("kind") == "MemberOf", "1").when((F.col("resolved_by") == "tree-sitter") & (F.col("kind") == "Calls"), "2").otherwise(F.col("resolver_version"))
    return validate.relation_provenance(r.withColumn("_c", odd).withColumn("resolver_version", version).withColumn("confidence", F.col("_c")).drop("_c"))


_HREF = "l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) AS at FROM pages)"


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("at", "link"))


@query(f"WITH {_HREF}, known AS (SELECT DISTINCT concat('/', split_part(url, '/', 4)) AS link FROM pages) SELECT page_id, link FROM l WHERE link NOT IN (SELECT link FROM known)")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4))).alias("link"))
    return validate.dangling(_hrefs(spark, sf_dir), known, "link").select("page_id", "link")


@query(f"WITH {_HREF} SELECT page_id, link, count(*) - 1 AS again FROM l GROUP BY page_id, link HAVING count(*) > 1")
def redundant_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated(_hrefs(spark, sf_dir), ["page_id", "link"], ["at"]).groupBy("page_id", "link").agg(F.count("*").alias("again"))


@query(
    f"""{_JOINED}, seen AS (SELECT c.id FROM concepts c WHERE c.description IS NOT NULL UNION SELECT k.dst FROM seen s JOIN callc k ON k.src = s.id)
    SELECT id AS path FROM concepts WHERE id NOT IN (SELECT id FROM seen)""",
    _GRAPH,
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that no chain of calls from a described one reaches."""
    c, r = (materialize(x, "graph") for x in graph(spark, sf_dir))
    files = c.select(F.col("id").alias("path"))
    return validate.orphans(files, lookups.call_edges(c, r), c.filter("description is not null").select(F.col("id").alias("path")))


# ---- names, assembly, increments ---------------------------------------------------------------

_NAMED = """WITH t AS (SELECT p_partkey, concat('functions/', p_type, '/', replace(p_name, ' ', '_')) AS raw FROM part),
 n AS (SELECT *, row_number() OVER (PARTITION BY lower(raw) ORDER BY p_partkey) AS k FROM t)"""


@query(f"{_NAMED} SELECT p_partkey, raw AS raw_id, CASE WHEN k > 1 THEN concat(raw, '-', k) ELSE raw END AS id FROM n")
def disambiguate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("functions/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("id"))
    return assemble.disambiguate_ids(p, ["p_partkey"])


_SYMBOLS = "SELECT concat('functions/p', p_partkey) AS id, concat(p_name, ' ', p_size, ' ', p_brand) AS name FROM part"


def _symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    c = p.select(F.concat(F.lit("functions/p"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_brand").alias("name"), F.lit("Function").alias("kind"))
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("functions/p"), "l_suppkey").alias("caller_id"), F.concat(F.lit("functions/p"), "l_partkey").alias("id"))
    return c, line.join(c.select("id", F.col("name").alias("callee_name")), "id").drop("id")


@query(
    f"""WITH c AS ({_SYMBOLS}), n AS (SELECT name, count(*) AS n, min(id) AS callee FROM c GROUP BY name)
    SELECT concat('functions/p', l_suppkey) AS caller_id, c.name AS callee_name, n.callee FROM lineitem JOIN c ON c.id = concat('functions/p', l_partkey) JOIN n ON n.name = c.name
    WHERE n.n = 1 AND concat('functions/p', l_suppkey) <> n.callee"""
)
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, calls = _symbols(spark, sf_dir)
    return assemble.split_ambiguous_calls(materialize(calls, "calls"), c)[0].select("caller_id", "callee_name", "callee")


_DIRS = "SELECT p_partkey AS pos, concat('packages/p', p_partkey) AS id, CASE WHEN p_size < 5 THEN '' WHEN p_size < 20 THEN p_type ELSE concat(p_type, '/', p_brand) END AS dir FROM part"


@query(
    f"""WITH p AS ({_DIRS}), d AS (SELECT dir, arg_min(id, pos) AS package FROM p GROUP BY dir),
    m AS (SELECT concat('modules/p', p_partkey) AS id, concat(p_type, '/', p_brand, '/', replace(p_name, ' ', '_'), '.src') AS file FROM part)
    SELECT m.id, arg_max(d.package, length(d.dir)) AS package FROM m JOIN d ON d.dir = '' OR m.file = d.dir OR starts_with(m.file, concat(d.dir, '/')) GROUP BY m.id"""
)
def link_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    where = F.when(F.col("p_size") < 5, "").when(F.col("p_size") < 20, F.col("p_type")).otherwise(F.concat_ws("/", "p_type", "p_brand"))
    packages = p.select(F.col("p_partkey").alias("pos"), F.concat(F.lit("packages/p"), "p_partkey").alias("id"), where.alias("dir"))
    modules = p.select(F.concat(F.lit("modules/p"), "p_partkey").alias("id"), F.concat("p_type", F.lit("/"), "p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".src")).alias("file"))
    return assemble.link_modules(materialize(modules, "modules"), packages)


_SPAN = "SELECT o_custkey AS file, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS start, CAST(floor(o_totalprice) AS BIGINT) + 1000 + o_orderkey % 997 * 200 AS stop FROM orders"


@query(
    f"""WITH s AS ({_SPAN}), p AS (SELECT o_custkey AS file, o_orderkey AS point, CAST(floor(o_totalprice) AS BIGINT) + 50 AS at FROM orders)
    SELECT p.file, p.point, arg_min(s.id, (s.stop - s.start, s.id)) AS id FROM p JOIN s ON s.file = p.file AND p.at >= s.start AND p.at < s.stop GROUP BY p.file, p.point"""
)
def smallest_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.floor("o_totalprice").cast("long")
    spans = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + 1000 + F.col("o_orderkey") % 997 * 200).alias("end"))
    points = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("point"), (start + 50).alias("at"))
    return assemble.smallest_containing_any(points, spans).select("file", "point", "id")


@query(
    """SELECT o.o_orderkey AS path, CASE WHEN c.o_orderkey IS NULL THEN 'miss' ELSE 'hit' END AS outcome FROM orders o
    LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 150000) c ON c.o_orderkey = o.o_orderkey AND c.o_orderstatus = o.o_orderstatus"""
)
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    files = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("hash"))
    cache = o.filter("o_totalprice < 150000").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("hash"))
    hit, miss = assemble.split_by_cache(files, cache)
    return hit.select("path", F.lit("hit").alias("outcome")).unionByName(miss.select("path", F.lit("miss").alias("outcome")))


@query(
    """x AS (SELECT coalesce(b.id, a.id) AS path, CASE WHEN a.id IS NULL THEN 'only_left' WHEN b.id IS NULL THEN 'only_right'
      WHEN coalesce(b.signature, '') <> coalesce(a.signature, '') THEN 'differs' END AS outcome FROM concepts_before b FULL OUTER JOIN concepts_after a ON a.id = b.id)
    SELECT path, outcome FROM x WHERE outcome IS NOT NULL""",
    ("concepts", "concepts_before", "concepts_after"),
)
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda n: view(spark, sf_dir, n).select(F.col("id").alias("path"), F.coalesce("signature", F.lit("")).alias("hash"))
    return diff.tree_diff(side("concepts_before"), side("concepts_after"))


@query(
    """WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
    b AS (SELECT *, sum(CASE WHEN was IS NULL OR ts - was > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
    SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS n_events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM b GROUP BY 1, 2"""
)
def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.bursts(table(spark, sf_dir, "events"), "user_id", "ts", 30 * 60, ["event_id"])
    return out.select("user_id", "burst", "n_events", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


# ---- names of parts as types and methods -----------------------------------------------------------

_TYPED = """typed AS (
  SELECT concat('classes/s', s_suppkey) AS id, CASE WHEN s_nationkey < 5 THEN concat('S', s_suppkey, 'Builder') WHEN s_nationkey < 10 THEN concat('S', s_suppkey, 'Factory')
     WHEN s_nationkey < 15 THEN concat('S', s_suppkey, 'Controller') WHEN s_nationkey < 20 THEN concat('S', s_suppkey, 'Model') ELSE concat('S', s_suppkey) END AS name, 'Class' AS kind, true AS is_public, 0 AS start_line FROM supplier
  UNION ALL SELECT concat('functions/s', l_suppkey, '/m', l_orderkey, '_', l_linenumber, '_', n),
     CASE WHEN l_quantity < 5 THEN 'build' WHEN l_quantity < 10 THEN 'get_instance' WHEN l_quantity < 15 THEN concat('visit', l_partkey) WHEN l_quantity < 20 THEN 'create_it' WHEN l_quantity < 25 THEN 'on_change' ELSE 'other' END,
     'Method', l_returnflag = 'N', CAST(l_orderkey AS INT) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem) l)"""
_TYPED_SQL = _TYPED[_TYPED.index("(") + 1 : -1]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _TYPED_SQL
    for t in ("supplier", "lineitem"):
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`")
    return materialize(spark.sql(sql), "typed")


_OWNED = f"""WITH {_TYPED}, t AS (SELECT id, name, split_part(id, '/', 2) AS owner FROM typed WHERE kind = 'Class'),
 m AS (SELECT id, name, lower(name) AS low, split_part(id, '/', 2) AS owner, start_line, is_public FROM typed WHERE kind = 'Method'), o AS (SELECT t.id, t.name, m.name AS method, m.low, m.start_line, m.id AS mid FROM t JOIN m ON m.owner = t.owner)"""


@query(
    f"""{_OWNED} SELECT 'Builder' AS pattern, id, arg_min(method, (start_line, mid)) AS evidence FROM o WHERE lower(name) LIKE '%builder' AND low = 'build' GROUP BY id
    UNION ALL SELECT 'Singleton', id, arg_min(method, (start_line, mid)) FROM o WHERE low = 'get_instance' GROUP BY id
    UNION ALL SELECT 'Factory', id, name FROM m WHERE starts_with(low, 'create_')
    UNION ALL SELECT 'Factory', m.id, t.name FROM m JOIN t ON t.owner = m.owner WHERE NOT starts_with(m.low, 'create_') AND lower(t.name) LIKE '%factory'
    UNION ALL SELECT 'Visitor', id, concat(count(*), ' visit methods') FROM o WHERE starts_with(low, 'visit') GROUP BY id HAVING count(*) >= 2"""
)
def design_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.detect_patterns(_typed(spark, sf_dir))


@query(
    f"""{_OWNED} SELECT 'RestEndpoint' AS feature, m.id, t.name AS evidence FROM m JOIN t ON t.owner = m.owner WHERE m.is_public AND t.name LIKE '%Controller'
    UNION ALL SELECT 'DatabaseModel', id, 'Model' FROM t WHERE name LIKE '%Model'
    UNION ALL SELECT 'EventFlow', id, 'subscribes to' FROM m WHERE starts_with(low, 'on_')"""
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.detect_features(_typed(spark, sf_dir))
