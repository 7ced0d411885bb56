"""Projections of the star-schema tables onto concepts and relationships.

The same SQL text serves Spark and the SQL oracle. Orders call earlier orders (a forest with
some mutual calls), in files that are customers, in packages that are nations; suppliers form
a sparser package graph of their own. Two snapshots differ by values of whole columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_CENTS = "CAST(floor(abs({}) * 100) AS BIGINT)"


def _back(key: str, amount: str, twist: int = 0) -> str:
    """An earlier key, picked by an amount of money."""
    return f"CAST(floor(CAST({key} * (({_CENTS.format(amount)} + {twist}) % 1000) AS DOUBLE) / 1000) AS BIGINT)"


def _calls(twist: str) -> str:
    return f"""
      SELECT concat('functions/o', src) AS src, concat('functions/o', dst) AS dst, version FROM (
        SELECT o_orderkey AS src, {_back('o_orderkey', 'o_totalprice')} {twist} AS dst, o_orderstatus AS version FROM orders WHERE o_orderpriority <> '1-URGENT'
        UNION SELECT {_back('o_orderkey', 'o_totalprice')}, o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P') o
      UNION
      SELECT concat('functions/f', src), concat('functions/f', dst), 'F' FROM (
        SELECT s_suppkey AS src, {_back('s_suppkey', 's_acctbal')} AS dst FROM supplier WHERE s_acctbal >= 0
        UNION SELECT s_suppkey, {_back('s_suppkey', 's_acctbal', 337)} FROM supplier WHERE s_acctbal >= 2000
        UNION SELECT {_back('s_suppkey', 's_acctbal')}, s_suppkey FROM supplier WHERE s_acctbal > 9000) s"""


def _concepts(signature: str) -> str:
    return f"""
      SELECT concat('functions/o', o_orderkey) AS id, 'Function' AS kind, concat('order_', o_orderkey) AS name, concat('c', o_custkey, '.src') AS file,
             {signature} AS signature, CASE WHEN o_totalprice > 250000 THEN o_orderpriority END AS description, o_orderstatus = 'O' AS is_public FROM orders
      UNION ALL SELECT concat('functions/f', s_suppkey), 'Function', s_name, concat('s', s_suppkey, '.src'), s_name, ' ', s_acctbal >= 0 FROM supplier
      UNION ALL SELECT concat('modules/c', c_custkey), 'Module', c_name, concat('c', c_custkey, '.src'), CAST(NULL AS VARCHAR(9)), c_mktsegment, true FROM customer
      UNION ALL SELECT concat('modules/s', s_suppkey), 'Module', s_name, concat('s', s_suppkey, '.src'), CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), true FROM supplier
      UNION ALL SELECT concat('packages/n', n_nationkey), 'Package', n_name, concat('n', n_nationkey, '/manifest'), CAST(NULL AS VARCHAR(9)), n_name, true FROM nation
      UNION ALL SELECT concat('packages/s', s_suppkey), 'Package', s_name, concat('s', s_suppkey, '/manifest'), CAST(NULL AS VARCHAR(9)), s_name, true FROM supplier"""


def _relations(calls: str, version: str) -> str:
    how = f"CASE WHEN version = 'F' THEN 'tree-sitter' ELSE 'analyzer' END AS resolved_by, CASE WHEN version = 'F' THEN 'exact' ELSE 'semantic' END AS confidence, CASE WHEN version <> 'F' THEN '{version}' END AS resolver_version"
    return f"""
      SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY k, target) AS INT) AS pos, kind, target, resolved_by, confidence, resolver_version FROM (
        SELECT src, 1 AS k, 'Calls' AS kind, dst AS target, {how} FROM ({calls}) x
        UNION ALL SELECT dst, 2, 'CalledBy', src, {how} FROM ({calls}) x
        UNION ALL SELECT concat('modules/c', c_custkey), 3, 'MemberOf', concat('packages/n', c_nationkey), 'manifest', 'exact', NULL FROM customer
        UNION ALL SELECT concat('modules/s', s_suppkey), 3, 'MemberOf', concat('packages/s', s_suppkey), 'manifest', 'exact', NULL FROM supplier) r"""


VIEWS: dict[str, str] = {
    "concepts": _concepts("o_orderpriority"),
    "relationships": _relations(_calls(""), "1.88.0"),
    # the later snapshot: other signatures, shifted calls, some concepts gone and others new
    "concepts_after": f"SELECT * FROM ({_concepts('CASE WHEN o_totalprice < 20000 THEN o_orderstatus ELSE o_orderpriority END')}) c WHERE id NOT IN (SELECT concat('functions/o', o_orderkey) FROM orders WHERE o_totalprice > 290000)",
    "relationships_after": _relations(_calls("+ CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 1 ELSE 0 END"), "1.89.0"),
}
VIEWS["concepts_before"] = "SELECT * FROM concepts WHERE id NOT IN (SELECT concat('functions/o', o_orderkey) FROM orders WHERE o_totalprice BETWEEN 280000 AND 290000)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name; its tables are read from ``sf_dir``."""
    sql = VIEWS[name]
    while any(re.search(rf"FROM {v}\b", sql) for v in VIEWS):
        for v in VIEWS:
            sql = re.sub(rf"FROM {v}\b", lambda _, v=v: f"FROM ({VIEWS[v]}) {v}_", sql)
    for t in _TABLES:
        sql = re.sub(rf"FROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """Oracle text: the named views, in order, before a query that may be recursive."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + ",\n" + sql.strip() if names else sql
