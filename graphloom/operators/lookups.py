"""Lookups, projections and filters over concepts C and relationships R.

Targets that name no concept are dropped by the joins; order within a concept's relationship
list is ``pos``. ``Calls`` and ``CalledBy`` are separate rows and never derived from each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schema import is_structural


def get(c: DataFrame, ids: list[str]) -> DataFrame:
    return c.filter(F.col("id").isin(*ids))


def related(c: DataFrame, r: DataFrame, kind: str) -> DataFrame:
    """(src, pos, id): existing targets of one relation kind, duplicates kept."""
    edges = r.filter(F.col("kind") == kind).select("src", "pos", F.col("target").alias("id"))
    return edges.join(c.select("id"), "id").select("src", "pos", "id")


def callees(c: DataFrame, r: DataFrame) -> DataFrame:
    return related(c, r, "Calls")


def callers(c: DataFrame, r: DataFrame) -> DataFrame:
    return related(c, r, "CalledBy")


def _modules(c: DataFrame) -> DataFrame:
    """Module of each file; of several the last id wins."""
    return c.filter("kind = 'Module'").groupBy("file").agg(F.max("id").alias("module"))


def owning_module(c: DataFrame) -> DataFrame:
    """(id, module) of concepts whose file declares a module."""
    return c.select("id", "file").join(_modules(c), "file").select("id", "module")


def owning_package(c: DataFrame, r: DataFrame) -> DataFrame:
    """(id, package): the first own membership, else the module's first."""
    first = related(c, r, "MemberOf").groupBy("src").agg(F.min_by("id", "pos").alias("package"))
    own = first.select(F.col("src").alias("id"), F.col("package").alias("own"))
    via = owning_module(c).join(first.withColumnRenamed("src", "module"), "module").select("id", F.col("package").alias("via"))
    both = c.select("id").join(own, "id", "left").join(via, "id", "left")
    return both.select("id", F.coalesce("own", "via").alias("package")).filter("package is not null")


def members_of(c: DataFrame) -> DataFrame:
    """(module, id): other concepts in the file of each module."""
    modules = c.filter("kind = 'Module'").select(F.col("id").alias("module"), "file")
    return modules.join(c.select("id", "file"), "file").filter("id <> module").select("module", "id")


def contains_members(c: DataFrame, r: DataFrame) -> DataFrame:
    """(owner, id): members of modules by file, of packages by membership."""
    packages = c.filter("kind = 'Package'").select(F.col("id").alias("owner"))
    by_edge = r.filter("kind = 'MemberOf'").select(F.col("target").alias("owner"), F.col("src").alias("id")).distinct()
    by_edge = by_edge.join(packages, "owner", "left_semi").join(c.select("id"), "id", "left_semi").select("owner", "id")
    return members_of(c).withColumnRenamed("module", "owner").unionByName(by_edge)


def of_kind(c: DataFrame, kind: str) -> DataFrame:
    return c.filter(F.col("kind") == kind).orderBy("id")


def public_api(c: DataFrame) -> DataFrame:
    return c.filter(F.col("is_public") & ~is_structural()).orderBy("id")


def isolated_concepts(c: DataFrame, r: DataFrame) -> DataFrame:
    """Non-structural concepts without any call entry; a dangling entry still disqualifies."""
    called = r.filter(F.col("kind").isin("Calls", "CalledBy")).select(F.col("src").alias("id"))
    return c.filter(~is_structural()).join(called, "id", "left_anti").orderBy("id")


def call_edges(c: DataFrame, r: DataFrame, kinds: tuple[str, ...] = ("Calls",)) -> DataFrame:
    """(src, dst) between existing concepts."""
    ids = c.select("id")
    edges = r.filter(F.col("kind").isin(*kinds)).select("src", F.col("target").alias("dst"))
    return edges.join(ids.withColumnRenamed("id", "dst"), "dst").join(ids.withColumnRenamed("id", "src"), "src").select("src", "dst")


def module_dependencies(c: DataFrame, r: DataFrame) -> DataFrame:
    """Distinct (src, dst) modules with a call from one into the other."""
    module = owning_module(c)
    edges = call_edges(c, r).distinct()
    edges = edges.join(module.select(F.col("id").alias("src"), F.col("module").alias("a")), "src")
    edges = edges.join(module.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst")
    return edges.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
