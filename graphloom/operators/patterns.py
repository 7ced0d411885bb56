"""Design patterns and features, told from names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import parent
from graphloom.schema import KIND_ORDER, TYPE_KINDS, ascii_lower, ordinal

SINGLETON_NAMES = ("instance", "get_instance", "getinstance", "shared", "singleton")


def _path(col: str = "id"):
    """The id after its kind directory."""
    return F.expr(f"substring({col}, instr({col}, '/') + 1)")


def methods_by_owner(c: DataFrame) -> DataFrame:
    """(owner, method, low, place, is_public): methods with the path of the type that owns them."""
    methods = c.filter("kind = 'Method'")
    return methods.select(parent(_path()).alias("owner"), F.col("name").alias("method"), ascii_lower("name").alias("low"), "id", "start_line", "is_public").filter("owner is not null")


def types(c: DataFrame) -> DataFrame:
    return c.filter(F.col("kind").isin(*TYPE_KINDS)).select("id", "name", "kind", _path().alias("owner"))


def _findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def detect_patterns(c: DataFrame) -> DataFrame:
    """(pattern, id, evidence), ordered by kind of pattern and id."""
    t, m = types(c), methods_by_owner(c)
    owned = t.join(m.select("owner", "method", "low", "start_line", F.col("id").alias("method_id")), "owner")
    builders = owned.filter(F.endswith(ascii_lower("name"), F.lit("builder")) & (F.col("low") == "build"))
    builders = builders.groupBy("id").agg(F.min_by("method", F.struct("start_line", "method_id")).alias("evidence")).withColumn("pattern", F.lit("Builder"))
    single = owned.filter(F.col("low").isin(*SINGLETON_NAMES))
    single = single.groupBy("id").agg(F.min_by("method", F.struct("start_line", "method_id")).alias("evidence")).withColumn("pattern", F.lit("Singleton"))
    low = ascii_lower("name")
    made = c.filter(F.col("kind").isin("Function", "Method"))
    prefixed = F.startswith(low, F.lit("create_")) | F.startswith(low, F.lit("make_"))
    by_name = made.filter(prefixed).select("id", F.col("name").alias("evidence"))
    factory_type = t.filter(F.endswith(ascii_lower("name"), F.lit("factory"))).select("owner", F.col("name").alias("evidence")).dropDuplicates(["owner"])
    by_owner = made.filter((F.col("kind") == "Method") & ~prefixed).select("id", parent(_path()).alias("owner")).join(factory_type, "owner").select("id", "evidence")
    factories = by_name.unionByName(by_owner).withColumn("pattern", F.lit("Factory"))
    visits = owned.filter(F.startswith("low", F.lit("visit"))).groupBy("id").agg(F.count("*").alias("n")).filter("n >= 2")
    visitors = visits.select("id", F.concat(F.col("n").cast("string"), F.lit(" visit methods")).alias("evidence")).withColumn("pattern", F.lit("Visitor"))
    order = {"Builder": 0, "Singleton": 1, "Factory": 2, "Visitor": 3}
    return _findings([builders, single, factories, visitors]).select("pattern", "id", "evidence").orderBy(ordinal("pattern", order), "id")


def detect_features(c: DataFrame) -> DataFrame:
    """(feature, id, evidence): endpoints of controllers, models by suffix, event flow by name."""
    t, m = types(c), methods_by_owner(c)
    control = t.filter(F.endswith("name", F.lit("Controller"))).select("owner", F.col("name").alias("evidence"))
    endpoints = m.filter("is_public").join(control, "owner").select("id", "evidence").distinct().withColumn("feature", F.lit("RestEndpoint"))
    suffix = F.when(F.endswith("name", F.lit("Model")), "Model").when(F.endswith("name", F.lit("Entity")), "Entity").when(F.endswith("name", F.lit("Record")), "Record")
    models = t.select("id", suffix.alias("evidence")).filter("evidence is not null").withColumn("feature", F.lit("DatabaseModel"))
    low = ascii_lower("name")
    flow = (
        F.when(F.startswith(low, F.lit("emit_")) | F.startswith(low, F.lit("publish_")), "emits")
        .when(F.startswith(low, F.lit("subscribe_")) | F.startswith(low, F.lit("on_")), "subscribes to")
        .when(F.endswith(low, F.lit("_handler")) | F.endswith(low, F.lit("_event")), "handles")
    )
    events = c.filter(F.col("kind").isin("Function", "Method")).select("id", flow.alias("evidence")).filter("evidence is not null").withColumn("feature", F.lit("EventFlow"))
    order = {"RestEndpoint": 0, "DatabaseModel": 1, "EventFlow": 2}
    return _findings([endpoints, models, events]).select("feature", "id", "evidence").orderBy(ordinal("feature", order), "id")


def with_kind_order(c: DataFrame) -> DataFrame:
    return c.withColumn("kind_ord", ordinal("kind", KIND_ORDER))
