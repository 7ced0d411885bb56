"""Aggregate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import connected_components, strong_components
from graphloom.operators.lookups import call_edges, isolated_concepts
from graphloom.schema import KIND_ORDER, is_structural, ordinal


def count_by_kind(c: DataFrame) -> DataFrame:
    return c.groupBy("kind").count().orderBy(ordinal("kind", KIND_ORDER)).withColumnRenamed("count", "n")


def count_by_relation(r: DataFrame) -> DataFrame:
    return r.groupBy("kind").agg(F.count("*").alias("n"))


def components(c: DataFrame, r: DataFrame) -> DataFrame:
    """(component, id) over calls in either direction; concepts without an edge are left out."""
    edges = call_edges(c, r, ("Calls", "CalledBy"))
    return connected_components(edges).select("component", F.col("node").alias("id"))


def cycles(c: DataFrame, r: DataFrame) -> DataFrame:
    """(cycle, id): strong components of several concepts, and self-calls."""
    edges = call_edges(c, r)
    scc = strong_components(edges)
    size = scc.groupBy("component").count()
    selfish = edges.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop")).distinct()
    kept = scc.join(size, "component").join(selfish, "node", "left").filter("count > 1 or loop")
    return kept.select(F.col("component").alias("cycle"), F.col("node").alias("id"))


def percent(part: Column, total: Column) -> Column:
    """Whole percents, rounded down; 0 of nothing."""
    return F.coalesce(F.floor(part * 100 / F.nullif(total, F.lit(0))), F.lit(0)).cast("long")


def coverage(c: DataFrame) -> DataFrame:
    """Shares of concepts with a description, a signature and public visibility."""
    described = F.trim(F.coalesce("description", F.lit(""))) != ""
    eligible = ~is_structural()
    agg = c.agg(
        F.count("*").alias("total"),
        F.count_if(described).alias("described"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(eligible & F.col("signature").isNotNull()).alias("with_signature"),
        F.count_if(eligible & F.col("is_public")).alias("public"),
    )
    some = F.col("eligible") > 0
    return agg.select(
        "total",
        "described",
        percent(F.col("described"), F.col("total")).alias("described_pct"),
        F.when(some, F.col("with_signature")).alias("with_signature"),
        F.when(some, percent(F.col("with_signature"), F.col("eligible"))).alias("signature_pct"),
        F.when(some, F.col("public")).alias("public"),
        F.when(some, percent(F.col("public"), F.col("eligible"))).alias("public_pct"),
    )


def graph_stats(c: DataFrame, r: DataFrame) -> DataFrame:
    """One row: concepts, relations, components and isolated concepts."""
    parts = components(c, r).agg(F.count_distinct("component").alias("components"))
    lone = isolated_concepts(c, r).agg(F.count("*").alias("isolated"))
    both = c.agg(F.count("*").alias("concepts")).crossJoin(r.agg(F.count("*").alias("relations")))  # one row each
    return both.crossJoin(parts).crossJoin(lone)


def files_per_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n"))


def flips(runs: DataFrame) -> DataFrame:
    """(path, n_flips) over runs (run, path, hash): changes between consecutive runs."""
    from pyspark.sql import Window

    before = F.lag("hash").over(Window.partitionBy("path").orderBy("run"))
    return runs.withColumn("_was", before).groupBy("path").agg(F.count_if(F.col("_was").isNotNull() & (F.col("_was") != F.col("hash"))).alias("n_flips"))


NEGATIVE_PREFIXES = ("no ", "none", "not found", "nothing", "unknown", "0 ", "there are no", "could not", "cannot", "error")


def is_negative(text: Column) -> Column:
    low = F.lower(F.trim(text))
    out = F.contains(low, F.lit("not found"))
    for p in NEGATIVE_PREFIXES:
        out = out | F.startswith(low, F.lit(p))
    return out


def failure_mode(answers: DataFrame) -> DataFrame:
    """Outcome class of (error, expected_tool, tool, response) rows."""
    mode = F.when(F.col("error").isNotNull(), "loud").when(F.col("tool") == F.col("expected_tool"), "correct").when(is_negative(F.col("response")), "detectable").otherwise("silent")
    return answers.withColumn("mode", mode)


def answer_report(answers: DataFrame) -> DataFrame:
    """Accuracies, requests per answered question and tokens of (tool_ok, answer_ok, requests, prompt_tokens, completion_tokens)."""
    rate = lambda name: F.coalesce(F.avg(F.col(name).cast("double")), F.lit(0.0))
    return answers.agg(
        rate("tool_ok").alias("selection_accuracy"),
        rate("answer_ok").alias("final_answer_accuracy"),
        (F.sum("requests") / F.nullif(F.count_if("answer_ok"), F.lit(0))).alias("requests_per_answer"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("total_tokens"),
    )


def savings(samples: DataFrame, schema_tokens: int) -> DataFrame:
    """Mean tokens saved and queries until a schema of ``schema_tokens`` pays off."""
    mean = F.avg(F.col("source_tokens") - F.col("answer_tokens"))
    return samples.agg(mean.alias("mean_saving"), F.when(mean > 0, F.ceil(schema_tokens / mean)).alias("break_even"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")
