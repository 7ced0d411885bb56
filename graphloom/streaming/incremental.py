"""Incremental re-indexing: bursts of changes, an extraction cache, cached bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.files import listing
from graphloom.session import shared_path

VERSION = "1"


def bursts(events: DataFrame, key: str, ts: str, gap_s: float, ties: list[str]) -> DataFrame:
    """(key, burst, n_events, first, last): a burst ends when nothing follows within ``gap_s`` seconds."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    order = Window.partitionBy(key).orderBy(ts, *ties)
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order))
    new = F.when(gap.isNull() | (gap > int(gap_s * 1_000_000)), 1).otherwise(0)
    run = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = events.withColumn("_new", new).withColumn("burst", run)
    return marked.groupBy(key, "burst").agg(F.count("*").alias("n_events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def burst_stream(changes: DataFrame, ts: str, gap: str, lateness: str = "0 seconds") -> DataFrame:
    """The same over a stream of changes (path, ts): one row for each closed burst."""
    keyed = changes.withColumn("_all", F.lit(0)).withWatermark(ts, lateness)  # sessions need a key in streams
    return keyed.groupBy("_all", F.session_window(ts, gap).alias("burst")).agg(F.count("*").alias("n_changes"), F.collect_set("path").alias("paths"))


def watch(changes: DataFrame, ts: str, gap: str, regenerate: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Call ``regenerate`` with the bursts that each batch closed; a failed batch is tried again."""
    writer = burst_stream(changes, ts, gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda df, epoch: None if df.isEmpty() else regenerate(df, epoch))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class ExtractionCache:
    """Extracted rows by (path, hash), as one table; another version or none is an empty cache."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path

    def load(self, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        if self.path is None:
            return empty
        try:
            table = self.spark.read.parquet(self.path)
            columns = set(table.columns)
        except Exception:  # unreadable: start anew
            return empty
        if "version" not in columns or not set(empty.columns) <= columns:
            return empty
        return table.filter(F.col("version") == VERSION).select(*empty.columns)

    def save(self, rows: DataFrame) -> None:
        """Written to a new place, since the rows may come from the old one."""
        path = shared_path(self.spark, "extraction-cache")
        rows.withColumn("version", F.lit(VERSION)).write.parquet(path)
        self.path = path


def refresh(files: DataFrame, cache: ExtractionCache, extract: Callable[[DataFrame], DataFrame], schema: str) -> tuple[DataFrame, dict[str, int]]:
    """Extracted rows of all files (path, hash, ...), and how many were parsed and reused.

    Rows of files that are gone leave the cache.
    """
    old = cache.load(schema)
    known = old.select("path", "hash").distinct()
    reused = files.join(known, ["path", "hash"], "left_semi")
    fresh = files.join(known, ["path", "hash"], "left_anti")
    counts = {"reused": reused.count(), "parsed": fresh.count()}
    rows = old.join(files.select("path", "hash"), ["path", "hash"], "left_semi").unionByName(extract(fresh).select(*old.columns))
    cache.save(rows)
    return cache.load(schema), counts


def fingerprint(folder: str) -> tuple[int, int, str | None]:
    """(files, bytes, latest change) from metadata alone."""
    files = listing(folder)
    return len(files), sum(n for _, n, _ in files), max((t for *_, t in files), default=None)


class BundleCache:
    """Parsed bundles, kept while their fingerprint stays."""

    def __init__(self, spark: SparkSession, read: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]):
        self.spark, self.read = spark, read
        self.held: dict[str, tuple] = {}

    def get(self, folder: str) -> tuple[DataFrame, DataFrame]:
        mark = fingerprint(folder)
        if folder not in self.held or self.held[folder][0] != mark:
            for df in self.held.pop(folder, (None, ()))[1]:
                df.unpersist()
            self.held[folder] = (mark, tuple(df.cache() for df in self.read(self.spark, folder)))
        return self.held[folder][1]
