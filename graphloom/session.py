"""Session helpers: the shared folder, materialised intermediates and sizing.

Intermediate tables are cut from their lineage by writing them to the folder that the
cluster names in ``spark.checkpoint.dir``. All executors see that folder, so a lost
executor costs at most the tasks it was running.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_temporary: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; a private one is made only in local mode, where none is configured."""
    root = spark.conf.get(_KEY, None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set(_KEY, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, with its schema kept.

    The copy lasts until the application ends or calls ``cleanup``.
    """
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/graphloom/tmp/{spark.sparkContext.applicationId}"
    if not _temporary:
        atexit.register(_drop_all)
    _temporary.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_all() -> None:
    for folder in list(_temporary):
        _temporary.discard(folder)
        try:
            fs, path = pafs.FileSystem.from_uri(folder)
            fs.delete_dir(path)
        except (OSError, ValueError):  # gone already, or a file system only the JVM knows
            pass


def cleanup() -> None:
    """Delete the intermediate tables of this process; results read from them must be written before."""
    _drop_all()


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added until no column in ``taken`` has them, case aside."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def addressed(df: DataFrame, file: str, row: str) -> DataFrame:
    """``df``, a table from ``placed``, with the hash of each row's file and its place there.

    Unlike ids by partition these are equal on every read and do not move with the number of cores.
    """
    place = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row))


def placed(df: DataFrame) -> DataFrame:
    """``df`` itself where it is a projection or filter of files that know their rows' places, else a written copy."""
    plan = df._jdf.queryExecution().analyzed().toString()
    if "Generate" not in plan and "Sample" not in plan:  # these repeat places
        try:
            addressed(df, *free_names(df.columns, "_file", "_row"))
            return df
        except AnalysisException:
            pass
    return materialize(df, "placed")


#: Rows and bytes of the batches in which texts go to Python, where the session has the defaults.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than the default 10,000 rows: texts are long, executors small."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if int(spark.conf.get(size).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(rows: int, rows_per_part: int) -> int:
    """Number of partitions that keeps each near ``rows_per_part`` rows."""
    return max(1, math.ceil(rows / rows_per_part))
