"""A content-addressed WARC archive.

The archive has two tables in the shared folder. ``payloads`` holds the bytes of every
distinct payload once, under its SHA-256 and length; ``headers`` holds the exact header bytes
of every record with the digest of its payload. Joining them by digest gives the records
back, byte for byte. Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the
one with the largest page_id is the response and the others revisit it.

The digest is verified twice: on writing, all payloads under one digest must have equal
length and equal 64-bit checksums of another kind, and on reading, the stored bytes are
hashed again.

Edge cases: a null html is an empty payload; a null url has an empty target; repeated
page_ids with equal payloads give one response and revisits of it; a null page_id loses
against any other; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.files import reading, writing
from graphloom.session import shared_path

LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A digest is hot when it has more than this share of all records: at most 1 / HOT are.
HOT = 0.001


@dataclass
class Archive:
    root: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/headers")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/payloads")


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{copy}')}>"


def _clean(value: str | None) -> str:
    """A header value: line ends would end the header, so they are percent-encoded."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def header(row: dict) -> bytes:
    """Header block of one record, up to and with its empty line."""
    response = row["record_type"] == "response"
    lines = [
        _VERSION,
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'], row['copy'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(row['url'])}",
        f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{row['sha1']}",
        f"X-Payload-Length: {row['bytes']}",
    ]
    if not response:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(row['owner'], row['owner_copy'])}", f"X-Refers-To-Page-ID: {'' if row['owner'] is None else row['owner']}"]
    lines.append(f"Content-Length: {row['bytes'] if response else 0}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archive(pages: DataFrame, least: int = LEAST_REVISIT) -> Archive:
    """Two passes over the pages: payloads are merged map-side and shuffled once, headers carry no payload."""
    spark = pages.sparkSession
    archive = Archive(shared_path(spark, "warc"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    digest = F.concat(F.sha2("payload", 256), F.lit("-"), F.octet_length("payload")).alias("digest")
    store = rows.select(digest, "payload", F.xxhash64("payload").alias("check"))
    store = store.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("check").alias("low"), F.max("check").alias("high"))
    sure = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("different payloads under digest "), F.col("digest"))).cast("binary"))
    store.select("digest", sure.alias("payload")).write.parquet(f"{archive.root}/payloads")

    meta_path = f"{archive.root}/meta"
    rows.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", digest, F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")).write.parquet(meta_path)
    meta = spark.read.parquet(meta_path)
    owner = F.max(F.struct("page_id", F.negate("uid").alias("order")))  # a null page_id is the least
    groups = meta.filter(F.col("bytes") >= least).groupBy("digest").agg(owner.alias("own"), F.count("*").alias("n")).filter("n > 1")
    total = meta.count()
    hot = groups.filter(F.col("n") > HOT * total)  # at most 1 / HOT rows
    named = meta.join(F.broadcast(hot), "digest", "left")
    rest = named.filter("n is null").drop("own", "n").join(groups.filter(F.col("n") <= HOT * total), "digest", "left")
    typed = named.filter("n is not null").unionByName(rest)
    revisit = F.col("own").isNotNull() & (F.negate("uid") != F.col("own.order"))
    typed = typed.select(
        "uid",
        "page_id",
        "url",
        "digest",
        "sha1",
        "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("own.page_id")).alias("owner"),
        F.when(revisit, F.negate("own.order")).alias("owner_copy"),
        F.col("uid").alias("copy"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [header(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(made, pa.binary())], ["digest", "header"])

    typed.mapInArrow(build, "digest string, header binary").write.parquet(f"{archive.root}/headers")
    return archive


def _field(name: str):
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def parse(headers: DataFrame) -> DataFrame:
    """Header bytes as columns."""
    return headers.select(
        "digest",
        _field("X-Page-ID").cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest").alias("claimed"),
    )


def _join_digest(records: DataFrame, sides: DataFrame) -> DataFrame:
    """Records with the row of their digest; digests of many records are joined by broadcast."""
    total = records.count()
    often = records.groupBy("digest").count().filter(F.col("count") > HOT * total).select("digest")  # at most 1 / HOT rows
    hot = F.broadcast(often)
    few = records.join(hot, "digest", "left_anti").join(sides, "digest")
    return records.join(F.broadcast(sides.join(hot, "digest", "left_semi")), "digest").unionByName(few)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record, with length and digest taken from the stored bytes themselves."""
    stored = archive.payloads(spark).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    rows = _join_digest(parse(archive.headers(spark)), stored)
    sound = F.col("claimed") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not match its header")).cast("string"))
    return rows.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "url")


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records as WARC bytes, revisits without a payload, and all payloads beside them.

    Payload bytes of hot digests are streamed to each of their records through a salted join.
    """
    headers = archive.headers(spark)
    salts = 32
    often = F.broadcast(headers.groupBy("digest").count().filter(F.col("count") > 1000).select("digest"))
    left = headers.withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(salts)))
    bodies = archive.payloads(spark)
    hot = bodies.join(often, "digest", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    joined = left.join(often, "digest", "left_semi").join(hot, ["digest", "salt"]).unionByName(left.join(often, "digest", "left_anti").join(bodies, "digest"))
    held = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(_field("X-Page-ID").cast("long").alias("page_id"), F.concat("header", held, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def export(spark: SparkSession, archive: Archive, root: str) -> DataFrame:
    """Write the records as .warc files, one a task; returns their paths and record counts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri, n = f"{root}/part-{TaskContext.get().partitionId():06d}.warc", 0
        with writing(uri) as out:
            for batch in batches:
                for record in batch.column("record"):
                    out.write(record.as_py())
                    n += 1
        yield pa.RecordBatch.from_pylist([{"path": uri, "n_records": n}])

    return records(spark, archive).select("record").mapInArrow(write, "path string, n_records long")


def read_warc(uri: str) -> Iterable[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of one .warc file, streamed."""
    with reading(uri) as f:
        buffer = b""

        def more() -> bool:
            nonlocal buffer
            piece = f.read(1 << 20)
            buffer += piece
            return bool(piece)

        while True:
            while b"\r\n\r\n" not in buffer:
                if not more():
                    return
            head, buffer = buffer.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            while len(buffer) < size + 4 and more():
                pass
            yield fields, buffer[:size]
            buffer = buffer[size + 4 :]


