"""Token-id files with Elias-Fano document boundaries.

``write_tokens`` stores the ids of all documents in ascending ``doc_id`` order as shards.
A shard is one file: a header, the ids back to back (two bytes each while the vocabulary
allows it), the document boundaries and the document ids, both as Elias-Fano sequences.
An Elias-Fano sequence of n values below u takes n * (2 + log2(u / n)) bits or so; every
256th set bit of its upper half is sampled, so that one boundary is found without decoding
the others. Where each shard begins in the whole comes from a table of one row per shard.

Edge cases: a null text is empty and still gets its end id; a null doc_id sorts first and
comes back as null; repeated ids keep one entry per row, ordered by a hash of the text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.files import reading, writing
from graphloom.llm.tokens import encoder
from graphloom.session import materialize, shared_path, shuffle_width, text_batches

END_ID = 2
SAMPLE = 256
_MAGIC = b"GLTOK1\0\0"
_HEAD = struct.Struct("<8sQQQQB7x")  # magic, documents, null ids first, ids, lowest id, bytes per id


class EliasFano:
    """A non-decreasing sequence of unsigned integers, with access by position."""

    _head = struct.Struct("<QQBxxxxxxx")

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        if bits:
            shifts = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, universe, bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        sizes = struct.pack("<QQ", len(self.low), len(self.high))
        return b"".join([self._head.pack(self.n, self.universe, self.low_bits), sizes, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at a place of ``raw``, and where it ends."""
        n, universe, bits = cls._head.unpack_from(raw, at)
        n_low, n_high = struct.unpack_from("<QQ", raw, at + cls._head.size)
        p = at + cls._head.size + 16
        low = np.frombuffer(raw, np.uint8, n_low, p)
        high = np.frombuffer(raw, np.uint8, n_high, p + n_low)
        k = -(-n // SAMPLE)
        samples = np.frombuffer(raw, "<u8", k, p + n_low + n_high)
        return cls(n, universe, bits, low, high, samples), p + n_low + n_high + 8 * k

    def select(self, i: int) -> int:
        """Place of the i-th set bit of the upper half: from a sample, then byte by byte."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        now = int(self.high[byte]) & (0xFF << (at % 8)) & 0xFF
        while left >= now.bit_count():
            left -= now.bit_count()
            byte += 1
            now = int(self.high[byte])
        for _ in range(left):
            now &= now - 1
        return byte * 8 + (now & -now).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            piece = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
            low = piece >> first % 8 & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)[: self.n]
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            flags = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= flags.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out


class TokenShard:
    """One shard file; ``document(i)`` reads the ids of one document."""

    def __init__(self, uri: str):
        self.file = reading(uri)
        magic, self.n, self.nulls, self.n_ids, self.lowest, self.width = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.lowest -= 1 << 63
        self.file.seek(_HEAD.size + self.n_ids * self.width)
        tail = self.file.read()
        self.bounds, at = EliasFano.from_bytes(tail)
        self.keys, _ = EliasFano.from_bytes(tail, at)

    def ids(self, first: int, last: int) -> np.ndarray:
        self.file.seek(_HEAD.size + first * self.width)
        return np.frombuffer(self.file.read((last - first) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i], self.bounds[i + 1])

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [int(k) + self.lowest for k in self.keys.all()]


def _write_shard(uri: str, batches: Iterator[pa.RecordBatch], tokenizer: str | None, end_id: int) -> dict:
    enc = encoder(tokenizer)
    width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()
    lengths: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    nulls = n_ids = 0
    with writing(uri + ".ids") as out:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            nulls += ids.null_count
            keys.append(np.asarray(ids.drop_null(), np.int64))
            step = 4000
            for i in range(0, len(texts), step):
                got = enc.encode(texts.slice(i, step))
                lengths.append(np.fromiter(map(len, got), np.int64, len(got)) // 4 + 1)
                block = np.frombuffer(end.join([*got, b""]), "<u4")
                n_ids += len(block)
                out.write(block.astype(f"<u{width}").tobytes())
    every = np.concatenate([np.zeros(0, np.int64), *lengths])
    key = np.concatenate([np.zeros(0, np.int64), *keys])
    lowest = int(key[0]) if len(key) else 0
    bounds = EliasFano.of(np.append(0, np.cumsum(every)))
    names = EliasFano.of((key - lowest).astype(np.uint64))
    head = _HEAD.pack(_MAGIC, len(every), nulls, n_ids, lowest + (1 << 63), width)
    with writing(uri) as out, reading(uri + ".ids") as body:
        out.write(head)
        while piece := body.read(1 << 22):
            out.write(piece)
        out.write(bounds.to_bytes())
        out.write(names.to_bytes())
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri + ".ids")
    fs.delete_file(path)
    return {"path": uri, "n_docs": len(every), "n_ids": n_ids}


_MANIFEST = "shard long, path string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents; returns one row per shard with ``start``, the ids before it.

    One shuffle, of the texts, by ranges of (doc_id, text hash): a hot doc_id spreads over
    shards. Each task streams its rows and holds only the lengths and doc_ids of a shard.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    text_batches(spark)
    root = shared_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        done = _write_shard(f"{root}/{shard:08d}.tok", batches, tokenizer, end_id)
        yield pa.RecordBatch.from_pylist([{"shard": shard, **done}])

    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spread = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    shards = materialize(spread.mapInArrow(write, _MANIFEST), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32[, ids]."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(row["path"])
                bounds = shard.bounds.all().astype(np.int64)
                keys = shard.doc_ids()
                for i in range(0, shard.n, 2000):
                    j = min(i + 2000, shard.n)
                    ids = shard.ids(int(bounds[i]), int(bounds[j])).astype("<u4").tobytes()
                    cut = ((bounds[i : j + 1] - bounds[i]) * 4).tolist()
                    each = [ids[a:b] for a, b in zip(cut, cut[1:])]
                    out = {
                        "doc_id": pa.array(keys[i:j], pa.int64()),
                        "start": pa.array(bounds[i:j] + row["start"]),
                        "n_tokens": pa.array(np.diff(bounds[i : j + 1])),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array(each, pa.binary())
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    spark: SparkSession = shards.sparkSession
    return shards.repartition(shuffle_width(spark), "shard").mapInArrow(read, schema)
