"""Marked rows of a table of files, as one bitmap a file in the shared folder.

A row is named by ``session.addressed``: the hash of its file and its place there. Deciding on
narrow rows and marking the chosen ones lets a later scan of the wide rows pick them out
without a shuffle of their texts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.files import open_fs
from graphloom.llm.files import load_array, save_array
from graphloom.session import addressed, free_names, materialize, shared_path, shuffle_width

_HELD = 16
_bitmaps: OrderedDict[str, np.ndarray | None] = OrderedDict()


@dataclass
class Marks:
    root: str

    def _uri(self, file: int) -> str:
        return f"{self.root}/{file & (1 << 64) - 1:016x}.npy"

    def _bitmap(self, file: int) -> np.ndarray | None:
        uri = self._uri(file)
        if uri not in _bitmaps:
            fs, path = open_fs(uri)
            found = fs.get_file_info(path).type != pafs.FileType.NotFound
            _bitmaps[uri] = load_array(uri) if found else None
            while len(_bitmaps) > _HELD:
                _bitmaps.popitem(last=False)
        return _bitmaps[uri]

    def of(self, files: pa.Array, rows: pa.Array) -> np.ndarray:
        """Whether each (file, row) is marked."""
        files, rows = np.asarray(files).astype(np.int64), np.asarray(rows).astype(np.int64)
        out = np.zeros(len(rows), bool)
        heads = np.flatnonzero(np.append(True, files[1:] != files[:-1])) if len(files) else []
        for a, b in zip(heads, [*heads[1:], len(files)]):
            bitmap = self._bitmap(int(files[a]))
            if bitmap is not None:
                r = rows[a:b]
                known = r >> 3 < len(bitmap)
                out[a:b][known] = (bitmap[r[known] >> 3] >> (r[known] & 7).astype(np.uint8)) & 1 > 0
        return out


def write_marks(chosen: DataFrame, name: str) -> Marks:
    """``chosen`` (file, row), repeats allowed; a task holds the bits of one file at a time."""
    spark = chosen.sparkSession
    marks = Marks(shared_path(spark, name))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by file and row."""
        now, parts = None, []

        def done() -> pa.RecordBatch:
            rows = np.concatenate(parts)
            bits = np.zeros(int(rows[-1]) // 8 + 1, np.uint8)
            np.bitwise_or.at(bits, rows >> 3, np.left_shift(np.uint8(1), (rows & 7).astype(np.uint8)))
            save_array(marks._uri(now), bits)
            return pa.RecordBatch.from_pylist([{"n": len(rows)}])

        for batch in batches:
            files, rows = np.asarray(batch.column("file")), np.asarray(batch.column("row"))
            heads = np.flatnonzero(np.append(True, files[1:] != files[:-1])) if len(files) else []
            for a, b in zip(heads, [*heads[1:], len(files)]):
                if now is not None and now != int(files[a]):
                    yield done()
                    parts = []
                now = int(files[a])
                parts.append(rows[a:b])
        if now is not None:
            yield done()

    rows = chosen.select("file", "row").repartition(shuffle_width(spark), "file").sortWithinPartitions("file", "row")
    materialize(rows.mapInArrow(save, "n long"), name)
    return marks


def only_marked(df: DataFrame, marks: Marks) -> DataFrame:
    """The marked rows of ``df``, with its columns; ``df``, from ``placed``, is the table whose rows were marked."""
    file, row = free_names(df.columns, "_file", "_row")
    wide = addressed(df, file, row)

    @F.arrow_udf("boolean")
    def kept(files: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array(marks.of(files, rows))

    return wide.filter(kept(file, row)).select(*(wide[c] for c in df.columns))
