"""Whole files on any file system that pyarrow knows, written and read from tasks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@contextmanager
def writing(uri: str):
    """A stream to ``uri`` that appears whole or not at all, also when a task is run twice."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        yield out
    fs.move(temp, path)


def reading(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_file(path)


def listing(folder: str) -> list[tuple[str, int, str]]:
    """(relative path, bytes, time of the last change) of all files below, by metadata alone.

    Spark's own file sources skip names that begin with an underscore, which are common in
    bundles, so names are listed here once and contents read by tasks.
    """
    fs, root = open_fs(folder.rstrip("/"))
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((x.path[len(root) + 1 :], x.size, str(x.mtime)) for x in found if x.type == pafs.FileType.File)


def read_below(folder: str, path: str) -> bytes:
    fs, root = open_fs(folder.rstrip("/"))
    with fs.open_input_file(f"{root}/{path}") as f:
        return f.read()
