"""Files in the shared folder, written and read by Spark tasks.

A task writes under a name of its own (a retried or speculative task writes another file) and reports the
name with its rows, so only files of tasks that succeeded are ever looked at.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=64)
def _filesystem(root: str):
    return fs.FileSystem.from_uri(root)[0]


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain path."""
    m = re.match(r"file:/*(/.*)", uri)
    if m or "://" not in uri:
        return _local(), m[1] if m else uri
    return _filesystem(re.match(r"[^:]+://[^/]*/", uri + "/")[0]), fs.FileSystem.from_uri(uri)[1]


@lru_cache(maxsize=1)
def _local() -> fs.FileSystem:
    return fs.LocalFileSystem()


def new_file(folder: str, kind: str) -> str:
    """A name in ``folder`` that no other task has."""
    filesystem, path = locate(folder)
    filesystem.create_dir(path, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}.{kind}"


def open_output(uri: str):
    filesystem, path = locate(uri)
    return filesystem.open_output_stream(path, compression=None)


@lru_cache(maxsize=64)
def open_input(uri: str):
    """A file for range reads; a task may read the same one many times."""
    filesystem, path = locate(uri)
    return filesystem.open_input_file(path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    data = open_input(uri).read_at(length, offset)
    if len(data) != length:
        raise OSError(f"{uri} ends before {offset + length}")
    return data
