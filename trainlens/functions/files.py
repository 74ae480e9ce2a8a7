"""File access from tasks, by the paths that Spark lists."""

from __future__ import annotations

import re

from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI (``file:/x`` as Spark writes it), or
    of a local path."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def read_range(path: str, offset: int, length: int) -> bytes:
    where, plain = open_fs(path)
    with where.open_input_file(plain) as f:
        return f.read_at(length, offset)
