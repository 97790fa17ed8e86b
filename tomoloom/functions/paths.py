"""Files by path or address, opened in tasks through the file system that the address names."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it. A plain path, or one that starts with `file:`, is local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(quote(path, safe=":/"))
    return fs.LocalFileSystem(), path


def open_file(path: str):
    """A file for reading at any place."""
    store, inner = located(path)
    return store.open_input_file(inner)


def write_file(path: str, data: bytes) -> None:
    """Write a file whole, with the folders above it."""
    store, inner = located(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner) as out:
        out.write(data)
