"""File systems that Arrow opens by the paths that Spark lists."""

from __future__ import annotations

import re
from typing import BinaryIO
from urllib.parse import quote

from pyarrow import fs

#: Stores that Arrow opens on driver and executors.
ARROW_STORES = ("file", "s3", "s3a", "gs", "hdfs", "abfs", "abfss")


def store_name(path: str) -> str:
    return path.split(":", 1)[0] if re.match(r"\w+:", path) else "file"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    if store_name(path) == "file":
        return fs.LocalFileSystem(), "/" + re.sub("^file:", "", path).lstrip("/")
    return fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))


def open_path(path: str) -> BinaryIO:
    """A file for random access."""
    store, inside = store_of(path)
    return store.open_input_file(inside)
