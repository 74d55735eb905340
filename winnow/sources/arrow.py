"""Files opened in tasks through Arrow's file systems (local, HDFS, S3, GCS), by the names that Spark gives them."""

from __future__ import annotations

import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith("file:") or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    """For reading, at any place."""
    store, bare = located(path)
    return store.open_input_file(bare)


def open_out(path: str):
    """For writing, a new file or an old one anew; its folder is made where the store has folders."""
    store, bare = located(path)
    store.create_dir(bare.rpartition("/")[0], recursive=True)
    return store.open_output_stream(bare)
