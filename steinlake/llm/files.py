"""Bytes to and from the shared folder inside tasks."""

from __future__ import annotations

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3: ...) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def write_new(store: fs.FileSystem, path: str):
    """A stream that makes the file and its folder."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)
