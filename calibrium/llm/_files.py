"""Files in the shared folder, from executors too, by URI (local, HDFS, object stores)."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    f, path = opened(uri)
    f.create_dir(path, recursive=True)
