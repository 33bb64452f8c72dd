"""File systems of paths, for tasks and drivers that open files of their own."""

from __future__ import annotations


def opened(path: str):
    """(pyarrow file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
