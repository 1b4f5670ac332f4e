"""Whole files and ranges of files in the shared folder, from tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def task_file(folder: str, suffix: str) -> str:
    """A name that no other attempt of a task uses.

    A file counts once its row stands in the table of files that Spark commits;
    what a lost attempt has left is never read.
    """
    return f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}{suffix}"


def make_folder(uri: str) -> str:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)
    return uri
