"""Binary files in a folder that is given by a URI, as executors write and read them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it; a plain path is a local one."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str):
    """A file that appears under its name once it is whole, so that a second attempt of a task can't spoil it."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        yield out
    fs.move(own, path)
