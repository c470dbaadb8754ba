"""Binary files in the shared folder, from Python workers: local paths by the file system, other stores by pyarrow's."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


@contextmanager
def create(uri: str) -> Iterator[io.RawIOBase]:
    """Write a new file that appears whole or not at all under ``uri``."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as out:
                yield out
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(name) as out:
        yield out


@contextmanager
def read(uri: str) -> Iterator[io.RawIOBase]:
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            yield f
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    with store.open_input_file(name) as f:
        yield f


def remove(uri: str) -> None:
    path = _local(uri)
    if path is not None:
        if os.path.exists(path):
            os.remove(path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    store.delete_file(name)
