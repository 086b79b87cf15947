"""Plain files in the cluster's shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import NativeFile
from pyarrow import fs as arrow_fs


def _located(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return arrow_fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri)


def create(folder: str, ending: str) -> tuple[str, NativeFile]:
    """A new file of a name no other attempt of this task uses: (URI, stream)."""
    uri = f"{folder}/{uuid.uuid4().hex}{ending}"
    system, path = _located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def open_stream(uri: str) -> NativeFile:
    system, path = _located(uri)
    return system.open_input_stream(path, compression=None)


def open_file(uri: str) -> NativeFile:
    """For reading at offsets."""
    system, path = _located(uri)
    return system.open_input_file(path)
