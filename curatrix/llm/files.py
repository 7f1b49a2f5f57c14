"""Files that tasks share: a fresh folder under the checkpoint folder of the session, written and read through Arrow's file systems.

A name that no other task uses, and a table of the names that the successful tasks committed, make retries and lost executors harmless.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from curatrix.session import checkpoint_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    system, path = resolve(folder)
    system.create_dir(path, recursive=True)
    return folder


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of ``file:/x``, ``/x`` or any URI that Arrow knows."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> str:
    system, path = resolve(f"{folder}/{name}")
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)
    return name


def unique_name(stem: str) -> str:
    """A name that no other attempt of a task uses."""
    return f"{stem}-{uuid.uuid4().hex[:12]}"


def read_file(uri: str) -> bytes:
    system, path = resolve(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def mapped(uri: str) -> str:
    """A local path to map into memory: the file itself where the folder is mounted, else a copy in the task's own folder."""
    system, path = resolve(uri)
    if isinstance(system, fs.LocalFileSystem):
        return path
    copy = os.path.join(tempfile.gettempdir(), uri.replace("/", "_").replace(":", "_"))
    if not os.path.exists(copy):
        with system.open_input_stream(path, compression=None) as source, tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as out:
            while block := source.read(1 << 24):
                out.write(block)
        os.replace(out.name, copy)
    return copy
