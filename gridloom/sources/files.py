"""Files of any store: opened by URI, so that nothing needs a local path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs


def place(uri: str):
    """The file system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def info(uri: str):
    where, path = place(uri)
    return where.get_file_info(path)


def exists(uri: str) -> bool:
    return info(uri).type != fs.FileType.NotFound


def is_file(uri: str) -> bool:
    return info(uri).type == fs.FileType.File


def open_file(uri: str):
    """A seekable binary file."""
    where, path = place(uri)
    return where.open_input_file(path)


def head(uri: str, size: int = 1 << 16) -> bytes:
    with open_file(uri) as f:
        return f.read(size)


def read_text(uri: str) -> str:
    with open_file(uri) as f:
        return f.read().decode("utf-8")


def write_bytes(uri: str, data: bytes) -> None:
    where, path = place(uri)
    with where.open_output_stream(path) as f:
        f.write(data)


def scratch(spark) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or the warehouse. A local session
    without the setting takes a temporary folder, gone when its process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/gridloom/files-{uuid.uuid4().hex}"
    where, target = place(path)
    where.create_dir(target, recursive=True)
    return path
