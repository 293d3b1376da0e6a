"""Files by path or URI: the driver asks Hadoop's file systems, tasks open them through Arrow's; local paths need neither."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

#: This driver's scratch folder in local mode.
_OWN: list[str] = []


def local(path: str) -> str | None:
    """The path on this machine, or None for a URI of another file system."""
    if "://" not in path and not path.startswith("file:"):
        return path
    uri = urlparse(path)
    return unquote(uri.path) if uri.scheme == "file" else None


def _hadoop(path: str) -> tuple[Any, Any]:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def join(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0] or ("/" if path.startswith("/") else ".")


def base(path: str) -> str:
    """The last part of a path or URI, as it is called."""
    return os.path.basename(unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path.rstrip("/"))


def exists(path: str) -> bool:
    if (p := local(path)) is not None:
        return os.path.exists(p)
    fs, p = _hadoop(path)
    return fs.exists(p)


def is_dir(path: str) -> bool:
    if (p := local(path)) is not None:
        return os.path.isdir(p)
    fs, p = _hadoop(path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def listed(path: str, *, deep: bool = False) -> Iterator[str]:
    """The files of a folder, and of the folders in it if ``deep``."""
    if (p := local(path)) is not None:
        for folder, _, names in os.walk(p):
            yield from (os.path.join(folder, n) for n in names)
            if not deep:
                return
        return
    fs, p = _hadoop(path)
    found = fs.listFiles(p, deep)
    while found.hasNext():
        yield found.next().getPath().toString()


def make_dir(path: str) -> None:
    if (p := local(path)) is not None:
        os.makedirs(p, exist_ok=True)
    else:
        fs, p = _hadoop(path)
        fs.mkdirs(p)


def replace(old: str, new: str) -> None:
    """Gives a file the name of another, which it replaces."""
    a, b = local(old), local(new)
    if a is not None and b is not None:
        os.replace(a, b)
        return
    fs, p = _hadoop(new)
    fs.delete(p, False)
    if not fs.rename(_hadoop(old)[1], p):
        raise OSError(f"{old} can't be renamed to {new}")


def delete(path: str) -> None:
    """Takes a file or a folder away, if it is there."""
    if (p := local(path)) is None:
        fs, p = _hadoop(path)
        fs.delete(p, True)
    elif os.path.isdir(p):
        shutil.rmtree(p, ignore_errors=True)
    elif os.path.exists(p):
        os.remove(p)


def opened(path: str, mode: str) -> Any:
    """A file of bytes, in tasks too."""
    if (p := local(path)) is not None:
        return pa.OSFile(p, mode)
    fs, p = pafs.FileSystem.from_uri(path)
    return fs.open_output_stream(p) if mode == "wb" else fs.open_input_file(p)


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all tasks reach. Only local mode has one of its own where none is configured."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="recordmill-"))
        top = f"file://{_OWN[0]}"
    return f"{top.rstrip('/')}/recordmill-{uuid.uuid4().hex}"
