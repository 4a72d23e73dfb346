"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import SparkSession

from linkloom.plans.tables import Workspace, shared_dir

__all__ = ["Workspace", "filesystem", "lean", "shared_dir", "shuffle_partitions"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(1)
def _trim() -> Callable[[int], int]:
    """The C library's malloc_trim, or nothing where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which the memory that it no longer uses goes back to the system.

    Python workers outlive their tasks. Without this each holds the most that any of its tasks ever took, beside an
    executor that has long gone on to other work.
    """

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return run


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder, for files that aren't Spark tables."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
