"""Durable intermediates: tables written to the folder that all executors share, and taken away again.

``written`` ends the lineage of a table, so a lost executor costs nothing.  A table that a later one has replaced is given to
``release``; what is left when the driver ends, or when a ``scratch`` block ends, is deleted with it.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession



class _Blocks(threading.local):
    """Open scratch blocks of a thread, each with the paths written inside it."""

    def __init__(self):
        self.open: list[list[str]] = []


_BLOCKS = _Blocks()
#: Folders of applications that are deleted at the end.
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where the session names none, one of our own, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"kbspark-{os.getuid()}")
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def own_folder(spark: SparkSession) -> str:
    """The application's folder in the shared one; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/kbspark/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)

        def end() -> None:
            with suppress(Exception):  # the JVM may be gone already
                delete(spark, folder)

        atexit.register(end)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _BLOCKS.open:
        _BLOCKS.open[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kb_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_kb_path", None)
        if path:
            delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, name: str = "") -> Iterator:
    """Gives a function that writes a table to be kept; all other tables written inside the block are deleted at its end."""
    own: list[str] = []
    _BLOCKS.open.append(own)

    def keep(df: DataFrame) -> DataFrame:
        out = written(df, name or "kept")
        own.remove(out._kb_path)
        return out

    try:
        yield keep
    finally:
        _BLOCKS.open.remove(own)
        for path in own:
            delete(spark, path)
