"""Files that Spark's own listing leaves out (names that begin with a dot or an underscore), as a data source read by executors.

A partition is a folder, or a share of one by a checksum of the names; its task lists it and reads the files, so neither names nor
contents pass the driver.  The driver lists folders only, and only as many as it takes to have work for every task.
"""

from __future__ import annotations

import datetime
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, mod_time timestamp, content binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the root's path on it; raises where there is none for it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def known(uri: str) -> bool:
    try:
        return opened(uri)[0].get_file_info(opened(uri)[1]).type == fs.FileType.Directory
    except Exception:  # noqa: BLE001 - no such file system here, or it can't be reached
        return False


@dataclass
class Share(InputPartition):
    """Names of a folder whose checksum modulo of is part; whole: with all folders below it."""

    folder: str
    whole: bool
    part: int = 0
    of: int = 1


def _hidden(name: str) -> bool:
    return any(x[0] in "._" for x in name.split("/") if x)


def _checksum(name: str) -> bool:
    """A local file system's own."""
    base = name.rpartition("/")[2]
    return base.startswith(".") and base.endswith(".crc")


class HiddenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.skip, self.tasks = options["path"], options.get("skip", ".kb"), int(options.get("tasks", "8"))

    def _listed(self, files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
        return files.get_file_info(fs.FileSelector(folder, allow_not_found=True))

    def _inside(self, info: fs.FileInfo) -> bool:
        return info.type == fs.FileType.Directory and info.base_name != self.skip

    def partitions(self) -> list[Share]:
        files, root = opened(self.uri)
        level, out = [root], []
        while level and len(level) < self.tasks:
            deeper = [i.path for folder in level for i in self._listed(files, folder) if self._inside(i)]
            if not deeper:
                break
            out += [Share(folder, False) for folder in level]
            level = deeper
        out += [Share(folder, True) for folder in level]
        times = -(-self.tasks // len(out))
        return [Share(s.folder, s.whole, k, times) for s in out for k in range(times)]

    def read(self, partition: Share) -> Iterator[tuple]:
        files, root = opened(self.uri)
        folders, below = [partition.folder], len(root.rstrip("/")) + 1
        while folders:
            for info in self._listed(files, folders.pop()):
                name = info.path[below:]
                if self._inside(info):
                    if partition.whole:
                        folders.append(info.path)
                elif info.type == fs.FileType.File and _hidden(name) and not _checksum(name) and zlib.crc32(name.encode()) % partition.of == partition.part:
                    with files.open_input_stream(info.path) as stream:
                        content = stream.read()
                    at = datetime.datetime.fromtimestamp(info.mtime_ns // 1_000_000 / 1000, datetime.UTC)
                    yield name, len(content), at, content


class HiddenFiles(DataSource):
    """Options: path (the root), skip (a folder name left out), tasks."""

    @classmethod
    def name(cls) -> str:
        return "kb_hidden_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HiddenReader:
        return HiddenReader(dict(self.options))
