"""The files of a collection, through any file system that Spark reaches: moves, removals and restored contents."""

from __future__ import annotations

import datetime
import hashlib
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from kbspark.sources.durable import new_path


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def bare(self) -> str:
        """The root's path without scheme and host."""
        return self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/")

    def qualified(self) -> str:
        """The root with its scheme."""
        return self._fs.makeQualified(self._path("")).toString().rstrip("/")

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, name: str) -> list[str]:
        """Names of the files in a folder; of one that isn't there, none."""
        if not self.exists(name):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(name)))
        return [n for n in found if not n.startswith(".")]

    def create(self, name: str, content: bytes) -> bool:
        """Creates a file that must not exist, its content with it; False if it does.

        On a local disk the file is linked into place, which is atomic; other stores refuse the creation themselves, and show the
        content when the file is closed.
        """
        if self._fs.getScheme() == "file":
            target = self._fs.makeQualified(self._path(name)).toUri().getPath()
            fresh = f"{target.rpartition('/')[0]}/.{uuid.uuid4().hex}"
            files, at = self._jvm.java.nio.file.Files, lambda x: self._jvm.java.io.File(x).toPath()
            files.write(at(fresh), bytearray(content), self.spark.sparkContext._gateway.new_array(self._jvm.java.nio.file.OpenOption, 0))
            try:
                files.createLink(at(target), at(fresh))
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e.java_exception):
                    return False
                raise
            finally:
                files.delete(at(fresh))
            return True
        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        return True

    def write(self, name: str, content: bytes) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def facts(self, name: str) -> tuple[int, float]:
        """Size and seconds of the last change."""
        status = self._fs.getFileStatus(self._path(name))
        return status.getLen(), status.getModificationTime() / 1000

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), False)
        self._prune(name)

    def remove_all(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, pairs: Callable[[], Iterable[tuple[str, str]]], missing_ok: bool = False) -> int:
        """Renames in passes over the pairs, by way of a staging folder, so chains and swaps don't overwrite each other.

        A target that a file holds which isn't itself moved puts everything back and raises.
        """
        staged = lambda name: f".kb/moving/{hashlib.sha256(name.encode()).hexdigest()}"
        self._fs.mkdirs(self._path(".kb/moving"))
        try:
            for source, _ in pairs():
                if not missing_ok or self.exists(source):
                    self._rename(source, staged(source))
            for _, to in pairs():
                if self.exists(to):
                    raise FileExistsError(to)
        except OSError:
            for source, _ in pairs():
                if self.exists(staged(source)):
                    self._rename(staged(source), source)
            raise
        n = 0
        for source, to in pairs():
            if missing_ok and not self.exists(staged(source)):
                continue
            if "/" in to:
                self._fs.mkdirs(self._path(to.rpartition("/")[0]))
            self._rename(staged(source), to)
            self._prune(source)
            n += 1
        return n

    def collapse(self, keep: Iterable[str], gone: Iterable[str]) -> None:
        """Removes copies, once every file that stands for them is seen to be there."""
        for name in keep:
            if not self.exists(name):
                raise FileNotFoundError(f"{name} is missing; its copies stay")
        for name in gone:
            self.remove(name)

    def _rename(self, source: str, to: str) -> None:
        if not self.exists(source):
            raise FileNotFoundError(source)
        if not self._fs.rename(self._path(source), self._path(to)):
            raise OSError(f"{source} can't be moved to {to}")

    def _prune(self, name: str) -> None:
        """Removes the folders above name that are empty now, but for the root."""
        while "/" in name:
            name = name.rpartition("/")[0]
            if not self.exists(name) or len(self._fs.listStatus(self._path(name))):
                return
            self._fs.delete(self._path(name), False)


def hidden_files(spark: SparkSession, root: str, skip: str = ".kb") -> tuple[str, list[tuple[str, str, datetime.datetime]]]:
    """Copies, in a folder of the shared one, of the files whose name or folder begins with a dot or an underscore.

    Rows (copy's name, path below root, time of change).  Patterns find them a level at a time, inside the file system's own
    listing; only the hidden ones come to the driver.
    """
    folder = Folder(spark, root)
    fs, jvm = folder._fs, spark._jvm
    base = fs.makeQualified(folder._path("")).toString().rstrip("/")
    found, level = [], ""
    while True:
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/{level}{{.*,_*}}")) or []:
            if status.isDirectory():
                if status.getPath().getName() == skip:
                    continue
                inside = fs.listFiles(status.getPath(), True)
                while inside.hasNext():
                    found.append(inside.next())
            elif status.isFile():
                found.append(status)
        level += "*/"
        if not len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/{level}*")) or []):
            break
    copies = f"{new_path(spark, 'hidden')}"
    rows, seen = [], set()
    for status in found:
        name = status.getPath().toString()[len(base) + 1 :]
        checksum = name.endswith(".crc") and name.rpartition("/")[2].startswith(".")  # a local file system's own
        if name in seen or f"/{skip}/" in f"/{name}" or checksum:
            continue
        seen.add(name)
        copy = hashlib.sha256(name.encode()).hexdigest()
        target = jvm.org.apache.hadoop.fs.Path(f"{copies}/{copy}")
        conf = spark._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, status.getPath(), target.getFileSystem(conf), target, False, conf)
        rows.append((copy, name, datetime.datetime.fromtimestamp(status.getModificationTime() / 1000, datetime.UTC)))
    return copies, rows
