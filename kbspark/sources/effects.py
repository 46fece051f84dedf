"""What is done to a collection's files: moves, removals and restored contents, by executors, under an intent that outlives the driver.

Moves are written down as an intent before any file is touched.  Then, each by one pass of tasks: sources go to a staging folder;
targets are looked at; and, once the intent says so, staged files go to their targets.  A target that is taken, or a source that is
missing, puts everything back.  Every step of a file can be run twice, so lost tasks are simply run again, and a run that was
killed is finished by the next one if it had come to the last pass, and put back if it hadn't (``recover``).  One run at a time
works on a collection's files.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.durable import release, written
from kbspark.sources.folder import Folder
from kbspark.sources.listing import known, opened

INTENTS, MOVING = ".kb/intents", ".kb/moving"
_MOVE = "path string, to string"
#: Names in a message.
NAMED = 5


class _Files:
    """A collection's files, in a task."""

    def __init__(self, uri: str, intent: str = ""):
        self.fs, self.root = opened(uri)
        self.root, self.intent = self.root.rstrip("/"), intent
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def staged(self, name: str) -> str:
        return self.at(f"{MOVING}/{self.intent}/{hashlib.sha256(name.encode()).hexdigest()}")

    def there(self, place: str) -> bool:
        return self.fs.get_file_info(place).type != fs.FileType.NotFound

    def forget(self, *places: str) -> None:
        """Removes the checksum that a local file system of the JVM keeps beside a file, and would hold against the next one there."""
        for place in places if self.local else ():
            folder, _, base = place.rpartition("/")
            try:
                os.remove(f"{folder}/.{base}.crc")
            except OSError:
                continue

    def rename(self, place: str, to: str) -> bool:
        """False if it isn't there (any more: another attempt of the task may have been first)."""
        if not self.there(place):
            return False
        self.fs.create_dir(to.rpartition("/")[0], recursive=True)
        self.forget(place, to)
        try:
            self.fs.move(place, to)
        except FileNotFoundError:
            return False
        return True

    def delete(self, name: str) -> None:
        self.forget(self.at(name))
        try:
            self.fs.delete_file(self.at(name))
        except FileNotFoundError:  # another attempt was first
            return
        self.prune(name)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(self.at(name)) as stream:
            return stream.read()

    def write(self, name: str, content: bytes) -> None:
        """Under another name first, so no cut-off file stands where one is expected."""
        fresh = self.at(f"{MOVING}/{uuid.uuid4().hex}")
        self.fs.create_dir(self.at(MOVING), recursive=True)
        with self.fs.open_output_stream(fresh) as stream:
            stream.write(content)
        self.rename(fresh, self.at(name))

    def prune(self, name: str) -> None:
        """Folders above name that are empty now; stores without folders have none."""
        while self.local and "/" in name:
            name = name.rpartition("/")[0]
            try:
                os.rmdir(self.at(name))
            except OSError:
                return


def _stage(files: _Files, row: dict) -> str:
    return "" if files.rename(files.at(row["path"]), files.staged(row["path"])) or files.there(files.staged(row["path"])) else "missing"


def _look(files: _Files, row: dict) -> str:
    return "taken" if files.there(files.at(row["to"])) else ""


def _place(files: _Files, row: dict) -> str:
    if not files.rename(files.staged(row["path"]), files.at(row["to"])) and not files.there(files.at(row["to"])):
        return "missing"
    files.prune(row["path"])
    return ""


def _put_back(files: _Files, row: dict) -> str:
    files.rename(files.staged(row["path"]), files.at(row["path"]))
    return ""


def _seen(files: _Files, row: dict) -> str:
    return "" if files.there(files.at(row["path"])) else "missing"


def _remove(files: _Files, row: dict) -> str:
    """Where blob is given, only a file of that content."""
    if files.there(files.at(row["path"])) and (not row.get("blob") or "s2:" + hashlib.sha256(files.read(row["path"])).hexdigest() == row["blob"]):
        files.delete(row["path"])
    return ""


def _restore(files: _Files, row: dict) -> str:
    if not files.there(files.at(row["path"])):
        files.write(row["path"], row["content"])
    return ""


class Effects:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.uri = self.folder.qualified()

    @property
    def able(self) -> bool:
        """Whether executors reach the file system by themselves; else files are moved from the driver."""
        return known(self.uri)

    def _each(self, rows: DataFrame, step: Callable[[_Files, dict], str], intent: str = "") -> list[tuple[str, str]]:
        """Runs step on every row; (path, what's wrong) of a few that it finds wrong."""
        uri = self.uri

        def run(batches) -> Iterator[pa.RecordBatch]:
            files = _Files(uri, intent)
            for batch in batches:
                wrong = [(row["path"], x) for row in batch.to_pylist() if (x := step(files, row))]
                yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in wrong], pa.string()) for i in (0, 1)], names=["path", "wrong"])

        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        done = written(rows.repartition(tasks).mapInArrow(run, "path string, wrong string"), "effects")
        wrong = [(r["path"], r["wrong"]) for r in done.orderBy("path").limit(NAMED).collect()]
        release(done)
        return wrong

    def _moves(self, intent: str) -> DataFrame:
        return self.spark.read.schema(_MOVE).parquet(f"{self.folder.root}/{INTENTS}/{intent}/moves")

    def _end(self, intent: str) -> None:
        self.folder.remove_all(f"{INTENTS}/{intent}")
        self.folder.remove_all(f"{MOVING}/{intent}")

    def _undo(self, intent: str) -> None:
        self._each(self._moves(intent), _put_back, intent)
        self._end(intent)

    def move(self, moves: DataFrame, missing_ok: bool = False) -> None:
        """All of moves (path, to) or none; with missing_ok, those whose file is there."""
        if not self.able:
            self.folder.move(lambda: ((r["path"], r["to"]) for r in moves.toLocalIterator()), missing_ok)
            return
        self.recover()
        intent = uuid.uuid4().hex
        moves.select("path", "to").write.parquet(f"{self.folder.root}/{INTENTS}/{intent}/moves")
        told = self._moves(intent)
        self.folder.create(f"{INTENTS}/{intent}/planned.json", json.dumps({"missing_ok": missing_ok}).encode())
        self.folder.make(f"{MOVING}/{intent}")
        if (wrong := self._each(told, _stage, intent)) and not missing_ok:
            self._undo(intent)
            raise FileNotFoundError(", ".join(p for p, _ in wrong))
        if wrong := self._each(told.select(F.col("path"), "to"), _look):
            self._undo(intent)
            raise FileExistsError(", ".join(f"the target of {p}" for p, _ in wrong))
        self.folder.create(f"{INTENTS}/{intent}/staged.json", b"{}")
        self._finish(intent)

    def _finish(self, intent: str) -> None:
        self._each(self._moves(intent), _place, intent)
        self._end(intent)

    def recover(self) -> dict[str, str]:
        """Ends what killed runs have left: intent -> finished or put back."""
        out = {}
        for intent in self.folder.names(INTENTS):
            if self.folder.exists(f"{INTENTS}/{intent}/staged.json"):
                self._finish(intent)
                out[intent] = "finished"
            elif self.folder.exists(f"{INTENTS}/{intent}/planned.json"):
                self._undo(intent)
                out[intent] = "put back"
            else:  # nothing was touched yet
                self._end(intent)
        return out

    def collapse(self, keep: DataFrame, gone: DataFrame) -> None:
        """Removes copies (gone: path), once every file that stands for them (keep: path) is seen to be there."""
        if not self.able:
            self.folder.collapse((r[0] for r in keep.select("path").toLocalIterator()), (r[0] for r in gone.select("path").toLocalIterator()))
            return
        if wrong := self._each(keep.select("path"), _seen):
            raise FileNotFoundError(f"missing; copies stay: {', '.join(p for p, _ in wrong)}")
        self._each(gone.select("path"), _remove)

    def remove(self, files: DataFrame) -> None:
        """Removes files (path, blob) that still have their content."""
        if self.able:
            self._each(files.select("path", "blob"), _remove)
            return
        for r in files.select("path", "blob").toLocalIterator():
            if self.folder.exists(r["path"]) and "s2:" + hashlib.sha256(self.folder.read(r["path"])).hexdigest() == r["blob"]:
                self.folder.remove(r["path"])

    def restore(self, files: DataFrame) -> None:
        """Writes files (path, content) that aren't there."""
        if self.able:
            self._each(files.select("path", "content"), _restore)
            return
        for r in files.select("path", "content").toLocalIterator():
            if not self.folder.exists(r["path"]):
                self.folder.write(r["path"], bytes(r["content"]))
