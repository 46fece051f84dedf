"""Versioned snapshots as a base and a log of changed paths, with a head pointer; and the scan that feeds them.

A store is a folder: ``entries/manifest_id=M<n>/`` (whole tables), ``changes/manifest_id=M<n>/`` (the paths that a commit put or
took away, one row a path), ``segments/`` (changes of several commits merged), ``manifests/M<n>.json`` (one row each, with the
base and the segments that make the snapshot), ``claims/`` (numbers given out), ``blobs/`` (content by hash, a folder a write) and
``head/<step>`` (a snapshot's id each; the largest step counts).  A commit writes the rows of its changed paths only.  Segments
shrink at least by half from one to the next: a commit that would break this merges the last ones, so a snapshot is a base and
a logarithmic number of segments, and where these hold more than ``LOG_SHARE`` of the base's rows a new base is written.  Older
snapshots keep what they were made of, so every one stays readable.  Nothing is overwritten: numbers and steps are taken by
creating a file that must not exist, so of two writers that start from one head only one moves it, and the other is told.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources import listing
from kbspark.sources.durable import release, written
from kbspark.sources.folder import Folder, hidden_files

ENTRY = "path string, blob string, size long, mod_time timestamp, labels array<string>, rule string"
FIELDS = tuple(c.split()[0] for c in ENTRY.split(", "))
#: gone: the path is taken away; known: the snapshot before has it.
CHANGE = f"{ENTRY}, gone boolean, known boolean"
MANIFEST = "id string, seq long, parent string, created_at timestamp, created_by string, kind string, entries long"
#: Rows of the segments, as a share of the base's, above which a commit writes a new base.
LOG_SHARE = 0.5
KINDS = ("observe", "mutate")
#: Expected head of a commit that takes any.
ANY = object()


_BLOBS = "blob string, content binary, batch string"


class StoreError(RuntimeError):
    pass


class HeadMoved(StoreError):
    """Another commit or undo came between; derive the entries again from the new head."""


def content_hash(content):
    return F.concat(F.lit("s2:"), F.sha2(content, 256))


def _columns() -> list:
    return [F.col(c.split()[0]).cast(c.split()[1]) for c in ENTRY.split(", ")]


def _typed(entries: DataFrame) -> DataFrame:
    return entries.select(*_columns())


def taken_away(paths: DataFrame) -> DataFrame:
    """Changes that take paths (path) away."""
    return paths.select("path", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ENTRY.split(", ")[1:]), F.lit(True).alias("gone"))


def replaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that put the entries after in the place of those before: paths only before are gone."""
    return _typed(after).withColumn("gone", F.lit(False)).unionByName(taken_away(before.join(after.select("path"), "path", "left_anti")))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def init(self) -> Store:
        if self.folder.exists("manifests"):
            raise StoreError("already a store")
        for name in ("manifests", "claims", "head"):
            self.folder.make(name)
        return self

    def manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests")

    def manifest(self, name: str) -> dict:
        return json.loads(self.folder.read(f"manifests/{name}.json"))

    def _head(self) -> tuple[int, str | None]:
        if not self.folder.exists("head"):
            raise StoreError("not a store")
        step = max(map(int, self.folder.names("head")), default=0)
        for _ in range(100):
            held = self.folder.read(f"head/{step:012}") if step else b"-"
            if held:
                return step, None if held == b"-" else held.decode()
            time.sleep(0.05)  # on stores without links a file is there before its content
        raise StoreError(f"head {step} was never written")

    @property
    def head(self) -> str | None:
        return self._head()[1]

    def _move(self, step: int, to: str | None) -> None:
        """Makes to the head if step is still the last step."""
        if not self.folder.create(f"head/{step + 1:012}", (to or "-").encode()):
            raise HeadMoved("the head moved meanwhile")

    def at(self, manifest: str | None = None) -> DataFrame:
        """Entries of a snapshot, the head by default: its base, but for the paths of its segments, and what these put."""
        manifest = manifest or self.head
        if manifest is None:
            return self.spark.createDataFrame([], ENTRY)
        if not self.folder.exists(f"manifests/{manifest}.json"):
            raise StoreError(f"no snapshot {manifest}")
        row = self.manifest(manifest)
        return self._state(row.get("base") or f"entries/manifest_id={manifest}", row.get("log") or [])

    def _state(self, base: str, log: list[dict]) -> DataFrame:
        held = self.spark.read.schema(ENTRY).parquet(f"{self.path}/{base}")
        if not log:
            return held
        last = self._folded(log)
        return held.join(last.select("path"), "path", "left_anti").unionByName(last.where("not gone").select(*FIELDS))

    def _folded(self, log: list[dict]) -> DataFrame:
        """One row a path of the segments: its last change, and whether the snapshot before the first of them has it."""
        out = None
        for i, x in enumerate(log):
            part = self.spark.read.schema(CHANGE).parquet(f"{self.path}/{x['at']}").withColumn("step", F.lit(i))
            out = part if out is None else out.unionByName(part)
        if len(log) == 1:
            return out.drop("step")
        rest = F.struct(*(c for c in FIELDS if c != "path"), "gone")
        return out.groupBy("path").agg(F.max_by(rest, "step").alias("x"), F.min_by("known", "step").alias("known")).select("path", "x.*", "known")

    def changed(self, manifest: str) -> DataFrame:
        """The paths that a snapshot put or took away (CHANGE); all of a first one's are put."""
        if not self.folder.exists(f"changes/manifest_id={manifest}"):
            none = F.lit(False)
            return self.at(manifest).withColumns({"gone": none, "known": none})
        return self.spark.read.schema(CHANGE).parquet(f"{self.path}/changes/manifest_id={manifest}")

    def commit(self, entries: DataFrame, kind: str, created_by: str = "", expected: str | None | object = ANY) -> str:
        """A snapshot of these entries on top of the head: compared with the head's, and what differs is written.

        expected: the head that entries were derived from; if it isn't the head any more, nothing is committed and HeadMoved
        is raised.  The head is also checked when it is moved, so no commit made meanwhile is ever overwritten.
        """
        entries = _typed(entries)

        def against(parent: str) -> DataFrame:
            old = self.at(parent).select(F.col("path").alias("was_path"), F.struct(*FIELDS).alias("was"))
            both = entries.select("path", F.struct(*FIELDS).alias("now")).join(old, F.col("path") == F.col("was_path"), "full_outer").where(~F.col("now").eqNullSafe(F.col("was")))
            gone = F.col("path").isNull()
            return both.select(F.coalesce("path", "was_path").alias("path"), *(F.col(f"now.{c}").alias(c) for c in FIELDS if c != "path"), gone.alias("gone"), F.col("was_path").isNotNull().alias("known"))

        return self._append(against, entries, kind, created_by, expected)

    def commit_changes(self, changes: DataFrame, kind: str, created_by: str = "", expected: str | None | object = ANY) -> str:
        """A snapshot that differs from the head in these paths (ENTRY and gone, one row a path); nothing else is read but their names."""
        changes = changes.select(*_columns(), F.coalesce("gone", F.lit(False)).alias("gone"))

        def against(parent: str) -> DataFrame:
            known = self.at(parent).select("path").withColumn("known", F.lit(True))
            found = changes.join(known, "path", "left").withColumn("known", F.coalesce("known", F.lit(False)))
            return found.where("known or not gone")

        return self._append(against, changes.where("not gone").select(*FIELDS), kind, created_by, expected)

    def _append(self, against: Callable[[str], DataFrame], whole: DataFrame, kind: str, created_by: str, expected) -> str:
        """against: the changes by the head they meet; whole: the entries where there is no head."""
        if kind not in KINDS:
            raise StoreError(f"kind {kind!r}")
        step, parent = self._head()
        if expected is not ANY and parent != expected:
            raise HeadMoved(f"the head is {parent}, not {expected}")
        seq = max((int(n[1:]) for n in self.folder.names("claims")), default=0) + 1
        while not self.folder.create(f"claims/M{seq}", b"x"):
            seq += 1
        new = f"M{seq}"
        base, log = f"entries/manifest_id={new}", []
        if parent is None:
            whole.write.mode("errorifexists").parquet(f"{self.path}/{base}")
            rows = n = self._count(base)
        else:
            before = self.manifest(parent)
            place = f"changes/manifest_id={new}"
            against(parent).select(*FIELDS, "gone", "known").write.mode("errorifexists").parquet(f"{self.path}/{place}")
            told = self.spark.read.schema(CHANGE).parquet(f"{self.path}/{place}").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(~F.col("known"), 1).when(F.col("gone"), -1).otherwise(0)), F.lit(0)).alias("more")).first()
            n, rows = before["entries"] + told["more"], before.get("base_rows", before["entries"])
            log = [*(before.get("log") or []), *([{"at": place, "rows": told["rows"]}] if told["rows"] else [])]
            held = before.get("base") or f"entries/manifest_id={parent}"
            if sum(x["rows"] for x in log) > LOG_SHARE * rows:
                self._state(held, log).write.mode("errorifexists").parquet(f"{self.path}/{base}")
                rows, log = self._count(base), []
            else:
                base, log = held, self._tiered(log)
        row = {"id": new, "seq": seq, "parent": parent, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), "created_by": created_by, "kind": kind, "entries": n, "base": base, "base_rows": rows, "log": log}
        self.folder.create(f"manifests/{new}.json", json.dumps(row).encode())
        self._move(step, new)
        return new

    def _count(self, base: str) -> int:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/{base}").count()

    def _tiered(self, log: list[dict]) -> list[dict]:
        """log, its last segments merged until each holds over twice the rows of the next."""
        cut, rows = len(log), 0
        while cut and (not rows or log[cut - 1]["rows"] <= 2 * rows):
            cut -= 1
            rows += log[cut]["rows"]
        if len(log) - cut < 2:
            return log
        place = f"segments/{uuid.uuid4().hex}"
        self._folded(log[cut:]).select(*FIELDS, "gone", "known").write.parquet(f"{self.path}/{place}")
        return [*log[:cut], {"at": place, "rows": self.spark.read.schema(CHANGE).parquet(f"{self.path}/{place}").count()}]

    def update(self, change: Callable[[DataFrame], DataFrame], kind: str, created_by: str = "", tries: int = 100) -> str:
        """Commits change(entries of the head), again from the new head whenever another writer was first."""
        return self._retried(lambda head: self.commit(change(self.at(head)), kind, created_by, head), tries)

    def amend(self, changes: Callable[[DataFrame], DataFrame], kind: str, created_by: str = "", tries: int = 100) -> str:
        """As update, with the changed paths only: changes(entries of the head) gives ENTRY and gone."""
        return self._retried(lambda head: self.commit_changes(changes(self.at(head)), kind, created_by, head), tries)

    def _retried(self, commit: Callable[[str | None], str], tries: int) -> str:
        for _ in range(tries):
            try:
                return commit(self.head)
            except HeadMoved:
                continue
        raise HeadMoved(f"others were first {tries} times")

    def history(self) -> DataFrame:
        """id, depth, parent, kind, created_by, created_at, entries from the head along parents, newest first."""
        return history(self.manifests(), self.head)

    def undo(self) -> str | None:
        """Moves the head to its parent; the undone snapshot stays readable."""
        step, head = self._head()
        if head is None:
            raise StoreError("nothing to undo")
        parent = self.manifest(head)["parent"]
        if parent is None:
            raise StoreError("the first snapshot can't be undone")
        self._move(step, parent)
        return parent

    def put_blobs(self, blobs: DataFrame) -> None:
        """blobs (blob, content): only unseen keys are written, each write in a folder of its own, so writers don't meet."""
        known = self.folder.exists("blobs")
        new = blobs.select("blob").distinct()
        if known:
            new = new.join(self.blobs().select("blob"), "blob", "left_anti")
        if not known or not new.isEmpty():  # quiet passes leave no files
            # contents are read and moved for the unseen keys only
            blobs.select("blob", "content").join(new, "blob", "left_semi").dropDuplicates(["blob"]).write.parquet(f"{self.path}/blobs/batch={uuid.uuid4().hex}")

    def blobs(self) -> DataFrame:
        """Rows by key; two writers that met may both have brought one key, with the same content."""
        return self.spark.read.schema(_BLOBS).parquet(f"{self.path}/blobs").select("blob", "content").dropDuplicates(["blob"])

    def has(self, wanted: DataFrame) -> DataFrame:
        """Those of the wanted (blob) that are stored."""
        if not self.folder.exists("blobs"):
            return wanted.select("blob").limit(0)
        return wanted.select("blob").distinct().join(self.spark.read.schema(_BLOBS).parquet(f"{self.path}/blobs").select("blob"), "blob", "left_semi")

    def contents(self, wanted: DataFrame) -> DataFrame:
        """blob, content of the wanted (blob): keys are looked up without contents, and only the writes that hold some are read."""
        if not self.folder.exists("blobs"):
            return self.spark.createDataFrame([], "blob string, content binary")
        held = self.spark.read.schema(_BLOBS).parquet(f"{self.path}/blobs")
        # names of writes: as many as there were commits, at most
        batches = [r[0] for r in held.select("blob", "batch").join(wanted.select("blob").distinct(), "blob", "left_semi").select("batch").distinct().collect()]
        return held.where(F.col("batch").isin(batches)).select("blob", "content").join(wanted.select("blob").distinct(), "blob", "left_semi").dropDuplicates(["blob"])


def history(manifests: DataFrame, head: str | None) -> DataFrame:
    """The parent chain from head, by doubling: after k rounds the nearest 2^k ancestors are known, and every row's 2^k-th.

    A chain of n commits takes about log2(n) rounds of two joins on narrow rows.
    """
    spark = manifests.sparkSession
    ups = written(manifests.where("parent is not null").select("id", F.col("parent").alias("up")), "parents")
    found, jump = spark.createDataFrame([(head, 0)] if head else [], "id string, depth long"), 1
    while True:
        more = found.join(ups, "id").select(F.col("up").alias("id"), (F.col("depth") + jump).alias("depth"))
        further = written(found.unionByName(more), "ancestors")
        # parents that aren't there, and rows left without one, end the chain
        n, grown = further.count(), 2 * jump
        if n < grown:
            break
        ahead = ups.select(F.col("id").alias("up"), F.col("up").alias("further"))
        twice = written(ups.join(ahead, "up").select("id", F.col("further").alias("up")), "parents")
        release(ups, found)
        ups, found, jump = twice, further, grown
    release(ups, found)
    rows = manifests.select("id", "parent", "kind", "created_by", "created_at", "entries").join(further, "id")
    return rows.select("id", F.col("depth").cast("int").alias("depth"), "parent", "kind", "created_by", "created_at", "entries").orderBy("depth")


def revert_plan(parent: DataFrame, undone: DataFrame) -> DataFrame:
    """action, path, from_path that undoing takes: moved back, restored, removed."""
    gone = parent.select("path", "blob").join(undone.select("path"), "path", "left_anti")
    extra = undone.select("path", "blob").join(parent.select("path"), "path", "left_anti")
    back = gone.join(extra.groupBy("blob").agg(F.min("path").alias("from_path")), "blob", "left")
    out = back.select(F.when(F.col("from_path").isNull(), "restored").otherwise("moved").alias("action"), "path", "from_path")
    return out.unionByName(extra.join(gone.select("blob").distinct(), "blob", "left_anti").select(F.lit("removed").alias("action"), "path", F.lit(None).cast("string").alias("from_path")))


def scan_rows(spark: SparkSession, path: str, skip: str = ".kb") -> DataFrame:
    """path, blob, size, mod_time, content of the files under path.

    Folders named skip are left out.  Spark's listing doesn't show files and folders whose names begin with a dot or an
    underscore; those are listed and read by a source of their own, and copied under visible names only where that has no
    access to the file system.
    """
    folder = Folder(spark, path)
    root = folder.bare()
    columns = ("path", "blob", "size", "mod_time", "content")

    def read(place: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(place)
        return files.select("path", content_hash("content").alias("blob"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content")

    below = F.lit(f"{root}/")
    files = read(path).withColumn("path", F.substring(F.col("path"), F.position(below, F.col("path")) + F.length(below), F.length("path")))
    files = files.where(~F.concat(F.lit("/"), "path").contains(f"/{skip}/")).select(*columns)
    uri = folder.qualified()
    if listing.known(uri):
        spark.dataSource.register(listing.HiddenFiles)
        more = spark.read.format(listing.HiddenFiles.name()).option("path", uri).option("skip", skip).option("tasks", spark.conf.get("spark.sql.shuffle.partitions")).load()
        return files.unionByName(more.withColumn("blob", content_hash("content")).select(*columns))
    copies, named = hidden_files(spark, path, skip)
    if named:
        names = spark.createDataFrame(named, "copy string, name string, at timestamp")
        more = read(copies).withColumn("copy", F.element_at(F.split("path", "/"), -1)).drop("path", "mod_time").join(names, "copy")
        files = files.unionByName(more.withColumnsRenamed({"name": "path", "at": "mod_time"}).select(*columns))
    return files


def _as_entries(rows: DataFrame) -> DataFrame:
    return rows.select("path", "blob", "size", "mod_time", F.array().cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("rule"))


def scan_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, blobs) of the files under path, labels and rules empty; blobs may hold a key more than once."""
    rows = scan_rows(spark, path)
    return _as_entries(rows), rows.select("blob", "content")


def take_in(store: Store, path: str) -> DataFrame:
    """Entries of the files under path, their unseen contents stored.

    Each file is read and hashed once: the scan is written, and entries and contents are taken from it.
    """
    rows = written(scan_rows(store.spark, path), "scan")
    store.put_blobs(rows)
    entries = written(_as_entries(rows), "scanned-entries")
    release(rows)
    return entries


def retain(head: DataFrame, entry: DataFrame) -> DataFrame:
    """head with the rows of entry put in place of those of the same path."""
    return head.join(entry.select("path"), "path", "left_anti").unionByName(entry, allowMissingColumns=True)


def contents_of_documents(docs: DataFrame) -> DataFrame:
    """The test tables' documents as path, blob, size, mod_time, text, doc_id: what needs no join."""
    ext = F.element_at(F.array(*map(F.lit, ("md", "txt", "log", "csv", "pdf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        "doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/doc-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("."), ext).alias("path"), F.concat(F.lit("s2:"), F.sha2(F.col("text").cast("binary"), 256)).alias("blob"),
        F.octet_length("text").cast("long").alias("size"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(doc_id * 37 % 7 as int))").alias("mod_time"), "text",
    )


def from_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The test tables as entries with text: path, blob, size, mod_time, labels, rule, text."""
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    named = F.filter(F.array(F.when(F.col("q") == 1, F.lit("good")), F.when(F.col("t") == 1, F.lit("toxic"))), lambda x: x.isNotNull())
    # hashes are made before the join, so that texts go through it only for those who want them
    narrow = contents_of_documents(docs)
    return narrow.join(marks, "doc_id", "left").select("path", "blob", "size", "mod_time", named.alias("labels"), F.lit(None).cast("string").alias("rule"), "text", "doc_id")
