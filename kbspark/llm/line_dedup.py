"""op 11: line dedup over levelled, sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys of ``LEAST_CHARS`` code points or more
count.  ``LineRuns`` holds what is known of keys (128-bit hash, number of documents, largest doc_id) in runs: immutable tables
dealt to buckets by hash and sorted by it, at most one a level.  A new batch of documents is brought to one row a key and
merge-anti-joined with the runs: a key that they know in enough documents, one of them of no smaller doc_id, adds nothing and
goes; all others are the batch's own run.  Where a level is taken, its run and the new one are merged to one of the next level
and so on, so n batches leave at most log2(n) + 1 runs and a key is rewritten log2(n) times.  Runs are bucketed tables, so
these joins shuffle the batch's keys but never the runs.  Which runs count is a numbered file that must not exist before; a run
that a lost driver hadn't entered yet is simply not there, and ``LineRuns`` opened on the same folder goes on.

``dedup_lines`` deals a table's lines to batches by doc_id, the largest first (later batches then find most of their frequent
keys settled), adds batch after batch, and drops the lines whose key ends with ``LEAST_DOCS`` documents or more, but for those
of the largest.  Keys are found again in (hash, doc_id) rows, written once; a hash at very many documents is a skewed join that
is split, and texts meet one row of hashes a document.  Equal 128-bit hashes are taken for equal keys.

Defined cases: null and empty texts are one empty line; lines end at \\n only; a line that repeats in one document is one document's; repeated rows
are one document and are treated alike, as are rows of one doc_id with unlike texts (a key of either is dropped from both);
rows without a doc_id count as no document and keep all lines; an empty table gives an empty result.  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.folder import Folder

from .common import materialize, new_path, release

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches of a table that is there as a whole.
BATCHES = 4
_BLANK = b" \t\n\x0b\x0c\r"
_RUN = "h binary, n long, last long"


def line_hash(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """Of the key of a line (UTF-8); None where it is too short to count."""
    key = line.strip(_BLANK).lower()  # bytes: A-Z only
    if len(key) < least or not key.isascii() and len(key.decode(errors="replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def _hashed(least: int):
    def run(batches):
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
            ids, found = [], []
            for doc, text in zip(docs, texts, strict=True):
                keys = {line_hash(x, least) for x in (text.as_py() or b"").split(b"\n")} - {None}
                found += keys
                ids += [doc] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.int64())], names=["h", "doc_id"])

    return run


def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """h, doc_id of the keys of each row; no shuffle."""
    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_hashed(least), "h binary, doc_id long")


class LineRuns:
    """Runs in a folder that all executors share; ``least`` documents settle a key."""

    def __init__(self, spark: SparkSession, path: str, least: int = LEAST_DOCS, buckets: int = 0):
        """buckets: of a folder that holds no runs yet; the number of shuffle partitions if 0."""
        self.spark, self.path, self.least = spark, path.rstrip("/"), least
        self.folder = Folder(spark, self.path)
        self.folder.make("steps")
        self.step = max((int(n) for n in self.folder.names("steps")), default=0)
        held = json.loads(self.folder.read(f"steps/{self.step:09}")) if self.step else {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": []}
        self.buckets = held["buckets"]
        self.runs: list[tuple[int, str]] = [(level, name) for level, name in held["runs"]]
        for _, name in self.runs:
            if not spark.catalog.tableExists(name):
                spark.sql(f"create table {name} ({_RUN}) using parquet clustered by (h) sorted by (h) into {self.buckets} buckets location '{self.path}/{name}'")

    def _write(self, rows: DataFrame) -> str:
        name = f"kb_run_{uuid.uuid4().hex}"
        rows.select("h", "n", "last").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def fresh(self, keys: DataFrame) -> DataFrame:
        """keys (h, n, last; one row a key) but for those that the runs know in enough documents, one of them of no smaller doc_id."""
        out = keys
        for i, (_, name) in enumerate(self.runs):  # each run has one row a key, so rows stay as they are
            out = out.join(self.spark.table(name).select("h", F.col("n").alias(f"n{i}"), F.col("last").alias(f"last{i}")), "h", "left")
        every = range(len(self.runs))
        if not every:
            return keys
        n, last = sum((F.coalesce(f"n{i}", F.lit(0)) for i in every), F.lit(0)), F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.col(f"last{i}") for i in every))
        return out.where((n < self.least) | last.isNull() | (last < F.col("last"))).select("h", "n", "last")

    def add(self, lines: DataFrame) -> None:
        """Takes in the lines (h, doc_id) of documents of which no row was added before."""
        keys = lines.groupBy("h").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        runs, gone = [*self.runs], []
        name = self._write(self.fresh(keys))
        level = 0
        while at := next((r for r in runs if r[0] == level), None):
            runs.remove(at)
            gone += [at[1], name]
            name = self._write(self._merged(at[1], name))
            level += 1
        runs.append((level, name))
        if not self.folder.create(f"steps/{self.step + 1:09}", json.dumps({"buckets": self.buckets, "runs": runs}).encode()):
            raise RuntimeError("another writer added a batch meanwhile")
        self.step, self.runs = self.step + 1, runs
        for old in gone:
            self._drop(old)

    def _merged(self, a: str, b: str) -> DataFrame:
        a, b = (self.spark.table(t).select("h", F.col("n").alias(f"n{i}"), F.col("last").alias(f"last{i}")) for i, t in enumerate((a, b)))
        return a.join(b, "h", "full_outer").select("h", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"), F.greatest("last0", "last1").alias("last"))

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self.folder.remove_all(name)

    def frequent(self) -> DataFrame:
        """h, last of the keys in enough documents."""
        if not self.runs:
            return self.spark.createDataFrame([], "h binary, last long")
        # read as plain files: a union of bucketed tables is taken for bucketed itself, though its buckets aren't read together
        out = self.spark.read.schema(_RUN).parquet(*(f"{self.path}/{name}" for _, name in self.runs))
        if len(self.runs) > 1:
            out = out.groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        return out.where(F.col("n") >= self.least).select("h", "last")

    def close(self) -> None:
        """Takes the runs away."""
        for _, name in self.runs:
            self._drop(name)
        self.folder.remove_all("")


def _kept(least: int, texts: bool):
    def run(batches):
        for batch in batches:
            docs, gone = batch.column("text").cast(pa.binary()), batch.column("gone")
            n, dropped, shas, left = [], [], [], []
            for text, held in zip(docs, gone, strict=True):
                text, out = text.as_py() or b"", 0
                n.append(text.count(b"\n") + 1)
                if held.is_valid:
                    drop = set(held.as_py())
                    lines = text.split(b"\n")
                    kept = [x for x in lines if line_hash(x, least) not in drop]
                    text, out = b"\n".join(kept), len(lines) - len(kept)
                dropped.append(out)
                shas.append(hashlib.sha256(text).hexdigest())
                if texts:
                    left.append(text.decode(errors="replace"))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.string())] if texts else columns, names=[*names, "kept_text"] if texts else names)

    return run


def _batched(docs: DataFrame, batches: int, least: int) -> DataFrame:
    """h, doc_id, batch: lines of the batches that split the doc_ids evenly, number 0 with the largest."""
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return line_hashes(docs, least).withColumn("batch", batch)


def dedup_lines(docs: DataFrame, texts: bool = True, batches: int = BATCHES, chars: int = LEAST_CHARS, least: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, with texts, kept_text of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = new_path(spark, "lines")
    _batched(docs, batches, chars).write.partitionBy("batch").parquet(place)
    lines = spark.read.schema("h binary, doc_id long, batch int").parquet(place)
    runs = LineRuns(spark, new_path(spark, "runs"), least)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).select("h", "doc_id"))
    frequent = materialize(runs.frequent(), "frequent-lines")
    runs.close()
    # both sides grow with the data, so neither is sent to all, however small it may be here
    gone = lines.select("h", "doc_id").join(frequent.hint("merge"), "h").where("doc_id < last").groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
    gone = materialize(gone, "dropped-lines")
    lines._kb_path = place
    release(lines, frequent)
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if texts else "")
    return docs.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_kept(chars, texts), schema)
