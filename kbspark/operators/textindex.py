"""A stored text index that follows a collection from state to state: segments of contents and of entries.

Contents are indexed once, by hash, whatever paths they stand at; entries (paths, labels) without their texts.  A new state adds a
segment with the contents that no segment has, and one with the entries that changed, and names the paths that these replace
or take away; those paths' rows in earlier segments are dead.  Segments shrink at least by half from one to the next; where a new one
breaks that, the last ones are merged; postings are copied as they are where at most half of them are of dead rows, which count for
nothing, and else those are left out.  So a state of n new contents reads n texts, and a query meets a
logarithmic number of segments.  States are named; what makes one is a file that must not exist before, and segments that no kept state names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.search import DOC, POSTING, Index, head_postings, text_postings, write_postings
from kbspark.sources.durable import release, written
from kbspark.sources.folder import Folder

_SIZES = "blob string, n int"


def tail(rows: list[int]) -> int:
    """Where the segments to be merged begin, so that each left holds over twice the rows of the next; the number of segments if none are."""
    cut, held = len(rows), 0
    while cut and (not held or rows[cut - 1] <= 2 * held):
        cut -= 1
        held += rows[cut]
    return cut if len(rows) - cut > 1 else len(rows)


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def has(self, name: str) -> bool:
        return self.folder.exists(f"states/{name}.json")

    def _state(self, name: str | None) -> dict:
        return json.loads(self.folder.read(f"states/{name}.json")) if name and self.has(name) else {"texts": [], "heads": []}

    def _read(self, segments: list[dict], name: str, schema: str) -> DataFrame:
        places = [f"{self.path}/{x['at']}/{name}" for x in segments]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _live(self, heads: list[dict]) -> DataFrame:
        """The rows of docs that no later segment replaces; later segments are small next to the first."""
        out = self._read(heads[-1:], "docs", DOC)
        for i in range(len(heads) - 2, -1, -1):
            out = out.unionByName(self._read(heads[i : i + 1], "docs", DOC).join(self._read(heads[i + 1 :], "paths", "path string").distinct(), "path", "left_anti"))
        return out

    def open(self, name: str) -> Index:
        state = self._state(name)
        return Index(self._live(state["heads"]), self._read(state["heads"], "postings", POSTING), self._read(state["texts"], "postings", POSTING))

    def update(self, name: str, entries: DataFrame, contents: Callable[[DataFrame], DataFrame], before: str | None = None, changes: DataFrame | None = None) -> dict:
        """Makes the state name of entries (path, blob, labels) from the state before; gives the numbers of texts and of entries indexed for it.

        contents: blob, text of the blobs that it is given.  changes (path, blob, labels, gone): what differs from the state
        before, if known; else entries are compared with it.
        """
        if self.has(name):
            return {"texts": 0, "entries": 0}
        state = self._state(before)
        if changes is None or not (before and self.has(before)):
            live = self._live(state["heads"]).select(F.col("path").alias("was"), F.struct("blob", "labels").alias("old"))
            both = entries.select("path", F.struct("blob", "labels").alias("now")).join(live, F.col("path") == F.col("was"), "full_outer").where(~F.col("now").eqNullSafe(F.col("old")))
            changes = both.select(F.coalesce("path", "was").alias("path"), "now.blob", "now.labels", F.col("path").isNull().alias("gone"))
        changed = written(changes.select("path", "blob", F.col("labels").cast("array<string>").alias("labels"), "gone"), "changed-entries")
        new = changed.where("not gone and blob is not null").select("blob").distinct().join(self._read(state["texts"], "sizes", _SIZES).select("blob"), "blob", "left_anti")
        new = written(new, "new-contents")
        told = {"texts": new.count(), "entries": changed.where("not gone").count()}
        texts, heads = list(state["texts"]), list(state["heads"])
        if told["texts"]:
            texts.append({"at": f"contents/{uuid.uuid4().hex}", "rows": told["texts"]})
            text_postings(new.join(contents(new), "blob", "left").select("blob", "text"), f"{self.path}/{texts[-1]['at']}")
        if rows := changed.count():
            segment = uuid.uuid4().hex
            heads.append({"at": f"heads/{segment}", "rows": rows})
            head_postings(changed.where("not gone").select("path", "blob", "labels"), self._read(texts, "sizes", _SIZES), segment, f"{self.path}/heads/{segment}")
            changed.select("path").write.parquet(f"{self.path}/heads/{segment}/paths")
        heads = self._merged_heads(heads)
        state = {"texts": self._merged_texts(texts, heads), "heads": heads}
        release(changed, new)
        self.folder.make("states")
        self.folder.create(f"states/{name}.json", json.dumps(state).encode())  # if another was first, its state is the same
        return told

    def _copy(self, old: list[dict], place: str, live: DataFrame) -> bool:
        """Writes the postings of segments into one; whether with those of rows that live hasn't."""
        rows = self._read(old, "postings", POSTING)
        every = rows.where("token = ''").agg(F.sum(F.size("found"))).first()[0] or 0
        whole = every <= 2 * live.count()
        if not whole:
            key = live.select(F.col(live.columns[0]).alias("of"))
            rows = rows.select("token", F.inline("found")).join(key, "of", "left_semi").select("token", F.array(F.struct("of", "at")).alias("found"))
            rows = rows.sortWithinPartitions("token")
        write_postings(rows, f"{self.path}/{place}/postings")
        return whole

    def _merged_heads(self, heads: list[dict]) -> list[dict]:
        cut = tail([x["rows"] for x in heads])
        if cut == len(heads):
            return heads
        old, place = heads[cut:], f"heads/{uuid.uuid4().hex}"
        docs = written(self._live(old), "live-docs")
        docs.write.parquet(f"{self.path}/{place}/docs")
        self._copy(old, place, docs.select("doc"))
        paths = self._read(old, "paths", "path string").distinct() if cut else docs.select("path")
        paths.write.parquet(f"{self.path}/{place}/paths")
        rows = self._read([{"at": place}], "paths", "path string").count()
        release(docs)
        return [*heads[:cut], {"at": place, "rows": rows}]

    def _merged_texts(self, texts: list[dict], heads: list[dict]) -> list[dict]:
        cut = tail([x["rows"] for x in texts])
        if cut == len(texts):
            return texts
        old, place = texts[cut:], f"contents/{uuid.uuid4().hex}"
        # contents that no path of this state holds any more
        live, held = self._live(heads).select("blob").distinct(), self._read(old, "sizes", _SIZES)
        kept = written(held.join(live, "blob", "left_semi"), "live-contents")
        kept = held if self._copy(old, place, kept.select("blob")) else kept
        kept.write.parquet(f"{self.path}/{place}/sizes")
        sizes = self._read([{"at": place}], "sizes", _SIZES)
        return [*texts[:cut], {"at": place, "rows": sizes.count()}]

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.folder.names("states")]

    def prune(self, keep: set[str | None]) -> None:
        """Removes all states but those of keep, and the segments that none of these names."""
        for name in set(self.names()) - keep:
            self.folder.remove_all(f"states/{name}.json")
        used = {x["at"] for name in self.names() for part in self._state(name).values() for x in part}
        for kind in ("contents", "heads"):
            for segment in self.folder.names(kind):
                if f"{kind}/{segment}" not in used:
                    self.folder.remove_all(f"{kind}/{segment}")
