"""Continuous reconciliation: a clock stream whose batches compare the folder with the head.

What a pass holds back goes to a folder that a second, stateful stream reads: keys it has seen are in its state store, so each
item surfaces once, also after a restart from its checkpoint.  Nothing held back passes the driver but where it is printed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import dedup, drift, organize
from kbspark.policy import Policy
from kbspark.sources.durable import release, scratch, written
from kbspark.sources.effects import Effects
from kbspark.sources.snapshots import Store, take_in, taken_away
from kbspark.sources.vectors import EmbeddingError, VectorCache
from kbspark.sources.views import Views

SHOWN = "class string, path string"
#: Class of views that wait for a person.
ESCALATED = "escalated"
#: Contents embedded a tick.
EMBED = 32


@dataclass
class Summary:
    """Snapshots committed and what is held back (fresh: class, path); changes, ops and copies are the tables behind them."""

    absorbed: str | None = None
    applied: str | None = None
    deduped: str | None = None
    fresh: DataFrame | None = None
    changes: DataFrame | None = None
    ops: DataFrame | None = None
    held: DataFrame | None = None
    copies: DataFrame | None = None
    stalled: str = ""

    def listed(self) -> Iterator[tuple[str, str]]:
        """What is held back, plans before copies and escalated views, a partition at a time."""
        if self.fresh is not None:
            for r in self.fresh.orderBy(F.col("class").isin("copies", ESCALATED), "class", "path").toLocalIterator():
                yield r["class"], r["path"]

    @property
    def pending(self) -> list[tuple[str, str]]:
        """The same as a list, for reports."""
        return list(self.listed())

    def acted(self) -> bool:
        return bool(self.absorbed or self.applied or self.deduped or self.stalled)

    def empty(self) -> bool:
        return not self.acted() and (self.fresh is None or self.fresh.isEmpty())


def reconcile(store: Store, current: DataFrame, texts: DataFrame, policy: Policy, watching: bool = False, dry: bool = False, effects: Effects | None = None, shown: DataFrame | None = None) -> Summary:
    """Absorbs changes, applies the plan's allowed operations and collapses copies, each as a snapshot of its own; quiet passes commit nothing.

    One-shot runs act unless a rule says propose; watching acts only where it says auto and never collapses copies.  What no
    rule matches is labelled unsorted in any case.  A dry run commits nothing; each of its stages sees what the one before
    would have left.  Where effects are given, files follow the moves and removals, before they are committed.  What is held
    back is listed whole, but for what shown (class, path) has already.  A commit made meanwhile raises HeadMoved.
    """
    out, at = Summary(), store.head
    head = store.at(at)
    out.changes = written(drift.changes(head, current), "changes")
    if not out.changes.isEmpty():
        absorbed = drift.absorb(head, current)
        if dry:
            head = written(absorbed, "absorbed")
        else:
            out.absorbed = at = store.commit(absorbed, "observe", "reconcile", at)
            head = store.at(at)
    planned = written(organize.plan(head.join(texts, "path", "left"), policy), "planned")
    allowed = [r.name for r in policy.rules if (r.autonomy == "auto" if watching else r.autonomy != "propose")]
    acts = F.col("class").isin("move", "label") & F.col("rule").isin(allowed) | (F.col("class") == "unsorted")
    out.ops, out.held = planned.where(acts), planned.where(~acts)
    fresh = out.held.select("class", "path")
    if not out.ops.isEmpty():
        if dry:
            head = written(organize.apply(head, out.ops), "applied")
        else:
            if effects:
                effects.move(out.ops.where("class = 'move'").select("path", "to"))
            out.applied = at = store.commit_changes(organize.edits(head, out.ops), "mutate", "reconcile", at)
            head = store.at(at)
    out.copies = written(dedup.members(head, policy.dedup.strategy or "keep-oldest"), "copies")
    if watching:
        fresh = fresh.unionByName(out.copies.select(F.lit("copies").alias("class"), F.col("blob").alias("path")).distinct())
    elif not dry and not (gone := dedup.removed(out.copies)).isEmpty():
        if effects:
            effects.collapse(dedup.kept(out.copies).select(F.col("keep").alias("path")), gone)
        out.deduped = store.commit_changes(taken_away(gone), "mutate", "reconcile", at)
    out.fresh = fresh if shown is None else fresh.join(shown, ["class", "path"], "left_anti")
    return out


def rendered(got: Summary) -> Iterator[str]:
    """A line for a person about each thing done, then each thing held back."""
    effect = F.when(F.col("class") == "move", F.concat(F.lit("→ "), "to")).otherwise(F.concat(F.lit("+"), F.array_join("labels", ",")))
    if got.absorbed:
        for r in got.changes.orderBy("path", "kind").toLocalIterator():
            yield f"absorbed {r['kind']} {r['path']}"
    if got.applied:
        for r in got.ops.select("path", effect.alias("effect"), "rule").orderBy("path", "effect").toLocalIterator():
            yield f"applied {r['path']} {r['effect']}" + (f" ({r['rule']})" if r["rule"] else "")
    says = {"move": "PROPOSED {}: a reconcile would apply it", "label": "PROPOSED {}: a reconcile would apply it", "pinned": "PINNED {}: a person moved it", "conflict": "CONFLICT {}", "copies": "COPIES of {}: a dedup would collapse them", ESCALATED: "ESCALATED view {}: a person has to resolve it"}
    for kind, path in got.listed():
        yield says.get(kind, kind + " {}").format(path)
    if got.stalled:
        yield f"embedding stalled ({got.stalled}); it goes on when the endpoint does"


class Surfacing:
    """Items (class, path) that come out once: appended to a folder, read by a stream that keeps the keys it has seen as state.

    The state and what has been read are in the stream's checkpoint, so another run on the same folder goes on from there.  A
    batch counts as read when deliver has returned.  One run at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.last: tuple | None = None
        spark.createDataFrame([], SHOWN).write.mode("append").parquet(f"{path}/held")

    def offer(self, items: DataFrame, deliver: Callable[[DataFrame], None]) -> None:
        """Gives deliver those of items that were never delivered; not called where there are none.  Items that are the last offer's are left alone."""
        digest = items.agg(F.count(F.lit(1)), F.sum(F.xxhash64("class", "path").cast("decimal(38,0)"))).first()
        if tuple(digest) == self.last:
            return
        if digest[0]:
            items.select("class", "path").write.mode("append").parquet(f"{self.path}/held")

        def batch(rows: DataFrame, _: int) -> None:
            fresh = written(rows, "surfaced")
            if not fresh.isEmpty():
                deliver(fresh)
            release(fresh)

        # a batch that failed before it was delivered is run again, whatever this offer brought
        stream = self.spark.readStream.schema(SHOWN).parquet(f"{self.path}/held").dropDuplicates(["class", "path"])
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.path}/seen").trigger(availableNow=True).start().awaitTermination()
        self.last = tuple(digest)


def watch(spark: SparkSession, store: Store, folder: str, policy: Policy, on_pass: Callable[[Summary], None], interval: str = "2 seconds", on_head: Callable[[str], None] | None = None, cache: VectorCache | None = None, texts_of: Callable[[DataFrame], DataFrame] | None = None, views: Views | None = None):
    """A running query; each tick reads the whole folder, since file streams miss edits and deletions.

    What was shown once isn't shown again, also by a later watch of the store; that includes views (of views) that are escalated.
    on_head gets the head when it moved, to index it anew; with cache, each tick embeds at most EMBED pending contents of
    texts_of(head), and a failing endpoint is reported once and tried again.
    """
    effects = Effects(spark, folder)
    surfacing = Surfacing(spark, f"{store.path}/shown")
    last = {"head": None, "stalled": ""}

    def tick(_: DataFrame, __: int) -> None:
        with scratch(spark):
            entries = take_in(store, folder)
            cut = F.col("content").cast("string")
            texts = entries.select("path", "blob").join(store.blobs(), "blob").select("path", F.when(F.is_valid_utf8(cut), cut).alias("text"))
            got = reconcile(store, entries, texts, policy, watching=True, effects=effects)
            head = store.head
            if head != last["head"]:
                if on_head and head:
                    on_head(head)
                last["head"] = head
            if cache and texts_of and head:
                try:
                    cache.drain(texts_of(store.at(head)), EMBED)
                    last["stalled"] = ""
                except EmbeddingError as e:
                    got.stalled = "" if str(e) == last["stalled"] else str(e)
                    last["stalled"] = str(e)
            # one state file a view, few next to the files
            waiting = [(ESCALATED, f"{s.name} ({s.touched})") for s in views.all() if s.state == "ESCALATED"] if views else []
            held, got.fresh, told = got.fresh.unionByName(spark.createDataFrame(waiting, SHOWN)), None, []

            def deliver(fresh: DataFrame) -> None:
                got.fresh = fresh
                on_pass(got)
                told.append(True)

            surfacing.offer(held, deliver)
            if not told and got.acted():
                on_pass(got)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).trigger(processingTime=interval).start()
