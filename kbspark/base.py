"""A knowledge base: a folder of files, its snapshots under ``.kb/`` and the operations on both.

Each method is one operation of the engine and returns plain rows or a DataFrame; the command line, the HTTP service and the
tool service are thin layers over the same methods (``OPERATIONS``).  Only reports come to the driver: hits, packs, history and
plan rows; snapshots, texts and vectors stay in Spark.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import policy as P
from kbspark.functions import paths
from kbspark.operators import dedup, drift, merge, organize, recall, search
from kbspark.operators.textindex import IndexStore
from kbspark.sources import export, sinks, snapshots, transcripts
from kbspark.sources.durable import release, written
from kbspark.sources.effects import Effects
from kbspark.sources.folder import Folder
from kbspark.sources.vectors import EmbeddingError, VectorCache
from kbspark.sources.views import State, Views
from kbspark.streaming import watch

MODES = ("fts", "vector", "hybrid")
#: Bytes of a file that text search reads; blobs embedded right after a commit.
TEXT_LIMIT, INLINE = 256 << 10, 64


class KbError(ValueError):
    pass


def memory_path(content: bytes, day: datetime.date | None = None) -> str:
    day = day or datetime.datetime.now(datetime.UTC).date()
    return f"memory/{day:%Y/%m/%d}/{hashlib.sha256(content).hexdigest()[:8]}.md"


def safe(path: str) -> str:
    parts = path.split("/")
    if not path or path.startswith("/") or ".." in parts or parts[0] == ".kb":
        raise KbError(f"not a path inside the collection: {path!r}")
    return paths.clean_literal(path)


def _plain(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, embedder=None):
        self.spark, self.root, self.embedder = spark, root.rstrip("/"), embedder
        self.folder, self.store = Folder(spark, self.root), snapshots.Store(spark, f"{self.root}/.kb/store")
        self.effects = Effects(spark, self.root)
        self._views = Views(spark, f"{self.root}/.kb/views")
        self.failed_sinks: list[str] = []
        self.failed_embedding = ""
        if not self.folder.exists(".kb"):
            raise KbError(f"no knowledge base at {root}")

    @classmethod
    def init(cls, spark: SparkSession, root: str) -> KnowledgeBase:
        if Folder(spark, root).exists(".kb"):
            raise KbError(f"{root} is a knowledge base already")
        snapshots.Store(spark, f"{root.rstrip('/')}/.kb/store").init()
        return cls(spark, root)

    @classmethod
    def resolve(cls, spark: SparkSession, start: str | None = None) -> KnowledgeBase:
        """The one named, or else the nearest at or above the working folder."""
        if start:
            return cls(spark, start)
        here = Path.cwd()
        for p in (here, *here.parents):
            if (p / ".kb").is_dir():
                return cls(spark, str(p))
        raise KbError("no knowledge base here or above")

    # --- parts -----------------------------------------------------------------------------------------------------

    def policy(self) -> P.Policy:
        return P.load(self.folder.read(".kb/policy.toml").decode()) if self.folder.exists(".kb/policy.toml") else P.Policy()

    def _lenient(self) -> P.Policy:
        """Reading goes on with an invalid policy; organizing doesn't."""
        try:
            return self.policy()
        except P.PolicyError:
            return P.Policy()

    def _cache(self) -> VectorCache:
        return VectorCache(self.spark, f"{self.root}/.kb/vectors", self._lenient().retrieval, self.embedder)

    def _texts(self, entries: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
        """entries with text, null where the first limit bytes aren't UTF-8."""
        cut = F.substring("content", 1, limit).cast("string")
        return entries.join(self.store.blobs().withColumn("text", F.when(F.is_valid_utf8(cut), cut)).drop("content"), "blob", "left")

    def _current(self) -> DataFrame:
        """The folder's entries; each file is read and hashed once, so entries and contents are of one moment."""
        return snapshots.take_in(self.store, self.root)

    def _done(self, manifest: str, kind: str, by: str) -> str:
        """Fires the sinks and embeds a bounded number of new blobs where the policy searches by vector."""
        pol = self._lenient()
        head = self.store.at(manifest)
        if pol.sinks:
            self.failed_sinks = sinks.fire(pol.sinks, sinks.Event(sinks.COMMITTED, self.root, manifest, kind, by, head.count()))
        if pol.retrieval.mode in ("vector", "hybrid"):
            try:
                self._cache().drain(self._texts(head), INLINE)
            except EmbeddingError as e:  # the commit stands; what is left is embedded later
                self.failed_embedding = str(e)
        return manifest

    def _commit(self, entries: DataFrame, kind: str, by: str, expected=snapshots.ANY) -> str:
        """expected: the head that entries were derived from."""
        return self._done(self.store.commit(entries, kind, by, expected), kind, by)

    def _amend(self, changes: DataFrame, kind: str, by: str, expected=snapshots.ANY) -> str:
        """As _commit, from the changed paths only."""
        return self._done(self.store.commit_changes(changes, kind, by, expected), kind, by)

    # --- operations ------------------------------------------------------------------------------------------------

    def scan(self, dry: bool = False) -> dict:
        """The folder as it is; labels and rules of the head aren't carried (reconcile carries them)."""
        if dry:
            return {"files": snapshots.scan_folder(self.spark, self.root)[0].count(), "manifest": None}
        entries = self._current()
        return {"files": entries.count(), "manifest": self._commit(entries, "observe", "scan")}

    def search(self, query: str, mode: str = "", limit: int = 20) -> DataFrame:
        """path, score, rank."""
        settings = self._lenient().retrieval
        mode = mode or settings.mode or "fts"
        if mode not in MODES:
            raise KbError(f"mode {mode!r}; one of {', '.join(MODES)}")
        limit = limit if limit > 0 else 20
        tuned, at = settings.tuning(), self.store.head
        head = self.store.at(at)
        pool = limit * tuned["candidate_factor"] if mode == "hybrid" else limit
        found = []
        if mode != "vector":
            found.append(search.full_text(self.index(at), query, pool))
        if mode != "fts":
            cache = self._cache()
            found.append(search.vector(cache.chunks_of(head), cache.query(query), pool))
        return search.fuse(*found, k=tuned["rrf_k"], limit=limit) if mode == "hybrid" else found[0]

    def _contents(self, blobs: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
        """blob, text of these blobs only, null where the first limit bytes aren't UTF-8."""
        cut = F.substring("content", 1, limit).cast("string")
        return self.store.contents(blobs).select("blob", F.when(F.is_valid_utf8(cut), cut).alias("text"))

    def index(self, manifest: str | None) -> search.Index:
        """The stored index of a snapshot, made from its parent's when it is first asked for: only new contents are read."""
        if manifest is None:
            return search.indexed(self._texts(self.store.at()))
        held = IndexStore(self.spark, f"{self.root}/.kb/index")
        if not held.has(manifest):
            parent = self.store.manifest(manifest)["parent"]
            if parent and held.has(parent):
                held.update(manifest, self.store.at(manifest), self._contents, parent, self.store.changed(manifest))
            else:  # from the latest there is; entries are compared
                held.update(manifest, self.store.at(manifest), self._contents, max(held.names(), key=lambda n: int(n[1:]), default=None))
            held.prune({manifest, parent})
        return held.open(manifest)

    def watch(self, on_pass, interval: str = "2 seconds"):
        """A running loop that absorbs, organizes, indexes and, where the policy searches by vector, embeds."""
        pol = self.policy()
        cache = self._cache() if pol.retrieval.mode in ("vector", "hybrid") else None
        return watch.watch(self.spark, self.store, self.root, pol, on_pass, interval, self.index, cache, self._texts, self._views)

    def find(self, query: str, mode: str = "", limit: int = 20) -> list[dict]:
        hits = self.search(query, mode, limit).select("path", "score", "rank")
        return _plain(hits.join(self.store.at().select("path", "blob", "labels"), "path").orderBy("rank"))

    def recall(self, query: str, mode: str = "", budget: int = recall.BUDGET) -> dict:
        head = self.store.head or ""
        found = self.search(query, mode, recall.CANDIDATES).select("path", "score", "rank")
        items = recall.pack(found, self._texts(self.store.at()), query, budget, head)
        budget = budget if budget > 0 else recall.BUDGET
        return {"query": query, "budget": budget, "used": sum(len(x["content"].encode()) for x in items) // recall.CHARS, "manifest": head, "items": items}

    def retain(self, content: str | bytes, path: str = "", day: datetime.date | None = None, transcript: bool = False) -> dict:
        """Writes one file and commits exactly that change."""
        data = content.encode() if isinstance(content, str) else content
        if transcript:
            lines = self.spark.createDataFrame([(i, x) for i, x in enumerate(data.decode(errors="replace").splitlines())], "seq long, value string")
            data = (transcripts.render(lines).first()["md"] or "").encode()
        if not data:
            raise KbError("nothing to retain")
        name = safe(path or memory_path(data, day))
        self.folder.write(name, data)
        size, seconds = self.folder.facts(name)
        blob = "s2:" + hashlib.sha256(data).hexdigest()
        self.store.put_blobs(self.spark.createDataFrame([(blob, bytearray(data))], "blob string, content binary"))
        row = self.spark.createDataFrame([(name, blob, size, datetime.datetime.fromtimestamp(seconds, datetime.UTC), [], None)], snapshots.ENTRY)
        return {"path": name, "manifest": self._done(self.store.amend(lambda head: row.withColumn("gone", F.lit(False)), "mutate", "retain"), "mutate", "retain")}

    def embed(self, most: int | None = None) -> dict:
        texts, cache = self._texts(self.store.at()), self._cache()
        cache.drain(texts, most)
        return {"pending": cache.pending(texts).count()}

    def export(self, filter: str = "", at: str = "", to: str = "") -> list[dict] | dict:
        """Records of a snapshot in path order; written as JSON lines where a place is named."""
        manifest = at or self.store.head or ""
        entries = self._texts(self.store.at(manifest or None), export.TEXT_LIMIT)
        rows = export.records(entries, manifest, filter.split())
        if to:
            export.write(rows, to)
            return {"to": to, "manifest": manifest}
        return list(self.exported(rows))

    @staticmethod
    def exported(rows: DataFrame) -> Iterator[dict]:
        """Records in path order, a partition at a time."""
        for r in export.lines(rows).toLocalIterator():
            yield json.loads(r["value"])

    def _planned(self) -> DataFrame:
        return organize.plan(self._texts(self.store.at(), P.CONTENT_LIMIT), self.policy())

    def org(self, apply: bool = False) -> dict:
        """The policy's plan for the head; with apply the files move, then the new state is committed."""
        at = self.store.head
        planned = self._planned()
        out: dict = {"ops": _plain(planned.orderBy("path", "class")), "manifest": None}
        if apply and not planned.where("class in ('move', 'label', 'unsorted')").isEmpty():
            self._move(planned)
            out["manifest"] = self._amend(organize.edits(self.store.at(at), planned), "mutate", "org", at)
        return out

    def _move(self, planned: DataFrame) -> None:
        self.effects.move(planned.where("class = 'move'").select("path", "to"))

    def dedup(self, apply: bool = False) -> dict:
        at = self.store.head
        rows = dedup.members(self.store.at(at), self._lenient().dedup.strategy or "keep-oldest")
        out: dict = {"groups": _plain(dedup.grouped(rows).orderBy("blob")), "manifest": None}
        gone = dedup.removed(rows)
        if apply and not gone.isEmpty():
            self.effects.collapse(dedup.kept(rows).select(F.col("keep").alias("path")), gone)
            out["manifest"] = self._amend(snapshots.taken_away(gone), "mutate", "dedup", at)
        return out

    def drift(self) -> dict:
        """Changes of the folder against the head, and what the policy and dedup would do after absorbing them; no commit."""
        now = self._current()
        got = self._reconciled(now, dry=True)
        return {"changes": _plain(drift.changes(self.store.at(), now).orderBy("path", "kind")), "ops": _plain(got.ops.orderBy("path", "class")), "pending": got.pending, "copies": _plain(dedup.grouped(got.copies).orderBy("blob"))}

    def _reconciled(self, now: DataFrame, dry: bool) -> watch.Summary:
        return watch.reconcile(self.store, now, self._texts(now, P.CONTENT_LIMIT).select("path", "text"), self.policy(), dry=dry, effects=self.effects)

    def reconcile(self, apply: bool = False) -> dict:
        """Absorbs, organizes and collapses; without apply, what that would do, one stage after the other, and nothing is changed."""
        if not apply:
            return self.drift()
        got = self._reconciled(self._current(), dry=False)
        for m, kind in ((got.absorbed, "observe"), (got.applied, "mutate"), (got.deduped, "mutate")):
            if m:
                self._done(m, kind, "reconcile")
        return {"absorbed": got.absorbed, "applied": got.applied, "deduped": got.deduped, "pending": got.pending}

    def log(self) -> list[dict]:
        """id, depth, parent, kind, created_by, created_at and the number of entries, newest first."""
        return _plain(self.store.history())

    def undo(self) -> dict:
        """The head goes back to its parent; files follow where the undone snapshot had changed them."""
        head = self.store.head
        kind = self.store.manifest(head)["kind"] if head else None
        undone, back = self.store.at(), self.store.undo()
        before = self.store.at()
        if kind == "mutate":
            plan = written(snapshots.revert_plan(before, undone), "revert")
            # one file can go back to one place; further places of its content are restored from the blobs
            moved = plan.where("action = 'moved'").groupBy("from_path").agg(F.min("path").alias("to")).select(F.col("from_path").alias("path"), "to")
            self.effects.move(moved, missing_ok=True)
            lost = plan.where("action in ('restored', 'moved')").join(before.select("path", "blob"), "path")
            self.effects.restore(lost.join(self.store.contents(lost.select("blob")), "blob"))
            self.effects.remove(plan.where("action = 'removed'").join(undone.select("path", "blob"), "path"))
            release(plan)
        return {"manifest": back}

    def rules(self) -> list[dict]:
        return [asdict(r) for r in self.policy().rules]

    # --- views -----------------------------------------------------------------------------------------------------

    def _view(self, state: State) -> merge.View:
        """A view with its operations, for people; tables are read instead where it is merged."""
        ops = (merge.Op(r["path"], r["to"] or "", tuple(r["labels"] or ()), r["rule"] or "") for r in self._views.ops(state).orderBy("seq").collect())
        return merge.View(state.name, state.base, state.state, tuple(ops) if state.open else (), state.conflict)

    def _state(self, name: str) -> State:
        found = self._views.get(name)
        if found is None:
            raise KbError(f"no view {name!r}")
        return found

    def views(self) -> list[merge.View]:
        """The latest state of each view, the last touched first."""
        return [self._view(s) for s in self._views.all()]

    def view(self, name: str) -> merge.View:
        return self._view(self._state(name))

    def work_create(self, name: str) -> merge.View:
        head = self.store.head
        if not head:
            raise KbError("nothing is scanned yet")

        def fresh(now: State | None) -> State:
            if now and now.open:
                raise KbError(f"{name!r} is open already")
            return State(name, head)

        return self._view(self._views.change(name, fresh))

    def work_stage(self, name: str, ops: list[merge.Op] | DataFrame) -> merge.View:
        """ops: a list, or a table (seq, path, to, labels, rule) of any size."""
        table = merge.table_of(self.spark, ops) if isinstance(ops, list) else ops
        self._state(name).moved("STAGED")
        held = self._views.put(table)
        checked = set()

        def staged(now: State) -> State:
            if now.base not in checked:  # the view may have been merged meanwhile, and go on from another base
                merge.checked(table, self.store.at(now.base))
                checked.add(now.base)
            return now.moved("STAGED", tables=(*now.tables, held))

        new = self._views.change(name, staged)
        return self._view(new) if isinstance(ops, list) else merge.View(name, new.base, new.state)

    def work_abort(self, name: str) -> merge.View:
        self._state(name)
        return self._view(self._views.change(name, lambda now: now.moved("ABORTED", tables=(), conflict="")))

    def work_merge_table(self, name: str, ranked: bool = True) -> tuple[State, DataFrame, DataFrame, DataFrame]:
        """(state, operations, outcome, moves), all but the state as tables.

        Files of applied moves follow, then the new state is committed; what is held stays in the view, which goes on from the new head.
        """
        return self._merged(self._state(name), self.policy().rank() if ranked else None)

    def _merged(self, view: State, rank: dict[str, int] | None, base: str | None = None) -> tuple[State, DataFrame, DataFrame, DataFrame]:
        view.moved("MERGED")
        at, ops = self.store.head, self._views.ops(view)
        new, outcome, moves = merge.merge_table(ops, self.store.at(base or view.base), self.store.at(at), rank)
        outcome = written(outcome, "verdicts")
        if not outcome.where("status = 'applied'").isEmpty():
            self.effects.move(moves)
            self._commit(new, "mutate", f"merge/{view.name}", at)
        held = ops.join(outcome.where("status = 'held'"), "seq")
        count = held.count()
        reasons = "; ".join(r["reason"] for r in held.orderBy("seq").limit(20).collect())
        left = (self._views.put(held),) if count else ()

        def settled(now: State) -> State:
            if not now.open:
                return now
            later = tuple(t for t in now.tables if t not in view.tables)  # staged while this was merged
            state = now.moved("ESCALATED" if count else "MERGED")
            return replace(state, state="STAGED" if later and not count else state.state, tables=(*left, *later), conflict=reasons, base=(self.store.head or "") if count or later else now.base)

        return self._views.change(view.name, settled), ops, outcome, moves

    def work_merge(self, name: str, ranked: bool = True) -> tuple[merge.View, merge.Outcome]:
        """As work_merge_table, listed for people."""
        state, ops, outcome, moves = self.work_merge_table(name, ranked)
        return self._view(state), merge.Outcome.listed(ops, outcome, moves)

    def work_resolve(self, name: str, mine: bool) -> merge.View:
        """Of an escalated view.  theirs: it is given up; mine: merged again, from the head as its base and without ranks; it may stay escalated."""
        state = self._state(name)
        if state.state != "ESCALATED":
            raise ValueError(f"{name} is {state.state}, not ESCALATED")
        return self._view(self._merged(state, None, self.store.head)[0]) if mine else self.work_abort(name)


#: name -> (method, what it does, parameters and their types, whether it changes anything); the services offer these.
OPERATIONS = {
    "find": (KnowledgeBase.find, "Ranked search: full text, vector or hybrid.", {"query": str, "mode": str, "limit": int}, False),
    "recall": (KnowledgeBase.recall, "A context pack of at most budget tokens for a query.", {"query": str, "mode": str, "budget": int}, False),
    "retain": (KnowledgeBase.retain, "Keeps a text as a file, below memory/ by default.", {"content": str, "path": str}, True),
    "drift": (KnowledgeBase.drift, "What differs from the head and from the policy.", {}, False),
    "log": (KnowledgeBase.log, "History, newest first.", {}, False),
    "export": (KnowledgeBase.export, "Records of a snapshot, filtered.", {"filter": str, "at": str}, False),
    "org": (KnowledgeBase.org, "The policy's plan; commits it with apply.", {"apply": bool}, True),
    "reconcile": (KnowledgeBase.reconcile, "Folds in changes and converges to the policy; a preview without apply.", {"apply": bool}, True),
    "undo": (KnowledgeBase.undo, "Takes the last commit back.", {}, True),
}
REQUIRED = {"find": ("query",), "recall": ("query",), "retain": ("content",)}


def call(kb: KnowledgeBase, name: str, arguments: dict):
    """The operation's result; unknown names, unknown, missing and ill-typed arguments raise KbError."""
    if name not in OPERATIONS:
        raise KbError(f"unknown operation {name!r}")
    method, _, kinds, _ = OPERATIONS[name]
    for k in REQUIRED.get(name, ()):
        if not arguments.get(k):
            raise KbError(f"{k} is required")
    if unknown := set(arguments) - set(kinds):
        raise KbError(f"unknown arguments {sorted(unknown)}")
    if bad := [k for k, v in arguments.items() if type(v) is not kinds[k]]:
        raise KbError(f"wrong type: {bad}")
    return method(kb, **arguments)
