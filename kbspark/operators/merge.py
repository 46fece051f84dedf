"""Three-way merge of a view's staged operations into the head."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.components import components
from kbspark.sources.durable import written

STATES = {"CREATED": {"PROPOSED", "STAGED", "ABORTED"}, "PROPOSED": {"STAGED", "ABORTED"}, "STAGED": {"STAGED", "MERGED", "ESCALATED", "ABORTED"}, "ESCALATED": {"STAGED", "MERGED", "ESCALATED", "ABORTED"}, "MERGED": set(), "ABORTED": set()}


@dataclass(frozen=True)
class Op:
    path: str
    to: str = ""
    labels: tuple[str, ...] = ()
    rule: str = ""


@dataclass(frozen=True)
class View:
    name: str
    base: str
    state: str = "CREATED"
    ops: tuple[Op, ...] = ()
    conflict: str = ""

    def moved(self, state: str, **more) -> View:
        if state not in STATES[self.state]:
            raise ValueError(f"{self.state} can't become {state}")
        return replace(self, state=state, **more)


@dataclass
class Outcome:
    """moves: from where to where files go."""

    applied: list[Op] = field(default_factory=list)
    dropped: list[Op] = field(default_factory=list)
    held: list[tuple[Op, str]] = field(default_factory=list)
    moves: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def listed(cls, ops: DataFrame, outcome: DataFrame, moves: DataFrame) -> Outcome:
        """A report for people, in the order of the operations; tables stay where views are large."""
        out = cls(moves=[(r["path"], r["to"]) for r in moves.orderBy("path").collect()])
        for r in ops.join(outcome, "seq").orderBy("seq").collect():
            op = Op(r["path"], r["to"] or "", tuple(r["labels"] or ()), r["rule"] or "")
            if r["status"] == "held":
                out.held.append((op, r["reason"]))
            else:
                (out.applied if r["status"] == "applied" else out.dropped).append(op)
        return out


OPS = "seq long, path string, to string, labels array<string>, rule string"
#: A task's input: a component's rows of the head (kind 0), then its operations (kind 1); its output: verdicts (seq) and edits (path).
_FOLDING = ("component", "kind", "seq", "path", "to", "labels", "rule", "was", "blob", "follow")
_FOLDED = "seq long, status string, reason string, path string, to string, labels array<string>, rule string"


def table_of(spark: SparkSession, ops: Iterable[Op]) -> DataFrame:
    return spark.createDataFrame([(i, o.path, o.to, list(o.labels), o.rule) for i, o in enumerate(ops)], OPS)


def checked(ops: DataFrame, base: DataFrame) -> None:
    """Raises ValueError where an operation's path isn't in the base, or its target leaves the collection; names a few."""
    if missing := [r["path"] for r in ops.join(base.select("path"), "path", "left_anti").orderBy("seq").limit(20).collect()]:
        raise ValueError(f"not in the base: {missing}")
    if bad := [r["to"] for r in ops.where(F.col("to").startswith("/") | (F.col("to") == "..") | F.col("to").startswith("../")).orderBy("seq").limit(20).collect()]:
        raise ValueError(f"leaves the collection: {bad}")


def stage(view: View, base: DataFrame, ops: list[Op]) -> View:
    checked(table_of(base.sparkSession, ops), base)
    return view.moved("STAGED", ops=(*view.ops, *ops))


def _placed(ops: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """ops with was (blob in the base), blob (in the head; null: gone), follow (first path in the head that holds was) where it may be needed."""
    b, h = base.select("path", F.col("blob").alias("was")), head.select("path", "blob")
    leaving = ops.where("to <> ''").groupBy("path").agg(F.min("seq").alias("leaves"))
    out = written(ops.join(b, "path", "left").join(h, "path", "left").join(leaving, "path", "left"), "placed")
    # a path that is gone, or that an earlier operation of the same view may empty
    lost = F.col("blob").isNull() | (F.coalesce("leaves", "seq") < F.col("seq"))
    wanted = out.where(lost).select("was").distinct()
    follow = h.join(wanted, F.col("blob") == F.col("was"), "left_semi").groupBy(F.col("blob").alias("was")).agg(F.min("path").alias("follow"))
    return written(out.join(follow, "was", "left").withColumn("follow", F.when(lost, F.col("follow"))).drop("leaves"), "placed-operations")


def _fold(ops: list[dict], rows: dict[str, dict], rank: dict[str, int]) -> list[tuple[int, str, str]]:
    """(seq, status, reason) of ops in their order; rows, the head's by path, are changed in place."""
    out = []
    now_at = {p: p for p in rows}  # where each of the head's rows is by now

    def put(path: str, op: dict) -> None:
        row = rows[path]
        if op["to"] and op["to"] != path:
            rows[op["to"]] = rows.pop(path)
            now_at[row["first"]] = op["to"]
        row["add"] += [x for x in op["labels"] if x not in row["add"] and x not in row["labels"]]
        row["rule"] = op["rule"] or row["rule"]
        out.append((op["seq"], "applied", ""))

    for op in ops:
        path, to = op["path"], op["to"]
        row = rows.get(path)
        taken = bool(to) and to != path and to in rows
        if row is None:
            # gone: labels follow the file; a move only if the file is where it should go
            now = now_at.get(op["follow"])
            if now and (not to or now == to):
                put(now, op)
            else:
                out.append((op["seq"], "held", f"moved to {now} meanwhile" if now else "the file is gone"))
        elif op["blob"] == op["was"] or not to or to == path:
            if taken:
                out.append((op["seq"], "held", f"{to} is occupied"))
            else:
                put(path, op)
        else:
            own, theirs = rank.get(op["rule"], -1) if op["rule"] else -1, rank.get(row["rule"], -1) if row["rule"] else -1
            if own < 0 or theirs < 0:
                out.append((op["seq"], "held", "the content changed meanwhile"))
            elif own >= theirs:
                out.append((op["seq"], "dropped", f"rule {row['rule']} stands"))
            elif taken:
                out.append((op["seq"], "held", f"{to} is occupied"))
            else:
                put(path, op)
    return out


def _folding(rank: dict[str, int]):
    """Component after component of a partition that is sorted by component, kind and seq."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    names = ["seq", "status", "reason", "path", "to", "labels", "rule"]

    def settled(rows: dict[str, dict], ops: list[dict]):
        for seq, status, reason in _fold(ops, rows, rank):
            yield seq, status, reason, None, None, None, None
        for path, r in rows.items():
            if path != r["first"] or r["add"] or r["rule"] != r["had"]:
                yield None, None, None, r["first"], path, r["add"], r["rule"] or None

    def run(batches):
        name, rows, ops = None, {}, []
        for batch in batches:
            found = []
            for x in batch.to_pylist():
                if x["component"] != name:
                    found += settled(rows, ops)
                    name, rows, ops = x["component"], {}, []
                if x["kind"]:
                    ops.append(x)
                else:
                    rule = x["rule"] or ""
                    rows[x["path"]] = {"first": x["path"], "labels": x["labels"] or [], "add": [], "rule": rule, "had": rule}
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=names)
        found = list(settled(rows, ops))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=names)

    return run


def merge_table(ops: DataFrame, base: DataFrame, head: DataFrame, rank: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new head, outcome (seq, status, reason), moves (path, to)) of ops (seq, path, to, labels, rule; to empty: labels only).

    In the order of seq, an operation on a path whose content is still the base's applies, as do labels on a path whose content
    changed, and a move to where the file is already.  Where the path is gone, labels follow the file, and a move does only
    if the file is where it should go; else it is held.  A move of a path whose content changed is settled by the order of
    the rules, and held where either side has none.  An occupied target holds a move.

    Only operations that share a path with one that may move a file depend on their order.  They are split into components of
    paths that touch one another, and each component is folded by one task, with the head's rows of its paths; a component is a
    chain of files that take each other's places, or what aims at one target, and its rows are narrow.  All others are joined.
    Nothing of this comes to the driver.
    """
    ops = ops.withColumns({"to": F.coalesce("to", F.lit("")), "labels": F.coalesce("labels", F.array().cast("array<string>")), "rule": F.coalesce("rule", F.lit(""))})
    targets = ops.where("to <> ''").select(F.col("to").alias("path")).distinct().withColumn("aimed", F.lit(True))
    placed = written(_placed(ops, base, head).join(targets, "path", "left").withColumn("mover", (F.col("to") != "") & (F.col("blob").isNotNull() | F.col("aimed").isNotNull())).drop("aimed"), "placed-movers")
    names = F.array_compact(F.array("path", F.when(F.col("mover"), F.col("to")), "follow"))
    shared = written(placed.where("mover").select(F.explode(names).alias("name")).distinct(), "move-paths")
    reached = placed.select("seq", F.explode(names).alias("name"))
    folded = written(placed.join(reached.join(shared, "name", "left_semi").select("seq").distinct(), "seq", "left_semi"), "folded-operations")
    joined = placed.join(folded.select("seq"), "seq", "left_anti")
    # what isn't folded: labels on paths that stay, and operations on paths that are gone, whose file stays
    aim = F.when(F.col("blob").isNotNull(), F.col("path")).when((F.col("to") == "") | (F.col("to") == F.col("follow")), F.col("follow"))
    joined = joined.withColumn("at", aim)
    last = F.max_by(F.col("rule"), F.when(F.col("rule") != "", F.col("seq")))
    added = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "labels"))), lambda x: x["labels"])))
    edits = joined.where("at is not null").groupBy("at").agg(added.alias("labels"), last.alias("rule")).select(F.col("at").alias("path"), F.lit(None).cast("string").alias("to"), "labels", "rule")
    why = F.when(F.col("at").isNotNull(), "").when(F.col("follow").isNull(), "the file is gone").otherwise(F.concat(F.lit("moved to "), "follow", F.lit(" meanwhile")))
    outcome = joined.select("seq", F.when(F.col("at").isNotNull(), "applied").otherwise("held").alias("status"), why.alias("reason"))

    found = components(folded.select(F.col("path").alias("a"), F.explode(names).alias("b")))
    places = found.select(F.col("node").alias("path"), "component")
    none = F.lit(None).cast("string")
    near = head.select("path", "blob", "labels", "rule").join(places, "path")
    near = near.select("component", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), "path", none.alias("to"), "labels", "rule", none.alias("was"), "blob", none.alias("follow"))
    work = folded.join(places, "path").withColumn("kind", F.lit(1)).withColumn("seq", F.col("seq").cast("long"))
    work = near.unionByName(work.select(*_FOLDING)).repartition("component").sortWithinPartitions("component", "kind", "seq")
    told = written(work.mapInArrow(_folding(rank or {}), _FOLDED), "folded")
    outcome = outcome.unionByName(told.where("seq is not null").select("seq", "status", "reason"))
    changed = told.where("seq is null").select("path", "to", "labels", "rule")
    return _edited(head, edits.unionByName(changed)), outcome, changed.where("to <> path").select("path", "to")


def _edited(head: DataFrame, edits: DataFrame) -> DataFrame:
    edits = edits.select("path", F.col("to").alias("__to"), F.col("labels").alias("__add"), F.col("rule").alias("__rule"))
    none = F.array().cast("array<string>")
    new = head.join(edits, "path", "left").withColumn("labels", F.array_union(F.coalesce("labels", none), F.coalesce("__add", none))).withColumn("rule", F.coalesce("__rule", "rule")).withColumn("path", F.coalesce("__to", "path"))
    return new.drop("__to", "__add", "__rule")


def merge(view: View, base: DataFrame, head: DataFrame, rank: dict[str, int] | None = None) -> tuple[DataFrame, Outcome]:
    """(new head, outcome) of a view's staged operations."""
    ops = table_of(head.sparkSession, view.ops)
    new, outcome, moves = merge_table(ops, base, head, rank)
    return new, Outcome.listed(ops, outcome, moves)


def settled(view: View, out: Outcome) -> View:
    """The view after a merge: merged, or escalated with what is held."""
    if not out.held:
        return view.moved("MERGED", ops=(), conflict="")
    return view.moved("ESCALATED", ops=tuple(o for o, _ in out.held), conflict="; ".join(r for _, r in out.held))


def resolve(view: View, head: DataFrame, mine: bool):
    """Of an escalated view.  theirs: the view is given up; mine: merged again, from the head as its base and without ranks; it may stay escalated."""
    if view.state != "ESCALATED":
        raise ValueError(f"{view.name} is {view.state}, not ESCALATED")
    if not mine:
        return head, view.moved("ABORTED"), Outcome()
    new, out = merge(view, head, head)
    return new, settled(view, out), out
