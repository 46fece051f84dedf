"""Classification: first placement wins, labels add up, claims on targets are settled in path order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import paths
from kbspark.policy import PINNED, UNSORTED, Policy, condition, target
from kbspark.sources.durable import release, written
from kbspark.sources.snapshots import replaced


def classify(entries: DataFrame, policy: Policy) -> DataFrame:
    """entries (path, text, mod_time, labels, ...) with placement (rule index), to, rule, want (labels), pinned, matched."""
    hits = [F.when(condition(r.match), F.lit(i)) for i, r in enumerate(policy.rules)]
    never = F.lit(len(policy.rules))
    first_place = F.least(never, never, *(F.when(condition(r.match), F.lit(i)) for i, r in enumerate(policy.rules) if r.places))
    df = entries.withColumn("placement", first_place).withColumn("first", F.least(never, never, *hits))
    labels = F.flatten(F.array(F.array().cast("array<string>"), *(F.when(condition(r.match) & (F.col("placement") >= i), F.array(*map(F.lit, r.label))).otherwise(F.array().cast("array<string>")) for i, r in enumerate(policy.rules) if r.label)))
    to, name = F.col("path"), F.lit(None).cast("string")
    for i, r in enumerate(policy.rules):
        if r.places:
            to = F.when(F.col("placement") == i, target(r)).otherwise(to)
        name = F.when(F.when(F.col("placement") < len(policy.rules), F.col("placement")).otherwise(F.col("first")) == i, F.lit(r.name)).otherwise(name)
    df = df.withColumn("to", to).withColumn("rule", name).withColumn("matched", F.col("first") < len(policy.rules))
    df = df.withColumn("want", F.filter(labels, lambda x: ~F.array_contains("labels", x)))
    return df.withColumn("pinned", F.array_contains("labels", PINNED))


def settle(moves: DataFrame, occupied: DataFrame) -> DataFrame:
    """moves (path, to) with ok and claimer: a target is free if unoccupied or left by an earlier accepted move.

    The sequential rule is a least fixpoint: per target only the smallest eligible path can win; it wins at once where the
    target is empty, else iff the occupant's own move is accepted.  So each claim waits for at most one other, and paths strictly
    fall along a chain of claims; its end decides for all of it.  Chains are followed by pointer doubling: a claim that points
    to an undecided one points to what that one points to in the next round, so a chain of n claims takes about log2(n) rounds.
    """
    occ = occupied.select(F.col("path").alias("to")).distinct().withColumn("full", F.lit(True))
    m = moves.join(occ, "to", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    cand = m.where(~F.col("full") | (F.col("path") > F.col("to"))).groupBy("to").agg(F.min("path").alias("cand"))
    m = written(m.join(cand, "to", "left"), "claims")
    # of the claims that wait: on is the claim waited for, ok what has become of it (null: not known yet)
    first = m.where("path = cand").select("path", F.col("to").alias("on"), F.when(~F.col("full"), F.lit(True)).alias("ok"))
    ends = first.select(F.col("path").alias("on"), F.col("ok").alias("end"), F.lit(True).alias("claims"))
    # what isn't anybody's accepted claim stays where it is
    links = written(first.join(ends, "on", "left").select("path", "on", F.when(F.col("ok") | F.col("claims").isNull(), F.coalesce("ok", F.lit(False))).otherwise(F.col("end")).alias("ok")), "claim-links")
    while not links.where("ok is null").isEmpty():
        ahead = links.select(F.col("path").alias("on"), F.col("on").alias("further"), F.col("ok").alias("found"))
        after = written(links.join(ahead, "on", "left").select("path", F.when(F.col("ok").isNull(), F.col("further")).otherwise(F.col("on")).alias("on"), F.coalesce("ok", "found").alias("ok")), "claim-links")
        release(links)
        links = after
    ok = links.where("ok").select(F.col("path").alias("winner"))
    out = m.join(ok.withColumn("ok", F.lit(True)), F.col("path") == F.col("winner"), "left").withColumn("ok", F.col("winner").isNotNull()).drop("winner")
    out = out.join(ok.select(F.col("winner").alias("cand"), F.lit(True).alias("won")), "cand", "left")
    claimer = F.when(F.col("ok"), F.lit(None)).when(F.col("won") & (F.col("path") > F.col("cand")), F.col("cand")).otherwise(F.col("to"))
    return out.select("path", "to", "ok", claimer.alias("claimer"))


def plan(entries: DataFrame, policy: Policy) -> DataFrame:
    """path, class (move, label, pinned, conflict, unsorted), rule, to, labels (to add), reason."""
    # every class reads the rules' verdicts; they are made once, without the texts
    c = written(classify(entries, policy).select("path", "to", "rule", "want", "pinned", "matched", "labels"), "classified")
    moving = c.where("matched and to <> path and not pinned")
    bad = moving.where(paths.escapes(F.col("to")))
    settled = settle(moving.where(~paths.escapes(F.col("to"))).select("path", "to"), c)
    moves = moving.select("path", "rule", "want").join(settled, "path")
    none = F.lit(None).cast("string")
    out = moves.where("ok").select("path", F.lit("move").alias("class"), "rule", "to", F.col("want").alias("labels"), none.alias("reason"))
    out = out.unionByName(moves.where("not ok").select("path", F.lit("conflict").alias("class"), "rule", "to", F.col("want").alias("labels"), F.concat(F.lit("target claimed by "), "claimer").alias("reason")))
    out = out.unionByName(bad.select("path", F.lit("conflict").alias("class"), "rule", "to", F.col("want").alias("labels"), F.lit("target leaves the collection").alias("reason")))
    out = out.unionByName(c.where("matched and to <> path and pinned").select("path", F.lit("pinned").alias("class"), "rule", "to", F.array().cast("array<string>").alias("labels"), none.alias("reason")))
    out = out.unionByName(c.where("matched and (to = path or pinned) and size(want) > 0").select("path", F.lit("label").alias("class"), "rule", none.alias("to"), F.col("want").alias("labels"), none.alias("reason")))
    return out.unionByName(c.where(~F.col("matched") & ~F.array_contains("labels", UNSORTED)).select("path", F.lit("unsorted").alias("class"), none.alias("rule"), none.alias("to"), F.array(F.lit(UNSORTED)).alias("labels"), none.alias("reason")))


def apply(entries: DataFrame, planned: DataFrame) -> DataFrame:
    """entries with moves and labels of the plan; conflicts and pins stay."""
    ops = planned.where("class in ('move', 'label', 'unsorted')").groupBy("path").agg(F.max("to").alias("__to"), F.max("rule").alias("__rule"), F.flatten(F.collect_list("labels")).alias("__labels"))
    out = entries.join(ops, "path", "left")
    return out.withColumn("labels", F.concat("labels", F.coalesce("__labels", F.array().cast("array<string>")))).withColumn("rule", F.coalesce("__rule", "rule") if "rule" in entries.columns else F.col("__rule")).withColumn("path", F.coalesce("__to", "path")).drop("__to", "__rule", "__labels")


def edits(entries: DataFrame, planned: DataFrame) -> DataFrame:
    """What apply changes: the rows it puts, and the paths it leaves (gone)."""
    touched = entries.join(planned.where("class in ('move', 'label', 'unsorted')").select("path").distinct(), "path", "left_semi")
    return replaced(touched, apply(touched, planned))
