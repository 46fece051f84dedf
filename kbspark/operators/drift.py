"""Differences of snapshots: added, removed, modified, renamed; what is kept of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.numbering import numbered
from kbspark.policy import PINNED
from kbspark.sources.durable import written


def changes(head: DataFrame, current: DataFrame) -> DataFrame:
    """kind, path, from_path, blob; each leftover pair of equal blobs is one rename, paired in path order.

    Numbers are given across partitions, so one content at many paths (empty files, say) isn't one task's.
    """
    h, c = head.select("path", F.col("blob").alias("old")), current.select("path", F.col("blob").alias("new"))
    both = written(h.join(c, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))), "differences")
    modified = both.where("old is not null and new is not null and old <> new").select(F.lit("modified").alias("kind"), "path", F.lit(None).cast("string").alias("from_path"), F.col("new").alias("blob"))
    added = numbered(both.where("old is null").select("path", F.col("new").alias("blob")), "blob", "path")
    gone = numbered(both.where("new is null").select(F.col("path").alias("from_path"), F.col("old").alias("blob")), "blob", "from_path")
    pairs = added.join(gone, ["blob", "k"], "full_outer")
    kind = F.when(F.col("path").isNull(), "removed").when(F.col("from_path").isNull(), "added").otherwise("renamed")
    rest = pairs.select(kind.alias("kind"), F.coalesce("path", "from_path").alias("path"), F.when(kind == "renamed", F.col("from_path")).alias("from_path"), "blob")
    return modified.unionByName(rest)


def absorb(head: DataFrame, current: DataFrame) -> DataFrame:
    """current with the labels of the same path, or of the path it was renamed from, which also pins it; rules aren't carried."""
    moved = changes(head, current).where("kind = 'renamed'").select("path", "from_path")
    old = head.select(F.col("path").alias("source"), F.col("labels").alias("had"))
    rows = current.drop("labels", "rule").join(moved, "path", "left").withColumn("source", F.coalesce("from_path", "path")).join(old, "source", "left")
    had = F.coalesce("had", F.array().cast("array<string>"))
    labels = F.when(F.col("from_path").isNotNull(), F.array_union(had, F.array(F.lit(PINNED)))).otherwise(had)
    return rows.withColumn("labels", labels).withColumn("rule", F.lit(None).cast("string")).drop("source", "had", "from_path")


def changed_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose blob differs or that only one side has."""
    both = a.select("path", F.col("blob").alias("x")).join(b.select("path", F.col("blob").alias("y")), "path", "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("path")
