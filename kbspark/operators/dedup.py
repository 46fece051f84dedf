"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups(entries: DataFrame, strategy: str = "keep-oldest") -> DataFrame:
    """blob, n, keep (null where the deciding time is tied), is_conflict of the contents that stand at several paths.

    Both aggregates are combined before their shuffle, so a content at very many paths is a few rows a partition.
    """
    times = entries.groupBy("blob", "mod_time").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("p"))
    pick = F.max_by if strategy == "keep-newest" else F.min_by
    # without any time there is one row a blob
    top = F.coalesce(pick(F.struct("n", "p"), "mod_time"), F.max(F.struct("n", "p")))
    out = times.groupBy("blob").agg(F.sum("n").alias("n"), top.alias("top")).where("n > 1")
    return out.select("blob", "n", F.when(F.col("top.n") == 1, F.col("top.p")).alias("keep"), (F.col("top.n") > 1).alias("is_conflict"))


def members(entries: DataFrame, strategy: str = "keep-oldest") -> DataFrame:
    """blob, path, n, keep, is_conflict of every path of such a content: one row a path."""
    return entries.select("blob", "path").join(groups(entries, strategy), "blob").select("blob", "path", "n", "keep", "is_conflict")


def removed(rows: DataFrame) -> DataFrame:
    return rows.where("not is_conflict and path <> keep").select("path")


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("not is_conflict and path = keep").select("keep")


def grouped(rows: DataFrame) -> DataFrame:
    """A report for people: blob, keep, paths (to remove, or all of a conflict), is_conflict."""
    listed = rows.where("is_conflict or path <> keep").groupBy("blob", "keep", "is_conflict")
    return listed.agg(F.array_sort(F.collect_list("path")).alias("paths")).select("blob", "keep", "paths", "is_conflict")


def apply(entries: DataFrame, rows: DataFrame) -> DataFrame:
    return entries.join(removed(rows), "path", "left_anti")
