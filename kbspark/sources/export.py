"""Filtered, pinned export of a snapshot as JSON lines."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.paths import matches_glob

TEXT_LIMIT = 4 << 20


def parse_filter(parts: list[str]) -> Column:
    """Predicate of label:, path:, after: and before: terms, all of which must hold; a repeated date replaces the former."""
    out, dates = F.lit(True), {}
    for p in parts:
        key, colon, value = p.partition(":")
        if not colon or not value or key not in ("label", "path", "after", "before"):
            raise ValueError(f"filter {p!r}")
        if key == "label":
            out = out & F.array_contains("labels", value)
        elif key == "path":
            out = out & matches_glob("path", value)
        else:
            dates[key] = datetime.date.fromisoformat(value)
    if "after" in dates:
        out = out & (F.col("mod_time") > F.lit(dates["after"]).cast("timestamp_ntz"))
    if "before" in dates:
        out = out & (F.col("mod_time") < F.lit(dates["before"]).cast("timestamp_ntz"))
    return out


def records(entries: DataFrame, manifest: str, filters: list[str] = []) -> DataFrame:  # noqa: B006
    """path, text, binary, labels, size, mod_time, src (the blob), manifest, in this order of fields; entries hold text or content."""
    rows = entries.where(parse_filter(filters))
    if "content" in rows.columns:
        cut = F.substring("content", 1, TEXT_LIMIT)
        rows = rows.withColumn("text", F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string")))
    return rows.select("path", "text", F.when(F.col("text").isNull(), True).alias("binary"), F.when(F.size("labels") > 0, F.col("labels")).alias("labels"), "size", F.date_format("mod_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mod_time"), F.col("blob").alias("src"), F.lit(manifest).alias("manifest"))


def lines(rows: DataFrame) -> DataFrame:
    """value, a JSON line a record, in path order: partitions are ranges of paths."""
    return rows.repartitionByRange("path").sortWithinPartitions("path").select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """JSON lines; file order is path order."""
    lines(rows).write.text(path)
