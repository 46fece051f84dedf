"""Made-up collections for trials: a range of numbers whose seeded hashes give each file its folder, its kind and its content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.folder import Folder

#: Texts, copies of texts, files that aren't text, and levels of folders: fixed values.
SIZES = {"small": (15, 4, 2, 2), "medium": (60, 12, 6, 3), "large": (200, 40, 20, 5)}
_SUFFIXES = ("txt", "md", "log", "csv")


def files(spark: SparkSession, seed: int, texts: int, copies: int, others: int, levels: int) -> DataFrame:
    """path, content of so many files of each kind, in at most so many levels of folders; equal for equal arguments.

    A file's path begins with one hexadecimal digit a level, taken from a digest of its number.  A text is a table of as many lines
    as another digest says, each with a digest of the text's and the line's number; a copy has the number of a text for its content.
    """
    number = F.col("id")
    digest = lambda *what: F.sha2(F.concat_ws(":", F.lit(str(seed)), *(x if isinstance(x, Column) else F.lit(x) for x in what)).cast("binary"), 256)
    part = lambda name, most, of: F.pmod(F.xxhash64(digest(name, of.cast("string"))), F.lit(max(1, most)))
    kind = F.when(number < texts, "text").when(number < texts + copies, "copy").otherwise("other")
    source = F.when(F.col("kind") == "copy", part("source", texts, number)).otherwise(number)
    folders = F.expr(f"transform(sequence(1, {levels}), i -> concat('x', substr(place, i, 1)))")
    inside = F.slice(folders, F.lit(1), part("depth", levels + 1, number).cast("int"))
    name = F.concat(F.col("kind"), F.lit("_"), number.cast("string"), F.lit("."), F.when(F.col("kind") == "other", "dat").otherwise(F.element_at(F.array(*map(F.lit, _SUFFIXES)), (part("suffix", len(_SUFFIXES), F.col("source")) + 1).cast("int"))))
    line = lambda i: F.concat_ws("\t", F.col("source").cast("string"), i.cast("string"), F.substring(digest("line", F.col("source").cast("string"), i.cast("string")), 1, 24))
    text = F.array_join(F.transform(F.sequence(F.lit(1), part("lines", 12, F.col("source")) + 2), line), "\n")
    # two bytes that begin no UTF-8 text
    other = F.unhex(F.concat(F.lit("c0c1"), F.repeat(digest("bytes", number.cast("string")), part("size", 4, number).cast("int") + 1)))
    rows = spark.range(texts + copies + others).withColumn("kind", kind).withColumn("source", source).withColumn("place", digest("place", number.cast("string")))
    return rows.select(F.array_join(F.array_append(inside, name), "/").alias("path"), F.when(F.col("kind") == "other", other).otherwise(text.cast("binary")).alias("content"))


def generate(spark: SparkSession, root: str, seed: int = 1, size: str = "medium") -> list[str]:
    """Writes a collection of one of the fixed sizes under root; its paths in order."""
    folder, names = Folder(spark, root), []
    for r in files(spark, seed, *SIZES[size]).orderBy("path").toLocalIterator():
        folder.make(r["path"].rpartition("/")[0])
        folder.write(r["path"], bytes(r["content"]))
        names.append(r["path"])
    return names
