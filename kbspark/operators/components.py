"""Connected components by hooking and pointer doubling, and following chains of pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.sources.durable import release, written


def ends(pointers: DataFrame) -> DataFrame:
    """node, to of the pointers (node, to; one a node, without cycles), each led to the end of its chain; n steps take log2(n) rounds."""
    now = written(pointers.select("node", "to"), "pointers")
    while True:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = written(now.join(ahead, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "pointers")
        release(now)
        now = after
        if now.where("moved").isEmpty():
            return now


def components(edges: DataFrame) -> DataFrame:
    """node, component of the nodes (strings) of edges (a, b); an edge to itself names a node alone.

    Each round every root hooks on to the smallest of its neighbours' roots, the trees are flattened by doubling and the edges
    drawn between roots.  Roots are ordered by a hash of their names, so no order of names makes rounds many.
    """
    key = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.lit(" "), c)
    both = edges.select(key(F.col("a")).alias("a"), key(F.col("b")).alias("b"))
    roots = written(both.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    left = written(both.where("a <> b").distinct(), "edges")
    while not left.isEmpty():
        around = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = around.groupBy("a").agg(F.min("b").alias("to")).where("to < a").select(F.col("a").alias("node"), "to")
        led = ends(hooks)
        at = led.select(F.col("node").alias("root"), "to")
        new = written(roots.join(at, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        drawn = left.join(led.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a", "left").join(led.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b", "left")
        drawn = written(drawn.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct(), "edges")
        release(roots, left, led)
        roots, left = new, drawn
    release(left)
    return roots.select(F.substring("node", 18, 1 << 30).alias("node"), F.col("root").alias("component"))
