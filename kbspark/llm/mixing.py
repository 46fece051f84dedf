"""op 3: mixing sources to target weights by Pfair scheduling.

The documents of a source are numbered by a hash of their doc_id and cut into blocks of a common size.  The ideal schedule is
fluid: in every slot the sources that have blocks left share one block in proportion to their weights, so when a source runs
out the others share its weight.  Block i of a source is released at the slot in which the fluid reaches it and due when the
fluid has passed it; the schedule gives each slot to the released block of the earliest deadline.  Such a schedule meets all
deadlines (the fluid is a fractional matching of blocks and slots, so a whole one exists), and at every slot each source has
had within one block of its fluid share.  Every document gets exactly one place.

Nothing is numbered by a global sort of rows: they are dealt to small (source, salt) groups, the counts of the groups give
each its first number, and only the narrow rows (doc_id, hash) are numbered inside a group.  With weights q in whole parts the
fluid reaches the end of block i of a source at slot D + i * Q / q, where D is the number of blocks of the sources that end
before and Q the sum of the other sources' q: running sums over range partitions of sources and blocks.

Slots are given out in ranges of ``PIECE`` (of as many as there are sources, if these are more), each by one task: it starts with the blocks that are released before its first slot and
not yet placed, one a source at most, and goes through those released in it.  How many are carried over an edge is known from
counts; which, is first taken to be those of the latest deadlines among the blocks whose windows span the edge, for all edges
at once.  A range whose task doesn't hand on what the next one had started with makes that one run again from what it did hand on, until
all edges agree: then the schedule is that of one pass, whatever was guessed.  Two starts grow alike as soon as the blocks in
which they differ are placed, so few ranges run again, and a range is right after as many rounds as ranges before it at the
latest.  The driver sees a number a range, and no blocks.

Defined cases: a null source is a source of its own; a source without a given weight, or with one not above zero, follows
when all weighted sources have run out; repeated rows are scheduled once each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents in a block, rows in a numbered group about, slots of a range.
BLOCK, GROUP, PIECE = 64, 20_000, 8192
#: Weights are whole numbers of this many parts, or of two a source where there are more sources.
PARTS = 1_000_000
#: Power of a source's size that its default weight follows: under 1 lifts the small sources.
TEMPER = 0.5


def quanta(weights: Mapping[str, float], parts: int = PARTS) -> dict[str, int]:
    """Whole parts, one at least, that add up to parts (to more where raising small weights to one part takes more than is left); the largest remainders get what rounding leaves."""
    total = sum(weights.values())
    exact = {s: w / total * parts for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    left = parts - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, left)]:
        out[s] += 1
    return out


def earliest_deadline(blocks: Iterable[tuple[int, int, str, int, bool]]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, slot, release, due, phase) by slot for blocks (release, due, source, block, last of its source) in the order of release."""
    blocks = iter(blocks)
    ready: list[tuple[int, int, str, int, bool]] = []
    coming, slot, phase = next(blocks, None), 0, 0
    while coming or ready:
        while coming and (coming[0] <= slot or not ready):
            release, due, *rest = coming
            heapq.heappush(ready, (due, release, *rest))
            coming = next(blocks, None)
        due, release, s, block, last = heapq.heappop(ready)
        yield s, block, slot, release, due, phase
        phase += last
        slot += 1


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[str, int, int, int, int, int]]:
    """(source, block, slot, release, due, phase) of every block, of few sources and without Spark."""
    out: list[tuple[int, int, str, int, bool]] = []
    weighted = {s for s, n in blocks.items() if n > 0 and weights.get(s, 0) > 0}
    base = 0
    for tier in (weighted, {s for s, n in blocks.items() if n > 0} - weighted):
        if not tier:
            continue
        q = quanta({s: weights[s] if s in weighted else 1.0 for s in tier}, max(PARTS, 2 * len(tier)))

        def at(s: str, i: int, tier=tier, q=q, base=base) -> tuple[int, int]:
            """The fluid's time at the end of block i of s: floor and ceiling."""
            ended = {x for x in tier if blocks[x] * q[s] <= i * q[x]}
            d, rate = base + sum(blocks[x] for x in ended), i * sum(q[x] for x in tier - ended)
            return d + rate // q[s], d - (-rate // q[s])

        for s in tier:
            out += [(at(s, i)[0], at(s, i + 1)[1], s, i, i + 1 == blocks[s]) for i in range(blocks[s])]
        base += sum(blocks[s] for s in tier)
    return list(earliest_deadline(sorted(out)))


def _running(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """rows with before_x, the sum of x over the rows before in a unique order, for each x of sums; range partitions are summed alone."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "running")
    firsts, total = [], [0] * len(sums)
    # a row a partition
    for r in parts.groupBy("part").agg(*(F.sum(x).alias(x) for x in sums)).orderBy("part").collect():
        firsts.append((r["part"], *total))
        total = [a + r[x] for a, x in zip(total, sums, strict=True)]
    firsts = rows.sparkSession.createDataFrame(firsts, "part int, " + ", ".join(f"first_{x} long" for x in sums))
    window = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumns({f"in_{x}": F.coalesce(F.sum(x).over(window), F.lit(0)) for x in sums})
    out = inside.join(F.broadcast(firsts), "part").withColumns({f"before_{x}": F.col(f"first_{x}") + F.col(f"in_{x}") for x in sums})
    return out.select(*rows.columns, *(f"before_{x}" for x in sums))


def _windows(sizes: DataFrame, weights: DataFrame | None, size: int) -> DataFrame:
    """release, due, src, block, last of every block of sizes (src, n rows)."""
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / size))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPER)))
    else:
        sizes = sizes.join(weights, "src", "left")
    sizes = sizes.withColumn("tier", F.when(F.col("w") > 0, 0).otherwise(1)).withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    sizes = materialize(sizes, "sizes")
    tiers = {r["tier"]: r for r in sizes.groupBy("tier").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("blocks").alias("blocks")).collect()}
    by_tier = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("tier"))
    if not tiers:
        return sizes.selectExpr("0L as release", "0L as due", "src", "0L as block", "true as last")
    parts = {t: max(PARTS, 2 * r["n"]) for t, r in tiers.items()}
    exact = sizes.withColumn("exact", F.col("w") / by_tier({t: float(r["w"]) for t, r in tiers.items()}) * by_tier({t: float(p) for t, p in parts.items()}))
    exact = exact.withColumns({"q": F.greatest(F.lit(1).cast("long"), F.floor("exact")), "rest": F.floor("exact") - F.col("exact"), "one": F.lit(1).cast("long")})
    counted = _running(exact, ["tier", "rest", "src"], ["one"])
    sums = {r["tier"]: r["q"] for r in exact.groupBy("tier").agg(F.sum("q").alias("q")).collect()}
    left = by_tier({t: parts[t] - q for t, q in sums.items()})
    before = by_tier({t: sum(r["n"] for u, r in tiers.items() if u < t) for t in tiers})
    q = materialize(counted.withColumn("q", F.col("q") + (F.col("before_one") - before < left).cast("long")).select("src", "tier", "blocks", "q"), "quanta")
    sums = {r["tier"]: r["q"] for r in q.groupBy("tier").agg(F.sum("q").alias("q")).collect()}
    # ends of sources, then the begin (which 1) and end (which 2) of every block, in the order of the fluid
    ends = q.selectExpr("tier", "blocks / q as v", "0 as which", "src", "blocks as i", "q", "blocks as end_blocks", "q as end_q", "blocks")
    block = q.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    points = [block.selectExpr("tier", f"(i + {k}) / q as v", f"{k + 1} as which", "src", "i", "q", "0L as end_blocks", "0L as end_q", "blocks") for k in (0, 1)]
    order = ["tier", "v", "which", "src", "i"]
    events = _running(ends.unionByName(points[0]).unionByName(points[1]), order, ["end_blocks", "end_q"]).where("which > 0")
    # sources of the tiers before have all ended, so the blocks need no base of their own
    gone = by_tier({t: sum(x for u, x in sums.items() if u < t) for t in tiers})
    rate = by_tier(sums) - (F.col("before_end_q") - gone)
    events = events.withColumn("rate", rate * F.expr("i + which - 1"))
    events = events.withColumn("time", F.expr("before_end_blocks + rate div q + if(which = 2 and rate % q > 0, 1L, 0L)"))
    return events.groupBy("src", F.col("i").alias("block")).agg(F.max(F.when(F.col("which") == 1, F.col("time"))).alias("release"), F.max(F.when(F.col("which") == 2, F.col("time"))).alias("due"), F.max(F.col("i") + 1 == F.col("blocks")).alias("last")).select("release", "due", "src", "block", "last")


_BLOCK = "range long, kind int, release long, due long, src string, block long, last boolean"
_RUN = f"{_BLOCK}, slot long"


def _ranges(piece: int, total: int):
    """Range after range of a partition sorted by range, kind (0: carried in, 1: released in it) and release: placed blocks
    (kind 1, with slots), and those handed on to the next range (kind 0, under its number)."""
    names = [c.split()[0] for c in _RUN.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]

    def placed(k: int, carried: list[tuple], coming: list[tuple]) -> Iterator[tuple]:
        ready, at = list(carried), 0
        heapq.heapify(ready)
        for slot in range(k * piece, min(total, (k + 1) * piece)):
            while at < len(coming) and (coming[at][1] <= slot or not ready):
                heapq.heappush(ready, coming[at])
                at += 1
            if not ready:
                break  # a wrong guess: the range before hands on more
            due, release, src, block, last = heapq.heappop(ready)
            yield k, 1, release, due, src, block, last, slot
        for due, release, src, block, last in [*ready, *coming[at:]]:
            yield k + 1, 0, release, due, src, block, last, None

    def run(batches):
        now, carried, coming = None, [], []

        def flush():
            found = list(placed(now, carried, coming)) if now is not None else []
            for lo in range(0, len(found), 50_000):
                part = found[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for k, kind, release, due, src, block, last in zip(*(batch.column(c).to_pylist() for c in names[:7]), strict=True):
                if k != now:
                    yield from flush()
                    now, carried, coming = k, [], []
                (coming if kind else carried).append((due, release, src, block, last))
        yield from flush()

    return run


def _carried(windows: DataFrame, piece: int, total: int) -> DataFrame:
    """The first guess of what each range but the first starts with: of the blocks whose windows span its first slot, those of the latest deadlines."""
    spanning = windows.where(f"release div {piece} < (due - 1) div {piece}").withColumn("range", F.explode(F.expr(f"sequence(release div {piece} + 1, (due - 1) div {piece})"))).where(f"range * {piece} < {total}")
    # of all blocks due by the edge every one is placed, and slots before it that these don't fill hold blocks that span it
    due = windows.groupBy(F.expr(f"(due - 1) div {piece} + 1").alias("range")).agg(F.count(F.lit(1)).alias("n"))
    edges = windows.sparkSession.range(1, -(-total // piece)).withColumnRenamed("id", "range").join(due, "range", "left")
    placed = edges.select("range", (F.col("range") * piece - F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))).alias("early"))
    turn = F.row_number().over(Window.partitionBy("range").orderBy("due", "release", "src", "block"))
    out = spanning.withColumn("turn", turn).join(placed, "range").where("turn > early")
    return out.select("range", F.lit(0).alias("kind"), "release", "due", "src", "block", "last")


def _plan(windows: DataFrame, piece: int) -> tuple[DataFrame, int]:
    """(src, block, slot, release, due, phase of windows; rounds that it took)."""
    spark = windows.sparkSession
    windows = materialize(windows.where("due > 0").select("release", "due", "src", "block", "last"), "windows")
    total = windows.count()
    coming = windows.select(F.expr(f"release div {piece}").alias("range"), F.lit(1).alias("kind"), "release", "due", "src", "block", "last")
    start = materialize(_carried(windows, piece, total), "carried")
    digest = lambda rows: rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "block").cast("decimal(38,0)")).alias("sum"))
    used = {r["range"]: (r["n"], r["sum"]) for r in digest(start).collect()}  # a row a range, of PIECE blocks
    every = range(-(-total // piece))
    todo, latest, runs = list(every), {}, []
    numbers = lambda ks, i=0: spark.createDataFrame([(k, i) for k in ks], "range long, run int")
    while todo:
        work = coming.unionByName(start)
        if runs:
            work = work.join(numbers(todo).select("range"), "range", "left_semi")
        tasks = min(len(todo), int(spark.conf.get("spark.sql.shuffle.partitions")))
        run = work.repartitionByRange(tasks, "range").sortWithinPartitions("range", "kind", "release", "due", "src", "block")
        runs.append(materialize(run.select(*(c.split()[0] for c in _BLOCK.split(", "))).mapInArrow(_ranges(piece, total), _RUN), "schedule"))
        latest |= dict.fromkeys(todo, len(runs) - 1)
        handed = {k + 1: (0, None) for k in todo} | {r["range"]: (r["n"], r["sum"]) for r in digest(runs[-1].where("kind = 0")).collect()}
        todo = [k for k in sorted(handed) if k in every and handed[k] != used.get(k, (0, None))]
        used |= handed
        start = runs[-1].where("kind = 0").drop("slot")
    out = spark.createDataFrame([], f"{_RUN}, run int")
    for i, run in enumerate(runs):
        out = out.unionByName(run.where("kind = 1").withColumn("run", F.lit(i)))
    if len(runs) > 1:  # of each range, the run that agreed with the one before
        right = spark.createDataFrame(list(latest.items()), "range long, run int")
        out = out.join(right, ["range", "run"], "left_semi")
    # the phase counts the sources that have run out before a slot
    out = _running(out.select("src", "block", "slot", "release", "due", F.col("last").cast("long").alias("ends")), ["slot"], ["ends"])
    return out.select("src", "block", "slot", "release", "due", F.col("before_ends").cast("int").alias("phase")), len(runs)


def _numbered(docs: DataFrame):
    """Narrow rows (source, h, doc_id, number) and the number of rows by source."""
    # rows without an id are alike here; their places in the input spread them
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"), h.alias("h"))
    rows = materialize(rows, "narrow")
    sizes = materialize(rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "counts")
    largest, total = (x or 0 for x in sizes.agg(F.max("n"), F.sum("n")).first())
    # groups are so small that a source of any size spreads over all tasks, and no larger than GROUP
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-largest // max(64, min(GROUP, total // (2 * tasks)))))
    rows = rows.withColumn("salt", F.pmod("h", F.lit(salts)).cast("int"))
    by = rows.groupBy("src", "salt").agg(F.count(F.lit(1)).alias("n"))
    first = by.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("src", "salt").orderBy("h", "doc_id")) - 1
    return rows.withColumn("inside", inside).join(first, ["src", "salt"]).withColumn("number", F.col("first") + F.col("inside")), sizes


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, block, position (in the block), slot, release, due, phase of every row of docs (doc_id, source).

    weights: target share by source; default: the power TEMPER of the source's number of rows.
    """
    spark = docs.sparkSession
    rows, sizes = _numbered(docs)
    target = None
    if weights is not None:
        target = spark.createDataFrame([("" if s is None else f"={s}", float(w)) for s, w in weights.items()], "src string, w double")
    # a range carries up to one block a source, so it has at least as many slots
    plan, _ = _plan(_windows(sizes, target, block), max(PIECE, sizes.count()))
    rows = rows.withColumn("block", F.floor(F.col("number") / block)).withColumn("position", F.col("number") % block)
    out = rows.join(plan, ["src", "block"])
    return out.selectExpr("doc_id", "if(src = '', null, substring(src, 2)) as source", "block", "position", "slot", "release", "due", "phase")


def in_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """docs, every row and column, physically laid out in schedule order: partitions are ranges of slots, sorted inside.

    Rows that share a doc_id and a source take the places of that pair in the order of their hashes; rows without a doc_id are
    told apart by a hash of all their columns.
    """
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    source = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.xxhash64(*plain).cast("string")))
    rows = docs.withColumn("__kb_s2", source("source")).withColumn("__kb_d2", key)
    places = mix_sources(rows.select(F.col("__kb_d2").alias("doc_id"), "source"), weights, block)
    places = places.select("slot", "position", source("source").alias("__kb_s"), F.col("doc_id").alias("__kb_d"))
    places = places.withColumn("__kb_k", F.row_number().over(Window.partitionBy("__kb_s", "__kb_d").orderBy("slot", "position")))
    places = places.select("__kb_s", "__kb_d", "__kb_k", (F.col("slot") * (1 << 31) + F.col("position")).alias("__kb_place"))
    rows = rows.withColumn("__kb_k2", F.row_number().over(Window.partitionBy("__kb_s2", "__kb_d2").orderBy(F.xxhash64(*plain))))
    same = (F.col("__kb_s") == F.col("__kb_s2")) & (F.col("__kb_d") == F.col("__kb_d2")) & (F.col("__kb_k") == F.col("__kb_k2"))
    placed = rows.join(places, same).drop("__kb_s", "__kb_d", "__kb_k", "__kb_s2", "__kb_d2", "__kb_k2")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "__kb_place").sortWithinPartitions("__kb_place").select(*docs.columns)
