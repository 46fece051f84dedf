"""op 9: hierarchical residual packing of token sequences.

Each partition tokenises its documents and packs their pieces by best-fit decreasing (smallest residual that still fits).
Bins filled to within ``NEAR`` tokens are final; the underfull rest travels up a tree of fan-in ``FAN`` as items of their
own, and each tree node repeats best-fit on what its children left, until one node is left.

Bins of one fill are alike, so a node packs a histogram: at most ``capacity`` fills of each child with their numbers, whatever
the number of bins.  Runs of alike items go into runs of alike bins in one step, with the same result as item by item.  A
node's plan is a list of such runs; the bins themselves, numbered by (child, fill), are moved by a join with the plan.  So
nothing is capped, no task holds the bins of a node, and tokens never move between rounds.

Defined cases: null and empty texts are one end token; repeated rows are packed once each; a null doc_id is packed like any
other; longer documents are cut into ``capacity`` pieces of which the first may be shorter; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

CAPACITY = 1024
END = 2
NEAR = 8
FAN = 8
#: A partition packs so many pieces at a time.
CHUNK = 200_000
#: A run of so many characters without white space, or of white space, is left to the tokenizers library.
LONG_RUN = 2000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, off long, fill long, part int, rank long"
#: A run of a plan: items (part, fill) of rank from to upto go m to a bin, the first at place bin0 + (rank - base) div m.
_RUNS = "grp int, part int, fill long, from long, upto long, base long, m long, bin0 long, shift long, into_fill long, into_rank long, done boolean"
#: Fixed value: the split rule of the byte-level vocabulary.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _PRINT} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINT)}


class Tokens:
    """ids of texts as the tokenizer file gives them.

    Plain texts go through the same vocabulary and merge order in tiktoken, several times faster and with equal ids; texts
    that the two libraries could split or merge otherwise, or slowly, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {_raw(piece): rank for piece, rank in self.tokenizer.get_vocab(with_added_tokens=False).items() if piece not in self.special}
        self.fast = tiktoken.Encoding("pack", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def plain(self, text: str) -> bool:
        """No control separators, scripts beyond U+2FFF, special tokens or very long unbroken runs."""
        b = np.frombuffer(text.encode(), np.uint8)
        if (b >= 0xE3).any() or ((b >= 0x1C) & (b <= 0x1F)).any() or any(s in text for s in self.special):
            return False
        return len(text) < LONG_RUN or not _LONG.search(text)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.plain(text):
            return np.array(self.fast(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _raw(piece: str) -> bytes:
    """Bytes of a vocabulary entry; byte-level vocabularies write the bytes that don't print as U+0100 and up."""
    return bytes(_BYTES[c] for c in piece)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each item, fill of each bin: best-fit decreasing with one stack of bins per residual."""
    bins, offs, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    values = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = values[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offs[i] = b, capacity - room
        fills[b] += s
        if room > s:
            stacks[room - s].append(b)
            mask |= 1 << (room - s)
    return bins, offs, np.array(fills, np.int64)


def pack_runs(parts: list[int], fills: list[int], counts: list[int], capacity: int, near: int, last: bool) -> list[tuple]:
    """Best-fit decreasing of a histogram (part, fill, count) in runs; rows (part, fill, from, upto, base, m, bin0, shift, into_fill, into_rank, done).

    Items of one fill are ranked by part.  Rank r of a part is number r - base of a run that puts m items into each bin from
    number bin0 on; the bin ends with into_fill tokens and is number into_rank + (bin - bin0) of those, or it is done.
    """
    by_fill: dict[int, list[tuple[int, int]]] = {}
    for part, fill, n in sorted(zip(parts, fills, counts, strict=True)):
        by_fill.setdefault(fill, []).append((part, n))
    room: dict[int, list[tuple[int, int]]] = {}  # residual: runs of bins [lo, hi)
    mask, bins = 0, 0
    placed = []  # fill, first rank, last rank, m, first bin, shift

    def leave(residual: int, lo: int, hi: int) -> None:
        nonlocal mask
        if lo < hi:
            room.setdefault(residual, []).append((lo, hi))
            mask |= 1 << residual

    for fill in sorted(by_fill, reverse=True):
        at, left = 0, sum(n for _, n in by_fill[fill])
        while left:
            fits = mask >> fill
            if fits:
                residual = fill + (fits & -fits).bit_length() - 1
                lo, hi = room[residual].pop()
                if not room[residual]:
                    mask ^= 1 << residual
            else:
                residual, lo = capacity, bins
                hi = lo + -(-left // (capacity // fill))
                bins = hi
            m = residual // fill
            whole = min(hi - lo, left // m)
            if whole:
                placed.append((fill, at, at + whole * m, m, lo, capacity - residual))
                leave(residual - m * fill, lo, lo + whole)
                at, left, lo = at + whole * m, left - whole * m, lo + whole
            if left and lo < hi:  # fewer than m are left: they share one bin
                placed.append((fill, at, at + left, left, lo, capacity - residual))
                leave(residual - left * fill, lo, lo + 1)
                at, left, lo = at + left, 0, lo + 1
            leave(residual, lo, hi)
    ends = []  # first bin, last bin, fill, first rank among bins of that fill
    for residual in sorted(room):
        rank = 0
        for lo, hi in sorted(room[residual]):
            ends.append((lo, hi, capacity - residual, rank))
            rank += hi - lo
    ends.sort()
    starts = [e[0] for e in ends]
    out = []
    for fill, first, stop, m, bin0, shift in placed:
        begin = 0
        for part, n in by_fill[fill]:
            a, b = max(first, begin), min(stop, begin + n)
            while a < b:
                bin_ = bin0 + (a - first) // m
                lo, hi, into, rank = ends[bisect_right(starts, bin_) - 1]
                upto = min(b, first + (hi - bin0) * m)
                out.append((part, fill, a - begin, upto - begin, first - begin, m, bin0, shift, into, rank + bin0 - lo, into >= capacity - near or last))
                a = upto
            begin += n
    return out


def _pieces(path: str, capacity: int, end: int, chunk: int):
    def run(batches):
        tokens, part, bin0 = None, TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        ranked: Counter = Counter()

        def packed():
            nonlocal rows, bin0
            lengths = np.array([r[3] for r in rows], np.int64)
            bins, offs, fills = best_fit(lengths, capacity)
            ranks = np.empty(len(fills), np.int64)  # number of each bin among the partition's of equal fill
            for b, f in enumerate(fills.tolist()):
                ranks[b] = ranked[f]
                ranked[f] += 1
            out = pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))), pa.array((part << 33) + bin0 + bins), pa.array(offs), pa.array(fills[bins]), pa.array(np.full(len(rows), part, np.int32)), pa.array(ranks[bins])],
                names=[x.split()[0] for x in _PIECES.split(", ")],
            )
            rows, bin0 = [], bin0 + len(fills)
            return out

        for batch in batches:
            tokens = tokens or Tokens(path)
            texts = batch.column("text")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.append(tokens.ids(texts[i].as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append((doc, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
                    at = stop
            if len(rows) >= chunk:
                yield packed()
        if rows:
            yield packed()

    return run


def _plan(capacity: int, near: int, last: bool):
    names = [x.split()[0] for x in _RUNS.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grp = int(part["grp"].iloc[0])
        rows = pack_runs(part["part"].tolist(), part["fill"].tolist(), part["n"].tolist(), capacity, near, last)
        return pd.DataFrame([(grp, *r) for r in rows], columns=names)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, near: int = NEAR, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    sequence_id: the tree level on which the sequence was closed (from bit 58), its node there (from bit 36; from bit 33 on
    level 0), its number in the node.
    """
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end, chunk), _PIECES), "pieces")
    # shift: place of the item's first token in the bin it is in by now; rank: of that bin, among (part, fill)
    items = pieces.where((F.col("off") == 0) & (F.col("fill") < capacity - near)).selectExpr("bin", "part", "fill", "rank", "0L as shift", "bin as into", "false as done")
    top, level = pieces.agg(F.max("part")).first()[0] or 0, 0
    while True:
        groups, level = top // fan + 1, level + 1
        open_ = items.where("not done")
        histogram = open_.groupBy("part", "fill").agg(F.count(F.lit(1)).alias("n")).withColumn("grp", (F.col("part") / fan).cast("int"))
        if level > 1:  # items that share a bin count once
            histogram = open_.select("part", "fill", "rank").distinct().groupBy("part", "fill").agg(F.count(F.lit(1)).alias("n")).withColumn("grp", (F.col("part") / fan).cast("int"))
        plan = materialize(histogram.groupBy("grp").applyInPandas(_plan(capacity, near, groups == 1), _RUNS), "plan")
        # the runs of a (part, fill) in one row: a node has a bounded number of them
        runs = plan.groupBy("part", "fill").agg(F.collect_list(F.struct(*(c for c in plan.columns if c not in ("part", "fill")))).alias("runs"))
        moved = open_.join(runs, ["part", "fill"]).withColumn("r", F.expr("filter(runs, x -> x.from <= rank and rank < x.upto)[0]"))
        moved = moved.withColumn("k", F.expr("rank - r.base")).selectExpr(
            "bin", "r.grp as part", "r.into_fill as fill", "r.into_rank + k div r.m as rank", "shift + r.shift + (k % r.m) * fill as shift",
            f"shiftleft({level}L, 58) + shiftleft(cast(r.grp as bigint), 36) + r.bin0 + k div r.m as into", "r.done as done",
        )
        before, items = items, materialize(items.where("done").unionByName(moved), "items")
        release(before, plan)
        if groups == 1:
            break
        top = groups - 1
    out = pieces.join(items.select("bin", "into", "shift"), "bin", "left")
    return out.selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "coalesce(into, bin) as sequence_id", "off + coalesce(shift, 0L) as offset")
