"""op 1: removal of long repeated spans by a compacted word-level De Bruijn graph.

The graph's edges are the 50-word windows (token k-mers), its nodes the 49 words that two consecutive windows share.  It is
built in parts: every window belongs to its *anchor*, the smallest hash among the shorter k-mers inside it, so equal windows have
one anchor wherever they stand, and only anchors that occur in two documents can hold repeated edges.  Consecutive windows of one
anchor are one row, a piece: document, start, length, anchor, a 128-bit fingerprint, and the nodes at its ends.  Equal pieces
collapse by a map-side combined aggregate.  An anchor with one piece stays one long edge, whose inner nodes aren't looked at: where
another document begins with the words of such a node and goes on otherwise, the path isn't cut there.  (Paths only group what
repeats; what is removed doesn't depend on them.)  The
pieces of an anchor with several are opened into single edges, read again at the source coordinates of one representative
each and named by a 128-bit digest of their words.  Every edge gets its source, the first document and place that hold it.

Compaction: edges entering and leaving a node are counted; an edge goes on in its successor if the two stand side by side in
one source and the node between has one way in and one way out.  A join marks the nodes that branch, and runs without a mark,
inside one source document, become paths.  What a document repeats is a list of (its place, path, place in the path), merged
to spans.  Before words are removed, the words at the source coordinates and the document's own are compared by a digest of
the words themselves, so hash collisions remove nothing.

No group is collected that isn't bounded by one document or one piece (50 windows).

Defined cases: null or empty text has no words (``kept_sha256`` of the empty string); texts under 50 words lose nothing;
rows with a null doc_id neither lose nor cause removals; rows that repeat a doc_id never remove from one another; an empty
table gives an empty result; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, gram_hashes, materialize, mix, release, signed

WINDOW = 50
KMER = 16
_M1, _M2 = 0xD6E8FEB86659FD93, 0x9E6C63D0876A9A47
_PIECES = "doc_id long, th long, p0 int, n int, anchor long, k1 long, k2 long, enters long, leaves long"
#: off -1: the whole piece.  d1, d2: digest of the words.  until: the last document that has the piece.
_EDGES = "doc_id long, th long, pos int, n int, off int, d1 long, d2 long, enters long, leaves long, k1 long, k2 long, until long"
_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(gram_hashes(h, window, _M1)), mix(gram_hashes(mix(h ^ U64(0xA5A5A5A55A5A5A5A)), window, _M2))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n, size, cur = len(x) - w + 1, 1, x
    while size * 2 <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[w - size : w - size + n])


def _nodes(h: np.ndarray, window: int) -> np.ndarray:
    """Hash of each window - 1 words: node i is entered by window i - 1 and left by window i."""
    return mix(gram_hashes(h, window - 1, _M2))


def pieces_of(h: np.ndarray, window: int = WINDOW, kmer: int = KMER):
    """p0, n, anchor, k1, k2, first node, last node of the pieces of one document's word hashes."""
    if len(h) < window:
        return None
    low = _sliding_min(mix(gram_hashes(h, kmer)), window - kmer + 1)
    w1, w2 = _window_hashes(h, window)
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate(([0], cut))
    n = np.diff(np.concatenate((starts, [len(low)])))
    if n.max() > window:  # first and last window must cover the span between them
        pieces = -(-n // window)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, left = np.repeat(starts, pieces) + inner * window, np.repeat(n, pieces) - inner * window
        n = np.minimum(left, window)
    last, un = starts + n - 1, n.astype(U64)
    k1 = mix(w1[starts] * U64(_M2) + mix(w1[last] + un))
    k2 = mix(w2[starts] * U64(_M1) + mix(w2[last] + un))
    node = _nodes(h, window)
    return starts, n, low[starts], k1, k2, node[starts], node[last + 1]


def _pieces(window: int, kmer: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            cols: list[list[np.ndarray]] = [[] for _ in range(9)]
            size = 0
            for i, (doc, th) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), strict=True)):
                got = pieces_of(hashes.of(texts[i].as_py().split()), window, kmer)
                if got is None:
                    continue
                p0, n, *longs = got
                for c, x in zip(cols, (np.full(len(p0), doc), np.full(len(p0), th), p0.astype(np.int32), n.astype(np.int32), *map(signed, longs)), strict=True):
                    c.append(x)
                size += len(p0)
                if size >= 50_000:
                    yield _batch(cols, _PIECES)
                    cols, size = [[] for _ in range(9)], 0
            if size:
                yield _batch(cols, _PIECES)

    return run


def _batch(cols: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=[x.split()[0] for x in schema.split(", ")])


class Words:
    """The words of a text, and digests of runs of them: of the words' own bytes, joined by spaces."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.joined = b" ".join(self.words)
        self.at = np.concatenate(([0], np.cumsum([len(w) + 1 for w in self.words]))).tolist()

    def digests(self, starts: list[int], stops: list[int]) -> tuple[np.ndarray, np.ndarray]:
        view, at = memoryview(self.joined), self.at
        pairs = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[at[i] : at[j] - 1]) for i, j in zip(starts, stops, strict=True)]), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _edges(window: int):
    """The listed pieces, read at their source: a row each, and one an edge of those that are to be opened."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts, lists = batch.column("text").cast(pa.binary()), batch.column("pieces")
            cols: list[list[np.ndarray]] = [[] for _ in range(12)]
            size = 0
            for i, (doc, th) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), strict=True)):
                text = Words(texts[i].as_py())
                part = lists[i].values
                p0, n, k1, k2, enters, leaves, until, many = (part.field(c).to_numpy(zero_copy_only=False) for c in ("p0", "n", "k1", "k2", "enters", "leaves", "until", "many"))
                p0, n = p0.astype(np.int64), n.astype(np.int64)
                d1, d2 = text.digests(p0.tolist(), (p0 + n + window - 1).tolist())
                parts = [(np.full(len(n), doc), np.full(len(n), th), p0, n, np.full(len(n), -1), d1, d2, enters, leaves, k1, k2, until)]
                if many.any():
                    node = signed(_nodes(hashes.of(text.words), window))
                    m = n[many]
                    off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    at = np.repeat(p0[many], m) + off
                    d1, d2 = text.digests(at.tolist(), (at + window).tolist())
                    parts.append((np.full(len(at), doc), np.full(len(at), th), at, np.ones(len(at)), off, d1, d2, node[at], node[at + 1], *(np.repeat(x[many], m) for x in (k1, k2, until))))
                for rows in parts:
                    for j, (c, x) in enumerate(zip(cols, rows, strict=True)):
                        c.append(np.asarray(x).astype(np.int32 if 2 <= j <= 4 else np.int64))
                    size += len(rows[0])
                if size >= 50_000:
                    yield _batch(cols, _EDGES)
                    cols, size = [[] for _ in range(12)], 0
            if size:
                yield _batch(cols, _EDGES)

    return run


def _cut(window: int, texts_too: bool):
    """The texts without the windows of their marks (p0, length, d1, d2, off, n), if the piece's words have the source's digest."""

    def run(batches):
        for batch in batches:
            texts, lists = batch.column("text").cast(pa.binary()), batch.column("marks")
            rows = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[i].as_py() or b""
                marks = lists[i].values if lists[i].is_valid else None
                if marks is not None and len(marks):
                    own = Words(text)
                    words, n = own.words, len(own.words)
                    p0, size, d1, d2, off, m = (marks.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p0", "length", "d1", "d2", "off", "n"))
                    e1, e2 = own.digests(p0.tolist(), (p0 + size + window - 1).tolist())
                    sure = (d1 == e1) & (d2 == e2)
                    begun = np.zeros(n + 1, np.int64)
                    np.add.at(begun, (p0 + off)[sure], 1)
                    np.add.at(begun, (p0 + off + m + window - 1)[sure], -1)
                    keep = np.cumsum(begun[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    words = text.split()
                    n = len(words)
                joined = b" ".join(words)
                rows.append((doc, n, n - len(words), hashlib.sha256(joined).hexdigest(), joined))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())]
            if texts_too:
                names, arrays = [*names, "kept_text"], [*arrays, pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _compacted(edges: DataFrame) -> DataFrame:
    """edges (d1, d2, n, doc_id, th, pos, enters, leaves) with path, the place in the source at which the edge's path begins."""
    ways = edges.select(F.col("leaves").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")).unionByName(edges.select(F.col("enters").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")))
    branching = ways.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")).where("into > 1 or out > 1").select(F.col("node").alias("enters"), F.lit(True).alias("branches"))
    marked = edges.join(branching, "enters", "left")
    own = Window.partitionBy("doc_id", "th").orderBy("pos")  # the edges of one source document
    before = F.lag(F.col("pos") + F.col("n")).over(own)
    begins = F.col("branches").isNotNull() | before.isNull() | (before != F.col("pos"))
    return marked.withColumn("begins", F.when(begins, F.col("pos"))).withColumn("path", F.last("begins", ignorenulls=True).over(own)).drop("begins", "branches")


def graph(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> tuple[DataFrame, DataFrame]:
    """(pieces (doc_id, th, p0, k1, k2) of what can repeat, runs (k1, k2, off, n, source, source_th, source_pos, path, length, d1, d2)).

    A run says that the windows off to off + n - 1 of a piece, which has length windows, stand first at the source's source_pos,
    on the path that begins at path there; d1 and d2 are the digest of the piece's words at its representative.
    """
    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("th"))
    every = materialize(known.mapInArrow(_pieces(window, kmer), _PIECES), "pieces")
    twice = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    pieces = materialize(every.join(twice, "anchor", "left_semi"), "repeated-pieces")
    release(every)

    unitigs = pieces.groupBy("anchor", "k1", "k2").agg(F.min(F.struct("doc_id", "th", "p0", "n", "enters", "leaves")).alias("r"), F.max("doc_id").alias("until"))
    unitigs = materialize(unitigs.select("anchor", "k1", "k2", "r.*", "until"), "unitigs")
    several = unitigs.groupBy("anchor").agg(F.count(F.lit(1)).alias("ways"))
    listed = unitigs.join(several, "anchor").withColumn("many", F.col("ways") > 1)
    listed = listed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("p0", "n", "k1", "k2", "enters", "leaves", "until", "many")).alias("pieces"))
    read = materialize(known.join(listed.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "th", "text", "pieces").mapInArrow(_edges(window), _EDGES), "edges")
    whole = read.where("off = -1").select("k1", "k2", "n", "d1", "d2")
    # a piece that wasn't opened is an edge itself
    opened = read.where("off >= 0").select("k1", "k2").distinct()
    plain = read.where("off = -1").join(opened, ["k1", "k2"], "left_anti").withColumn("off", F.lit(0))
    edges = materialize(read.where("off >= 0").unionByName(plain), "graph-edges")
    first = edges.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "pos", "n", "enters", "leaves")).alias("r"), F.max("until").alias("until")).select("d1", "d2", "r.*", "until")
    paths = _compacted(first.where("doc_id < until").drop("until"))  # an edge of one document is none of the graph's
    paths = materialize(paths.selectExpr("d1", "d2", "doc_id as source", "th as source_th", "pos as source_pos", "path"), "paths")
    # edges of a piece on one path are one run: two of them hold all words between, so what lies between is on it as well
    there = edges.select("k1", "k2", "off", "n", "d1", "d2").join(paths, ["d1", "d2"])
    runs = there.groupBy("k1", "k2", "source", "source_th", "path", (F.col("source_pos") - F.col("off")).alias("shift")).agg(F.min("off").alias("off"), (F.max(F.col("off") + F.col("n")) - F.min("off")).alias("m"), F.min("source_pos").alias("source_pos"))
    runs = runs.join(whole.withColumnRenamed("n", "length"), ["k1", "k2"])
    runs = materialize(runs.select("k1", "k2", "off", F.col("m").alias("n"), "source", "source_th", "source_pos", "path", "length", "d1", "d2"), "runs")
    release(read, edges, unitigs, paths)
    return pieces.select("doc_id", "th", "p0", "k1", "k2"), runs


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, start, length (words), source_id, source_start of every span of docs (doc_id, text) that stands in a document of a smaller id before.

    A span is as long as its path in the source goes on; spans of several sources may overlap.
    """
    pieces, runs = graph(docs, window, kmer)
    rows = pieces.distinct().join(runs, ["k1", "k2"]).where("source < doc_id")
    rows = rows.selectExpr("doc_id", "th", "p0 + off as start", "n", "source", "source_th", "source_pos", "source_pos - p0 - off as shift")
    own = Window.partitionBy("doc_id", "th", "source", "source_th", "shift").orderBy("start")
    begins = F.coalesce(F.lag(F.col("start") + F.col("n")).over(own) < F.col("start"), F.lit(True))
    rows = rows.withColumn("b", F.when(begins, F.col("start"))).withColumn("b", F.last("b", ignorenulls=True).over(own))
    spans = rows.groupBy("doc_id", "th", "source", "source_th", "shift", "b").agg(F.max(F.col("start") + F.col("n")).alias("stop"))
    return spans.select("doc_id", F.col("b").alias("start"), (F.col("stop") - F.col("b") + window - 1).alias("length"), F.col("source").alias("source_id"), (F.col("b") + F.col("shift")).alias("source_start"))


def remove_repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (texts) kept_text of every row of docs (doc_id, text).

    window: words in a window; kmer: words in an anchor k-mer, under window.
    """
    if not 1 < kmer < window:
        raise ValueError("1 < kmer < window")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    pieces, runs = graph(docs, window, kmer)
    marks = pieces.join(runs.select("k1", "k2", "off", "n", "source", "length", "d1", "d2"), ["k1", "k2"]).where("source < doc_id")
    marks = marks.groupBy("doc_id", "th").agg(F.collect_set(F.struct("p0", "length", "d1", "d2", "off", "n")).alias("marks"))
    out = docs.join(marks.hint("shuffle_hash"), ["doc_id", "th"], "left").select("doc_id", "text", "marks")
    return out.mapInArrow(_cut(window, texts), _KEPT + (", kept_text string" if texts else ""))
