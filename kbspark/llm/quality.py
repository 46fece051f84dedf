"""op 10: quality rules by gradient-boosted trees over document statistics.

One Arrow pass counts each text; the trees are learned on the driver from a hash-ordered sample of labelled rows (at most
``SAMPLE``), flattened into numpy node arrays, sent as a closure of a few kilobytes and evaluated level by level over whole
batches.  ``MONOTONE`` features may only move the score one way: a split that would break the sign is never taken and children
keep within the bounds that their ancestors' splits set.

Defined cases: null and empty texts have no words and fail the base rule; without any label of both kinds the base rule decides
alone; repeated rows get equal results; null labels and labels of unknown documents are ignored.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, gram_hashes, mix

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, MIN_ROWS = 60, 3, 0.2, 32, 20
#: A text is rejected if its probability of being good is under this.
LEAST = 0.35
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "bars", "stutter", "distinct", "shorts")
#: Sign of the score's change as the feature grows; features not named are free.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "stutter": -1, "bars": -1, "marks": -1}
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def statistics(text: bytes, hashes: WordHashes) -> tuple[list[int], list[float]]:
    words = text.split()
    n = len(words)
    b = np.frombuffer(text, np.uint8)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    chars = int(((b & 0xC0) != 0x80).sum() - space[1:-1].sum())
    by = np.bincount(b, minlength=256)
    symbols = int(by[_SYMBOLS].sum())
    seen, dups, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    h = hashes.of(words)
    repeats = 0
    if n >= 3:
        g = mix(gram_hashes(h, 3))
        order = np.argsort(g, kind="stable")
        s = g[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(g), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : k + len(g)] |= hit
        repeats = int(cover.sum())
    if not n:
        return [0, 0, symbols, dups, 0], [0.0] * len(FEATURES)
    stutter = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    hs = np.sort(h)
    distinct = (1 + int((hs[1:] != hs[:-1]).sum())) / n
    edges = np.flatnonzero(space[1:] != space[:-1])  # begin and end of each word in turn
    shorts = int((edges[1::2] - edges[::2] <= 2).sum()) / n
    feats = [float(np.log1p(n)), chars / n, symbols / chars, dups / max(1, lines), repeats / n, by[_UPPER].sum() / chars, by[_DIGIT].sum() / chars, by[_MARK].sum() / n, by[ord("|")] / n, stutter, distinct, shorts]
    return [n, chars, symbols, dups, repeats], feats


def _count(batches):
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        rows = [statistics(texts[i].as_py() or b"", hashes) for i in range(len(texts))]
        counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
        feats = pa.array([r[1] for r in rows], pa.list_(pa.float64()))
        keep = [batch.column(c) for c in ("doc_id", "quality") if c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(counts[:, i]) for i in range(len(COUNTS))), feats], names=[*(c for c in ("doc_id", "quality") if c in batch.schema.names), *COUNTS, "feats"])


class Forest:
    """Trees as flat node arrays: feature (-1: leaf), threshold, left child (right is the next), value."""

    def __init__(self, base: float, trees: list[dict]):
        self.base, self.trees = base, trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(t["depth"]):
                f = t["feature"][at]
                inner = f >= 0
                at = np.where(inner, t["left"][at] + (x[rows, np.maximum(f, 0)] > t["threshold"][at]), at)
            out += t["value"][at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, monotone: dict[str, int] = MONOTONE) -> Forest | None:
    """Logistic boosting on histogram bins; None without both labels."""
    if len(y) == 0 or y.min() == y.max():
        return None
    signs = [monotone.get(f, 0) for f in FEATURES]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p0 = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    forest = Forest(float(np.log(p0 / (1 - p0))), [])
    score = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, left, value = [-1], [0.0], [0], [0.0]
        todo = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, lo, hi, d = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * float(np.clip(gs / (hs + 1), lo, hi))
            score[rows] += value[node]
            best = (1e-6, -1, 0, 0.0, 0.0)
            if d < depth and len(rows) >= 2 * MIN_ROWS:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = np.clip(gl / (hl + 1), lo, hi), np.clip((gs - gl) / (hs - hl + 1), lo, hi)
                    gain = gl * vl - 0.5 * (hl + 1) * vl**2 + (gs - gl) * vr - 0.5 * (hs - hl + 1) * vr**2 - (gs * value[node] / rate - 0.5 * (hs + 1) * (value[node] / rate) ** 2)
                    ok = (nl >= MIN_ROWS) & (len(rows) - nl >= MIN_ROWS) & ((vr - vl) * signs[j] >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            if best[1] < 0:
                continue
            _, j, k, vl, vr = best
            score[rows] -= value[node]
            feature[node], threshold[node], left[node] = j, float(edges[j][k]), len(feature)
            mid = (vl + vr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[signs[j]]
            goes = binned[rows, j] > k
            for part, (a, b) in zip((rows[~goes], rows[goes]), bounds, strict=True):
                todo.append((len(feature), part, a, b, d + 1))
                feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        forest.trees.append({"feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left), "value": np.array(value), "depth": depth})
    return forest


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Forest from at most sample labelled rows, those of the smallest hashes of doc_id."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # sample rows of two integers: under 1 MB at the default, so the side is small whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(_count, "doc_id long, quality int, " + ", ".join(f"{c} long" for c in COUNTS) + ", feats array<double>")
    got = rows.select("doc_id", "quality", "feats").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    if not len(got):
        return None
    return fit(np.array(got["feats"].tolist()), got["quality"].to_numpy(float))


def _judge(forest: Forest | None, least: float):
    def run(batches):
        for batch in _count(batches):
            n, repeats = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = (n < 50) | (100 * repeats > 50 * n)
            x = np.array(batch.column("feats").to_pylist()).reshape(-1, len(FEATURES))
            p = forest.probability(x) if forest else np.ones(len(x))
            cols = [batch.column(c) for c in ("doc_id", *COUNTS)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(~failed & (p >= least)), pa.array(p)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return run


def judge(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score (probability of good) of every row of rows (doc_id, text).

    docs: the documents that labels are of, if others than rows.
    """
    forest = learn(rows if docs is None else docs, labels, sample)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return rows.select("doc_id", "text").mapInArrow(_judge(forest, least), schema)


def _keep(forest: Forest | None, least: float, at: int, names: list[str]):
    def run(batches):
        judged = _judge(forest, least)
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            part = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], names=["doc_id", "text"])
            mask = pa.concat_arrays([b.column("kept") for b in judged([part])])
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns], names=names)

    return run


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they are; no shuffle."""
    forest = learn(docs, labels, sample)
    return docs.mapInArrow(_keep(forest, least, docs.columns.index("text"), docs.columns), docs.schema)
