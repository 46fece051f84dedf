"""op 6: language-model scoring by a hidden Markov model.

Counts of all training tokens come from a map-side combined aggregate and are kept as a table.  Every word is a symbol of the
model: each of the ``HEAD`` most frequent words one of its own, the others one of ``CLASSES`` classes by their crc32, in which they
share the class's probability in proportion to their counts plus one (one more word of each class stands for the unseen).
So rare words too have emissions that depend on the state, and the model sums to one over all sequences.  Baum-Welch starts from
a bounded sample on the driver and then runs ``ROUNDS`` times over all training texts: each batch gives its expected counts,
summed by symbol across partitions.  Both the training recursions and the scaled forward recursion of scoring run over whole
texts; texts of one length about are stepped through together, and of long ones only the values at every ``STEPS``-th token
are held, the rest being computed again on the way back.  Texts are read twice, for the counts and for a table of their
symbols as packed integers; sample, training and scoring read that table.

Counts of words outside the head come by an exact join of the documents' words with the table of counts, so nothing is capped
and only bounded data is sent.

Defined cases: null and empty texts are one end token; without training rows N and V are 0; a null doc_id is never held out;
repeated rows get equal results; an empty table gives an empty result.  Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

#: Words of their own and classes are as many as symbols of two bytes can tell apart, with the end.
CLASSES, STATES, ROUNDS = 1 << 11, 8, 2
HEAD = (1 << 16) - CLASSES - 1
#: Start sample: documents, pieces of each, tokens of a piece, rounds.
SAMPLE, SAMPLE_PIECES, SAMPLE_TOKENS, SAMPLE_ROUNDS = 1500, 4, 64, 25
#: Tokens of a sequence between the values that a training recursion holds.
STEPS = 1 << 16
#: Weight of the words' overall frequencies in a state's emissions, and of even chances in its transitions.
PRIOR, SMOOTH = 400.0, 1.0
#: Distinct words that a worker holds before it gives them on.
FLUSH = 300_000
#: Tokens that a worker steps through at a time; texts that it encodes at a time.
RUN, TEXTS = 1 << 18, 512
_SUMS = "doc_id long, held_out boolean, n_tokens long, n_known long, log_known double, log_class double"
_ENCODED = f"{_SUMS}, tail array<struct<word:string,n:long>>, ids binary"
_PLAIN = ("rid", "doc_id", "held_out", "n_tokens", "n_known", "log_known", "log_class")


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _counts(batches):
    seen: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        seen.clear()
        return batch

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i in range(len(texts)):
            seen.update(_words(texts[i].as_py()))
            if len(seen) >= FLUSH:
                yield out()
    if seen:
        yield out()


class Hmm:
    """start, move (K x K) and emit (symbols x K): plain numpy arrays; the last symbol is the end."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence ids[begin : begin + size], size 1 at least."""
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
        log = np.zeros(len(size))
        alpha = np.broadcast_to(self.start, (len(size), len(self.start)))
        for t, n in enumerate(active.tolist()):
            alpha = alpha[:n] if t == 0 else alpha[:n] @ self.move
            alpha = alpha * self.emit[ids[begin[:n] + t]]
            c = alpha.sum(axis=1)
            alpha /= c[:, None]
            log[:n] += np.log10(c)
        out = np.empty(len(size))
        out[order] = log
        return out

    def _alphas(self, ids, begin, active, lo, hi, before):
        """Scaled forward values, scales and emissions of the tokens lo to hi, from the values before (none: the start)."""
        alphas, scales, seen = [], [], []
        for t in range(lo, hi):
            n = active[t]
            e = self.emit[ids[begin[:n] + t]]
            a = (before[:n] @ self.move if t else self.start) * e
            c = a.sum(axis=1, keepdims=True)
            before = a / c
            alphas.append(before), scales.append(c), seen.append(e)
        return alphas, scales, seen

    def expected(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, totals: list[np.ndarray], steps: int = STEPS) -> None:
        """Adds the expected start, move and emit counts of whole sequences to totals."""
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        longest, k = int(size[0]), len(self.start)
        active = (len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")).tolist()
        blocks = range(0, longest, steps)
        edges = [None]  # forward values before each block
        for lo in blocks[:-1]:
            edges.append(self._alphas(ids, begin, active, lo, lo + steps, edges[-1])[0][-1])
        later = None  # of the token after: scaled emission times backward value
        for lo, edge in zip(reversed(blocks), reversed(edges), strict=True):
            hi = min(lo + steps, longest)
            alphas, scales, seen = self._alphas(ids, begin, active, lo, hi, edge)
            flat_ids, flat = [], []
            for t in range(hi - 1, lo - 1, -1):
                n, alpha = active[t], alphas[t - lo]
                beta = np.ones((n, k))
                if later is not None:
                    after = len(later)
                    totals[1] += self.move * (alpha[:after].T @ later)
                    beta[:after] = later @ self.move.T
                gamma = alpha * beta
                later = seen[t - lo] * beta / scales[t - lo]
                flat_ids.append(ids[begin[:n] + t])
                flat.append(gamma)
            at, weight = np.concatenate(flat_ids), np.concatenate(flat)
            for s in range(k):
                totals[2][:, s] += np.bincount(at, weight[:, s], len(self.emit))
        totals[0] += gamma.sum(axis=0)

    def updated(self, totals: list[np.ndarray], base: np.ndarray) -> Hmm:
        k = len(self.start)
        start = (totals[0] + SMOOTH) / (totals[0] + SMOOTH).sum()
        move = totals[1] + SMOOTH
        emit = totals[2] + PRIOR * base[:, None]
        return Hmm(start, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True)) if k else self


class Places(dict):
    """word -> its place in the head; words outside share the place after the last."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(head))
        self.outside = len(self)

    def __missing__(self, word: bytes) -> int:
        return self.outside


def _encode(head: list[bytes], counts: np.ndarray, totals: np.ndarray, end: int):
    """One row a document: its symbols as packed integers, its sums over head words, its words outside the head (tail).

    Symbols are the head's words, the classes (totals: the shares that the words of each have together) and the end.
    """

    def run(batches):
        places, m = Places(head), len(head)
        kind, logs, log_end = symbol_type(m + len(totals)), np.append(np.log10(counts + 1.0), 0.0), math.log10(end + 1.0)
        log_totals = np.log10(totals)
        for batch in (whole.slice(lo, TEXTS) for whole in batches for lo in range(0, len(whole), TEXTS)):
            texts = batch.column("text").cast(pa.binary())
            n, known, log_known, log_class, packed = [], [], [], [], []
            tail_words, tail_counts, tail_ends = [], [], [0]
            for i in range(len(texts)):
                words = _words(texts[i].as_py())
                at = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                ids = np.empty(len(words) + 1, kind)
                ids[:-1], ids[-1] = at, m + len(totals)
                outside = np.flatnonzero(at == places.outside)
                shared = 0.0
                if len(outside):
                    crc = np.fromiter((zlib.crc32(words[j]) for j in outside.tolist()), np.int64, len(outside)) % len(totals)
                    ids[outside] = m + crc
                    shared = float(log_totals[crc].sum())
                    tail = Counter(words[j] for j in outside.tolist())
                    tail_words.extend(tail.keys()), tail_counts.extend(tail.values())
                tail_ends.append(len(tail_words))
                n.append(len(ids)), known.append(len(words) - len(outside) + (end > 0))
                log_known.append(float(logs[at].sum()) + log_end), log_class.append(shared), packed.append(ids.tobytes())
            pairs = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()).cast(pa.string()), pa.array(tail_counts, pa.int64())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(log_known, pa.float64()), pa.array(log_class, pa.float64()), pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), pairs), pa.array(packed, pa.binary())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "log_known", "log_class", "tail", "ids"],
            )

    return run


def symbol_type(last: int) -> str:
    """Packed form of the symbols 0 to last."""
    return "<u2" if last < 1 << 16 else "<u4"


def _runs(column, kind: str):
    """Whole texts by length, in runs of about RUN tokens: symbols, begins, sizes, places in the column."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    held, places, total = [], [], 0
    for i in np.argsort(-size, kind="stable").tolist():
        held.append(np.frombuffer(column[i].as_py(), kind)), places.append(i)
        total += int(size[i])
        if total >= RUN:
            yield np.concatenate(held), np.cumsum(size[places]) - size[places], size[places], places
            held, places, total = [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum(size[places]) - size[places], size[places], places


def _expected(model: Hmm):
    """Rows (symbol, counts by state): -1 the starts, -2 - i the moves out of state i."""

    def run(batches):
        k = len(model.start)
        totals = [np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))]
        for batch in batches:
            for ids, begin, size, _ in _runs(batch.column("ids"), symbol_type(len(model.emit) - 1)):
                model.expected(ids, begin, size, totals)
        some = np.flatnonzero(totals[2].any(axis=1))
        if len(some):
            names = np.concatenate([some, [-1], -2 - np.arange(k)])
            rows = np.concatenate([totals[2][some], totals[0][None, :], totals[1]])
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[:, s])) for s in range(k))], names=["symbol", *(f"s{s}" for s in range(k))])

    return run


def _sampled(kind: str, tokens: int, most: int):
    """At most so many pieces of a text, spread over it."""

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column("ids").to_pylist():
                ids = np.frombuffer(x, kind)
                n = -(-len(ids) // tokens)
                at = sorted({j * n // most for j in range(most)}) if n > most else range(n)
                rows.append(np.concatenate([ids[j * tokens : (j + 1) * tokens] for j in at]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return run


def first_model(samples: list[np.ndarray], base: np.ndarray, states: int, rounds: int) -> Hmm:
    """Starts from states tied to random texts, which then sort themselves out by the words that go together."""
    rng = np.random.default_rng(11)
    emit = base[:, None] * rng.uniform(0.5, 1.5, (len(base), states))
    if samples:
        # farthest-first texts by shared frequent symbols seed the states
        rows = np.stack([np.bincount(x, minlength=len(base))[: min(2000, len(base))] for x in samples]).astype(float)
        rows = np.sqrt(rows / np.maximum(rows.sum(axis=1, keepdims=True), 1))
        picked = [int(np.argmax([len(x) for x in samples]))]
        near = rows @ rows[picked[0]]
        long = np.array([len(x) for x in samples]) >= min(SAMPLE_TOKENS, max(len(x) for x in samples))
        while len(picked) < min(states, len(samples)):
            picked.append(int(np.argmin(np.where(long, near, np.inf))))
            near = np.maximum(near, rows @ rows[picked[-1]])
        side = np.argmax(rows @ rows[picked].T, axis=1)
        for s in range(len(picked)):
            own = [x for x, c in zip(samples, side, strict=True) if c == s]
            emit[:, s] += sum((np.bincount(x, minlength=len(base)) for x in own), np.zeros(len(base))) / max(1, sum(map(len, own)))
    emit = emit + 1e-12
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
    model = Hmm(np.full(states, 1.0 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))
    if samples:
        joined = np.concatenate(samples)
        size = np.array([len(x) for x in samples])
        for _ in range(rounds):
            totals = [np.zeros(states), np.zeros((states, states)), np.zeros((len(base), states))]
            model.expected(joined, np.cumsum(size) - size, size, totals)
            model = model.updated(totals, base)
    return model


def _forward(model: Hmm):
    """The rows of _encode without tail and symbols, with the exact log10 likelihood of the symbols."""

    def run(batches):
        for batch in batches:
            got = np.zeros(len(batch))
            for ids, begin, size, places in _runs(batch.column("ids"), symbol_type(len(model.emit) - 1)):
                got[places] = model.forward(ids, begin, size)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in _PLAIN), pa.array(got)], names=[*_PLAIN, "forward"])

    return run


def score_texts(docs: DataFrame, mod: int = 7, remainder: int = 2, head: int = HEAD, n_classes: int = CLASSES, states: int = STATES, rounds: int = ROUNDS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(mod, remainder))
    train = docs.where("not held_out")
    counts = materialize(train.mapInArrow(_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = train.count()
    n, v = total + end, kinds + (end > 0)
    # head words: whole classes of about equal counts, the most frequent first, as many as fit.  A class spans 1/16 of a power
    # of two, so there are under 1024 of them; head words and counts are about 2 MB at the default, whatever the input
    rank = F.floor(F.log2(F.col("c").cast("double")) * 16)
    least, room = math.inf, head
    for r in sorted(counts.groupBy(rank.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["r"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["r"]
    top = sorted(counts.where(rank >= least).collect() if least < math.inf else [], key=lambda r: (-r["c"], r["word"]))
    words, c = [r["word"].encode() for r in top], np.array([r["c"] for r in top], np.float64)
    m = len(words)
    # what the words of a class have together: their counts plus one each, and one for the unseen; n_classes rows
    shares = np.ones(n_classes)
    rest = counts.where(rank < least) if least < math.inf else counts
    for r in rest.groupBy((F.crc32(F.col("word").cast("binary")) % n_classes).alias("k")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        shares[r["k"]] += r["s"]
    base = np.concatenate([c, shares, [end + 1]]) + 0.5
    base /= base.sum()

    encoded = docs.mapInArrow(_encode(words, c, shares, end), _ENCODED).withColumn("rid", F.monotonically_increasing_id())
    encoded = materialize(encoded, "encoded")
    train = encoded.where("not held_out")
    some = train.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    picked = train.select("doc_id", "ids").join(F.broadcast(some.distinct()), "doc_id", "left_semi")
    kind = symbol_type(m + n_classes)
    got = picked.mapInArrow(_sampled(kind, SAMPLE_TOKENS, SAMPLE_PIECES), "doc_id long, ids binary").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "ids").limit(sample).collect()
    model = first_model([np.frombuffer(r["ids"], kind) for r in got], base, states, SAMPLE_ROUNDS)

    columns = [f"s{s}" for s in range(states)]
    for _ in range(rounds if got else 0):
        sums = train.select("ids").mapInArrow(_expected(model), "symbol int, " + ", ".join(f"{x} double" for x in columns))
        # one row a symbol: head + n_classes + states + 2 at most
        sums = sums.groupBy("symbol").agg(*(F.sum(x).alias(x) for x in columns)).toPandas().sort_values("symbol")
        at, rows = sums["symbol"].to_numpy(), sums[columns].to_numpy()
        totals = [np.zeros(states), np.zeros((states, states)), np.zeros((len(base), states))]
        totals[0], totals[2][at[at >= 0]] = rows[at == -1].sum(axis=0), rows[at >= 0]
        totals[1][-2 - at[at <= -2]] = rows[at <= -2]
        model = model.updated(totals, base)

    tail = encoded.select("rid", F.explode("tail").alias("x")).select("rid", "x.word", "x.n")
    tail = tail.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.expr("n * log10(coalesce(c, 0) + 1.0D)")).alias("more"), F.sum(F.expr("if(c is null, 0L, n)")).alias("found"))
    out = encoded.select(*_PLAIN, "ids").mapInArrow(_forward(model), f"rid long, {_SUMS}, forward double").join(tail, "rid", "left")
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_known") + more - F.col("n_tokens") * F.lit(math.log10(n + 1.0 * (v + 1)))).alias("base_score"),
        (F.col("forward") + more - F.col("log_class")).alias("score"),
    )
