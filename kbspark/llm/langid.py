"""op 2: language identification by string kernels.

The kernel of two texts is the number of byte n-grams (n = 1 to 4, lower case) present in both, over the root of the product
of their numbers: a blended-spectrum presence kernel over the exact sets of n-grams, so it doesn't blur as texts grow.
Landmark texts of the labelled sample span a Nystrom feature space; one kernel ridge regression a language (+1 for its texts,
-1 for the rest) is solved in it on the driver.  Scoring multiplies a sparse matrix of the presence rows
of a batch with the landmarks' rows and the regression weights; the latter product is made first where it is the smaller.

The labelled sample is bounded in rows, not in languages: ``PER_LANG`` texts of each, fewer where more than SAMPLE / PER_LANG
languages share ``SAMPLE``, but one at least, chosen by a hash of doc_id and text and read whole.  Landmarks are dealt over the
languages in turn, from the shorter half of each one's sampled texts: ``LANDMARKS``, or four a language up to
``MOST_LANDMARKS``.  The driver gets the landmarks' texts and, of the sample, its kernel rows.  Only text and
lang of learning rows are used to learn, and only text to predict.  Prediction reads whole texts.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is everything if there is nothing to learn from;
a null doc_id is never held out and never learned from; repeated rows get equal results; an empty table gives an empty result.
Other columns than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, release

GRAMS = 4
SAMPLE, PER_LANG = 20_000, 500
LANDMARKS, MOST_LANDMARKS = 160, 2000
RIDGE = 1e-2
#: Bytes whose n-grams are made distinct at a time.
PIECE = 1 << 18
#: Numbers in the product of landmark rows and weights up to which it is made.
FOLD = 1 << 24
#: Entries of a batch's presence matrix, but for the texts that have more.
ENTRIES = 1 << 19
#: As in the SQL expression that picks what is learned from.
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams of the text's bytes; n is in the fifth byte of the code."""
    b = np.frombuffer(text.lower().encode(errors="replace"), np.uint8).astype(np.uint64)
    out = np.empty(0, np.uint64)
    for lo in range(0, len(b), PIECE):
        part = b[lo : lo + PIECE + GRAMS - 1]
        found, code = [], part
        for n in range(1, GRAMS + 1):
            if not len(code):
                break
            found.append(code | np.uint64(n << 32))
            code = (code[:-1] << np.uint64(8)) | part[n:]
        fresh = np.unique(np.concatenate(found))
        out = np.union1d(out, fresh) if len(out) else fresh
    return out


class Landmarks:
    """The presence rows of the landmark texts, by n-gram: sorted codes, and the numbers of the landmarks that have each."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        sets = [grams(t) for t in texts]
        size = np.array([len(s) for s in sets])
        every, mark = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every, kind="stable")
        self.codes, first = np.unique(every[order], return_index=True)
        self.marks, self.ends = mark[order], np.append(first, len(every))
        self.root = np.sqrt(np.maximum(size, 1))

    def __reduce__(self):
        return Landmarks, (self.texts,)  # workers count the texts again: they are smaller than the table

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' presence matrix over the codes, row by row: columns, ends of the rows; and the roots of the numbers of all n-grams."""
        columns, ends, root = [], [0], []
        for t in texts:
            g = grams(t)
            at = np.searchsorted(self.codes, g)
            at[at == len(self.codes)] = 0
            columns.append(at[self.codes[at] == g])
            ends.append(ends[-1] + len(columns[-1]))
            root.append(max(1, len(g)) ** 0.5)
        return np.concatenate(columns), np.array(ends), np.array(root)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel of each text with each landmark: the presence matrix times that of the landmarks."""
        columns, ends, root = self.presence(texts)
        many = self.ends[columns + 1] - self.ends[columns]
        marks = self.marks[np.repeat(self.ends[columns] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        row = np.repeat(np.repeat(np.arange(len(texts)), np.diff(ends)), many)
        shared = np.bincount(row * len(self.root) + marks, minlength=len(texts) * len(self.root))
        return shared.reshape(len(texts), -1) / root[:, None] / self.root

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """The landmarks' rows times weights: one row a code."""
        return np.add.reduceat((weights / self.root[:, None])[self.marks], self.ends[:-1], axis=0)

    def times(self, table: np.ndarray, texts: list[str]) -> np.ndarray:
        """The presence matrix, over the roots, times a table of one row a code."""
        columns, ends, root = self.presence(texts)
        out = np.zeros((len(texts), table.shape[1]))
        some = np.diff(ends) > 0
        if some.any():
            out[some] = np.add.reduceat(table[columns], ends[:-1][some], axis=0)
        return out / root[:, None]


class Model:
    """Scores are presence x (landmark rows x weights); where that second product is large, (presence x landmark rows) x weights."""

    def __init__(self, langs: list[str], landmarks: Landmarks, weights: np.ndarray):
        self.langs, self.landmarks, self.weights, self.table = langs, landmarks, weights, None

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression value of each language for each text, batch by batch."""
        if len(self.landmarks.codes) * len(self.langs) > FOLD:
            product = lambda part: self.landmarks.kernel(part) @ self.weights
        else:
            if self.table is None:
                self.table = self.landmarks.folded(self.weights)
            product = lambda part: self.landmarks.times(self.table, part)
        return np.concatenate([product(part) for part in batched(texts)]) if texts else np.zeros((0, len(self.langs)))


def batched(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts whose n-grams are at most ENTRIES, or one text."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        size = GRAMS * len(t)
        if held and held + size > ENTRIES:
            yield texts[lo:i]
            lo, held = i, 0
        held += size
    yield texts[lo:]


def fit(landmarks: Landmarks, marks: np.ndarray, rows: np.ndarray, langs: list[str], ridge: float = RIDGE) -> Model:
    """marks: kernel of the landmarks with one another; rows: of the sample with the landmarks."""
    names = sorted(set(langs))
    lang = np.searchsorted(np.array(names, object), np.array(langs, object))
    value, vector = np.linalg.eigh(marks)
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])  # Nystrom map: k(x, marks) @ root
    phi = rows @ root
    y = np.where(lang[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    # each language's own rows weigh as much as all others
    weight = 1.0 / np.bincount(lang)[lang]
    a = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1])
    return Model(names, landmarks, root @ np.linalg.solve(a, phi.T @ (y * weight[:, None])))


def _kernel_rows(landmarks: Landmarks):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [row for part in batched(texts) for row in landmarks.kernel(part)] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.list_(pa.float64()))], names=["lang", "k"])

    return run


def learn(docs: DataFrame, sample: int = SAMPLE, per_lang: int = PER_LANG, most: int = MOST_LANDMARKS) -> Model | None:
    """Model of the labelled rows of docs (doc_id, text, lang), each of which is a learning row."""
    rows = docs.where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    n_langs = sizes.count()
    if not n_langs:
        return None
    each = max(1, min(per_lang, sample // n_langs))
    # one and a half times as many as wanted are drawn by share, then cut by rank
    share = sizes.selectExpr("lang as l", f"cast(ceil({each} * 1.5 / n * 1048576) as bigint) + 64 as share")
    h = F.xxhash64("doc_id", "text")
    some = rows.join(share, F.col("lang") == F.col("l")).where(F.pmod(h, F.lit(1 << 20)) < F.col("share")).select("doc_id", "text", "lang", h.alias("h"))
    ranked = some.selectExpr("*", "row_number() over (partition by lang order by h, doc_id, text) as place").where(F.col("place") <= each)
    halves = ranked.selectExpr("*", "row_number() over (partition by lang order by length(text), h, doc_id) * 2 > count(*) over (partition by lang) + 1 as long")
    picked = materialize(halves.selectExpr("*", "row_number() over (partition by lang order by long, h, doc_id, text) as turn"), "learned")
    marks = min(max(LANDMARKS, 4 * n_langs), most)
    texts = [r["text"] for r in picked.orderBy("turn", "h", "lang", "doc_id").limit(marks).select("text").collect()]
    landmarks = Landmarks(texts)
    got = picked.orderBy("lang", "turn").select("text", "lang").mapInArrow(_kernel_rows(landmarks), "lang string, k array<double>").toPandas()
    release(sizes, picked)
    return fit(landmarks, landmarks.kernel(texts), np.array(got["k"].tolist()), got["lang"].tolist())


def _predict(model: Model | None):
    def run(batches):
        for batch in batches:
            texts, n = batch.column("text"), len(batch)
            langs, scores = np.full(n, "und", object), np.zeros(n)
            for lo in range(0, n, 1024):
                part = [(i, t) for i in range(lo, min(n, lo + 1024)) if (t := texts[i].as_py()) and _LETTER.search(t)] if model else []
                if not part:
                    continue
                s = model.scores([t for _, t in part])
                at, best = [i for i, _ in part], s.argmax(axis=1)
                langs[at] = np.array(model.langs, object)[best]
                scores[at] = np.clip((s[np.arange(len(part)), best] + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs.tolist(), pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, mod: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang); rows whose crc32 leaves remainder aren't learned from."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(mod, remainder))
    model = learn(docs.where("not held_out"))
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
