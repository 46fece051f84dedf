"""op 12: spelling variants by a positional q-gram inverted index with a count filter.

Words are counted over all texts.  Two words within one edit agree in one half at a fixed place: with h = s // 2 for the
length s of the shorter one, in the first h characters or in the last s - h.  So the index is dealt to blocks by length and
half, and a pair meets in exactly one of them (in the block of the last half only if the first halves differ).  A block keeps an inverted index of the
q-grams (q = ``Q``, padded ends) that reach beyond the shared half: gram and position -> numbers of words, rising.  A word's lists are
those of its grams at their position, or, against words that are longer by one, at theirs and the next (position and length limits).  Of m
lists a near word must be in all but q (q - 1 of a longer word's), so the q + 1 (q) shortest are merged through a heap, and what comes out is counted on through the
other lists; pairs whose count reaches the bound are verified character by character.  Words are put into the index after they
have asked it, so each pair comes once.

Blocks are streamed, one at a time; of a block with more than ``BLOCK`` words, the index is dealt to parts of about that many and every word asks
each part, so memory is bounded and nothing is left out.  A word's form is the near word of the largest count, if that is at
least twice its own; since counts double along forms, chains are short, and roots are found by pointer doubling.

Defined cases: null and empty texts have no words; repeated rows count each; rows without a doc_id count with no character
deleted; ties of counts go to the smaller word in code-point order; an empty table gives an empty result.  Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

LEAST_CHARS, LEAST_COUNT, SHARE = 5, 3, 97
#: A form is at least so many times as frequent.
TIMES = 2
Q, BLOCK = 3, 50_000
#: Distinct words a task counts before it gives them on.
HELD = 1 << 18
_RUNS = re.compile("[a-zÀ-ÿ]+")
_PAIR = "word string, n long, other string, other_n long"


def counted(text: bytes, doc: int | None) -> Counter[str]:
    """Words of one text, lower-cased, with the characters deleted that their checksum says."""
    out: Counter[str] = Counter()
    start = zlib.crc32(f"{doc}:".encode()) if doc is not None else 0
    for run, n in Counter(_RUNS.findall(text.lower().decode(errors="replace"))).items():
        if doc is not None and not (h := zlib.crc32(run.encode(), start)) % SHARE:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _counts(least: int):
    def run(batches):
        held: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for word, n in counted(text.as_py(), doc).items():
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return run


def vocabulary(docs: DataFrame, least: int = LEAST_CHARS, count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of at least so many code points and occurrences."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(_counts(least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one character is inserted, deleted or replaced; b is as long as a, or longer by one."""
    if a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Block:
    """The index of one block: words that share the first or the last half, of length size or size + 1.

    first: it is the first half that is shared.
    """

    def __init__(self, size: int, first: bool):
        self.size, self.first, self.half = size, first, size // 2
        self.words: list[str] = []
        self.counts: list[int] = []
        self.same: dict[tuple[str, int], list[int]] = {}
        self.longer: dict[tuple[str, int], list[int]] = {}
        self.kinds: tuple[list[int], list[int]] = ([], [])  # numbers of the words of length size, and of the longer ones

    def _grams(self, word: str) -> list[tuple[str, int]]:
        """Grams and positions of a word, without those that lie in the shared half and the padding beyond it."""
        padded = "\x01" * (Q - 1) + word + "\x02" * (Q - 1)
        n = len(word) + Q - 1
        # gram i ends with character i of the word
        span = range(self.half, n) if self.first else range(n - (self.size - self.half))
        return [(padded[i : i + Q], i) for i in span]

    def put(self, word: str, n: int) -> None:
        lists = self.same if len(word) == self.size else self.longer
        at = len(self.words)
        self.words.append(word)
        self.counts.append(n)
        self.kinds[len(word) - self.size].append(at)
        for key in self._grams(word):
            lists.setdefault(key, []).append(at)

    def _counted(self, lists: list[list[int]], every: list[int], misses: int, has) -> Iterator[int]:
        """Numbers, of every, that are in all but misses of the lists: the misses + 1 shortest are heap-merged, the rest only looked up."""
        need = len(lists) - misses
        if need <= 0:  # very short words: the bound says nothing
            yield from every
            return
        order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
        short, rest = order[: misses + 1], order[misses + 1 :]
        held, seen = -1, 0
        for x in [*heapq.merge(*(lists[i] for i in short if lists[i])), -1]:
            if x == held:
                seen += 1
                continue
            if held >= 0:
                left = need - seen - len(rest)
                for i in rest:
                    if left > 0:
                        break
                    left += not has(held, i)
                if left <= 0:
                    yield held
            held, seen = x, 1

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words of the index within one edit of a word of length size."""
        grams, none = self._grams(word), []
        skip = None if self.first else word[: self.half]
        pad, end = "\x01" * (Q - 1), "\x02" * (Q - 1)
        if self.same:
            lists = [self.same.get(key, none) for key in grams]
            for at in self._counted(lists, self.kinds[0], Q, lambda x, i: (pad + self.words[x] + end)[grams[i][1] :].startswith(grams[i][0])):
                other = self.words[at]
                if (skip is None or not other.startswith(skip)) and one_edit(word, other):
                    yield other, self.counts[at]
        if self.longer:
            lists = []
            for gram, i in grams:
                here, next_ = self.longer.get((gram, i), none), self.longer.get((gram, i + 1), none)
                lists.append(sorted({*here, *next_}) if here and next_ else here or next_)

            def has(x: int, i: int) -> bool:
                padded, (gram, at) = pad + self.words[x] + end, grams[i]
                return padded.startswith(gram, at) or padded.startswith(gram, at + 1)

            for at in self._counted(lists, self.kinds[1], Q - 1, has):
                other = self.words[at]
                if (skip is None or not other.startswith(skip)) and one_edit(word, other):
                    yield other, self.counts[at]


def _paired(batches):
    """Rows in the order of (block, part, longer words first, word)."""
    block, name = None, None
    for batch in batches:
        found: list[tuple[str, int, str, int]] = []
        for key, part, size, first, asks, held, word, n in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "size", "first", "asks", "held", "word", "n")), strict=True):
            if (key, part) != name:
                block, name = Block(size, first), (key, part)
            if asks and block.words:
                found += [(word, n, other, m) for other, m in block.near(word)]
            if held:
                block.put(word, n)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "other", "other_n"])


def near_pairs(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n, other, other_n of each pair of words (word, n; distinct) one edit apart, once."""
    length = F.length("word")
    places = []
    for shorter in (0, 1):  # the word's own length, and that of words shorter by one
        size = length - shorter
        h = F.floor(size / 2).cast("int")
        for first in (True, False):
            half = F.substring("word", F.lit(1), h) if first else F.substring("word", length - (size - h) + 1, size - h)
            places.append(F.struct(F.concat_ws(" ", size.cast("string"), F.lit("first" if first else "last"), half).alias("block"), size.alias("size"), F.lit(first).alias("first"), F.lit(not shorter).alias("asks")))
    rows = materialize(words.select("word", "n", F.explode(F.array(*places)).alias("x")).select("x.*", "word", "n"), "word-blocks")
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("many"), F.max("asks").alias("met")).where("many > 1 and met")
    parts = F.ceil(F.col("many") / most)
    dealt = rows.join(sizes, "block").withColumn("own", F.expr("pmod(xxhash64(word), many)") % parts)
    # every word asks all parts of its block and is held in one; longer words don't ask
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own")))).withColumn("held", F.col("part") == F.col("own"))
    dealt = dealt.select("block", "part", "size", "first", "asks", "held", "word", "n")
    return dealt.repartition("block", "part").sortWithinPartitions("block", "part", "asks", "word").mapInArrow(_paired, _PAIR)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form, by pointer doubling."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(now)
        now = after
        if after.where("moved").isEmpty():
            return after.select("word", "root")


def group_variants(docs: DataFrame, chars: int = LEAST_CHARS, count: int = LEAST_COUNT, most: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text) that is long and frequent enough."""
    words = materialize(vocabulary(docs, chars, count), "vocabulary")
    pairs = materialize(near_pairs(words, most), "near-words")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    judged = words.join(best, "word", "left").select("word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    judged = materialize(judged, "forms")
    release(words, pairs)
    out = judged.join(_roots(judged.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
