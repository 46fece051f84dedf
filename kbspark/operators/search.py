"""Full-text (BM25), vector and hybrid retrieval, and ranking metrics."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions.text import parse_query, path_terms, tokens
from kbspark.interfaces import TextIndex
from kbspark.sources.durable import new_path, release, written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Index:
    """docs (doc, path, blob, labels, len, start) and postings of two kinds (token, found: of, at).

    Texts are indexed once a content: in texts, of is a blob.  What an entry has besides, its path, labels and the terms of its
    path, is heads, where of is a doc; their positions have a gap between, so no phrase spans two of them, and a document's text
    follows the terms at start.  heads may hold documents that docs doesn't, texts contents that no document has; they count for
    nothing.  Postings stay with the task that made them, which lists a token once for about PIECE words, in the order of the
    tokens; so none are shuffled.  A query reads the pages that its tokens fall in, and no text.
    """

    docs: DataFrame
    heads: DataFrame
    texts: DataFrame


POSTING, DOC = "token string, found array<struct<of string, at array<int>>>", "doc string, path string, blob string, labels array<string>, len int, start int"
#: Words that are inverted at a time.
PIECE = 1_000_000
#: Bytes of a row group of postings, and of the keys that it may list once and refer to, which a group of this size doesn't reach unless
#: texts have a few words only.  With Parquet's own 1 MB, tasks of over about 15,000 texts write a key in full for each of its words.
GROUP, KEYS = 16 << 20, 32 << 20


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _inverted(batches):
    """Rows (key, words) as postings.  The empty word lists every key with its number of words."""

    def piece(keys, words):
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        place = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        code = rank[coded.indices.to_numpy(zero_copy_only=False)]
        of, pos = np.repeat(np.arange(len(keys)), lengths), np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(code, kind="stable")
        if len(place) and coded.dictionary[place[0].item()].as_py() == "":  # gaps
            order = order[np.searchsorted(code[order], 1) :]
        code = np.concatenate([np.full(len(keys), -1), code[order]])
        of, pos = np.concatenate([np.arange(len(keys)), of[order]]), np.concatenate([lengths, pos[order]])
        pairs = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1])))
        heads = code[pairs]
        begins = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
        found = pa.StructArray.from_arrays([keys.take(pa.array(of[pairs])), _lists(pairs, pa.array(pos, pa.int32()))], ["of", "at"])
        tokens = pa.concat_arrays([pa.array([""], coded.dictionary.type), coded.dictionary.take(pa.array(place[heads[begins[1:]]]))])
        return pa.RecordBatch.from_arrays([tokens, _lists(begins, found)], names=["token", "found"])

    for batch in batches:
        upto = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield piece(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))


def write_postings(rows: DataFrame, place: str) -> None:
    rows.write.option("parquet.block.size", GROUP).option("parquet.dictionary.page.size", KEYS).parquet(place)


def text_postings(texts: DataFrame, place: str) -> None:
    """Writes postings and sizes (blob, n) of contents (blob, text; null: no tokens), each read once."""
    cut = texts.select("blob", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("toks"))
    write_postings(cut.mapInArrow(_inverted, POSTING), f"{place}/postings")
    held = texts.sparkSession.read.schema(POSTING).parquet(f"{place}/postings").where("token = ''").selectExpr("inline(found)")
    held.select(F.col("of").alias("blob"), F.col("at")[0].alias("n")).write.parquet(f"{place}/sizes")


def head_postings(entries: DataFrame, sizes: DataFrame, name: str, place: str) -> None:
    """Writes docs and the postings of their paths and labels for entries (path, blob, labels) without their texts, whose sizes (blob, n) are known."""
    none, gap = F.array().cast("array<string>"), F.array(F.lit(""))
    parts = [F.coalesce(tokens(x), none) for x in (F.col("path"), F.array_join("labels", " "), path_terms("path"))]
    cut = entries.join(sizes, "blob", "left").select("path", "blob", "labels", F.coalesce("n", F.lit(0)).alias("n"), F.concat(parts[0], gap, parts[1], gap, parts[2]).alias("toks"))
    cut = written(cut.withColumn("doc", F.concat_ws("-", F.lit(name), F.monotonically_increasing_id().cast("string"))), "heads")
    start = F.size("toks")
    cut.select("doc", "path", "blob", "labels", (start - 2 + F.col("n")).cast("int").alias("len"), start.alias("start")).write.parquet(f"{place}/docs")
    write_postings(cut.select("doc", "toks").mapInArrow(_inverted, POSTING), f"{place}/postings")
    release(cut)


def indexed(entries: DataFrame, path: str = "", contents: DataFrame | None = None) -> Index:
    """The index of entries (path, blob, labels, text), each content read once; kept under path, or as an intermediate.

    contents (blob, text), which may repeat: where the texts are read if entries, for their labels, come out of a join that texts
    needn't go through.
    """
    spark = entries.sparkSession
    place = path or new_path(spark, "index")
    text_postings((entries if contents is None else contents).select("blob", "text").dropDuplicates(["blob"]), f"{place}/contents")
    head_postings(entries.select("path", "blob", "labels"), spark.read.schema("blob string, n int").parquet(f"{place}/contents/sizes"), "d", f"{place}/heads")
    return opened(spark, place)


def opened(spark: SparkSession, path: str) -> Index:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Index(read("heads/docs", DOC), read("heads/postings", POSTING), read("contents/postings", POSTING))


def _begins(rows: DataFrame, phrase: list[str]) -> DataFrame:
    """of, at: of each word of the phrase where it stands, where the phrase would begin; the last word is a prefix."""
    *first, last = phrase
    at = lambda held, j: held.selectExpr("inline(found)").select("of", F.explode("at").alias("at")).select("of", (F.col("at") - j).alias("at"))
    out = at(rows.where(F.col("token").startswith(last)), len(first))
    for j, word in enumerate(first):
        out = out.unionByName(at(rows.where(F.col("token") == word), j))
    return out


def _occurrences(index: TextIndex, phrase: list[str]) -> DataFrame:
    """doc, n: how often the phrase occurs.

    Inside texts it is counted once a content; only where it begins before a text, the text's words meet each document of it.
    """

    def times(rows: DataFrame) -> DataFrame:
        whole = rows.groupBy("of", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(phrase))
        return whole.groupBy("of").agg(F.count(F.lit(1)).alias("n"))

    docs = index.docs.select("doc", "blob", "start")
    if len(phrase) == 1:
        single = lambda rows: rows.where(F.col("token").startswith(phrase[0])).selectExpr("inline(found)").groupBy("of").agg(F.sum(F.size("at")).alias("n"))
        texts, heads = single(index.texts), single(index.heads)
    else:
        texts, heads = _begins(index.texts, phrase), _begins(index.heads, phrase)
        before = texts.where("at < 0").join(docs, F.col("of") == F.col("blob")).select(F.col("doc").alias("of"), (F.col("at") + F.col("start")).alias("at"))
        texts, heads = times(texts.where("at >= 0")), times(heads.unionByName(before))
    inside = texts.join(docs, F.col("of") == F.col("blob")).select("doc", "n")
    return inside.unionByName(heads.select(F.col("of").alias("doc"), "n")).groupBy("doc").agg(F.sum("n").alias("n"))


def full_text(index: TextIndex, query: str, limit: int = 20, mode: str | None = None) -> DataFrame:
    """path, blob, labels, score, rank: all phrases, or any where no row has all (mode 'and' / 'or' fixes it).

    The counts of the phrases come from the postings; the corpus figures are one aggregate row, joined back as a bounded broadcast.
    """
    phrases = parse_query(query)
    if not any(phrases):
        return index.docs.select("path", "blob", "labels", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    limit = limit if limit > 0 else 20
    n = range(len(phrases))
    found = None
    for i in n:
        if phrases[i]:  # a field without a token never occurs
            rows = _occurrences(index, phrases[i]).select("doc", F.lit(i).alias("i"), "n")
            found = rows if found is None else found.unionByName(rows)
    counts = found.groupBy("doc").agg(*(F.sum(F.when(F.col("i") == i, F.col("n")).otherwise(0)).alias(f"f{i}") for i in n))
    counts = counts.join(index.docs.select("doc", "path", "blob", "labels", "len"), "doc")
    everything = F.lit(True)
    for i in n:
        everything = everything & (F.col(f"f{i}") > 0)
    stats = counts.agg(F.max(everything.cast("int")).alias("strict"), *(F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in n))
    corpus = index.docs.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("avgdl"))
    rows = counts.join(F.broadcast(stats.join(F.broadcast(corpus))))
    wanted = {"and": F.lit(1), "or": F.lit(0)}.get(mode or "", F.col("strict")) == 1
    rows = rows.where(~wanted | everything)
    score = F.lit(0.0)
    for i in n:
        idf = F.log((F.col("rows") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    top = rows.withColumn("score", score).orderBy(F.desc("score"), "path").limit(limit).select("path", "blob", "labels", "score")
    return ranked(top)


def _by_row(batches, phrases: int):
    """Of rows (len, hits, ...), a few at a time: where they are, and how often each phrase occurs in each."""
    step = max(1, 4_000_000 // max(1, phrases))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            hits = part.column(1)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(hits).to_numpy(zero_copy_only=False))
            coded = hits.flatten().to_numpy(zero_copy_only=False)
            f = np.bincount(row * phrases + (coded >> 32), weights=coded & 0xFFFFFFFF, minlength=part.num_rows * phrases)
            yield part, f.reshape(part.num_rows, phrases)


def _hits_of_words(words: dict[str, int]):
    """Postings (token, found) as rows (of, hits): the number of each word that a token begins with << 32, and how often it occurs."""
    lengths = sorted({len(w) for w in words})

    def run(batches):
        for batch in batches:
            begun = [[words[w] for n in lengths if n <= len(t) and (w := t[:n]) in words] for t in batch.column(0).to_pylist()]
            found, each = batch.column(1), np.array([len(x) for x in begun], np.int64)
            sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            rows = np.repeat(np.arange(len(begun)), each)  # a token, once for each word that it begins with
            number, many = np.array([x for y in begun for x in y], np.int64), sizes[rows]
            pick = np.repeat(starts[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            pairs = found.flatten()
            keys, times = pairs.field("of").dictionary_encode(), pc.list_value_length(pairs.field("at")).to_numpy(zero_copy_only=False)
            of = keys.indices.to_numpy(zero_copy_only=False)[pick].astype(np.int64)
            both, back = np.unique(of * len(words) + np.repeat(number, many), return_inverse=True)
            total = np.bincount(back, weights=times[pick], minlength=len(both)).astype(np.int64)
            of, hits = both // len(words), (both % len(words) << 32) + total
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(of[begins])), _lists(begins, pa.array(hits, pa.int64()))], names=["of", "hits"])

    return run


def _begin_with(rows: DataFrame, words) -> DataFrame:
    """Postings of tokens that begin with any of a stated set of words."""
    wanted = F.lit(False)
    for n in sorted({len(w) for w in words}):
        wanted = wanted | F.substring("token", 1, n).isin([w for w in words if len(w) == n])
    return rows.where(wanted)


def _hits_of_phrases(index: TextIndex, phrases: dict[tuple[str, ...], int]) -> tuple[DataFrame, DataFrame]:
    """The same rows for phrases of several words, of texts and of heads."""
    spark, docs = index.docs.sparkSession, index.docs.select("doc", "blob", "start")
    words = [(w, j == len(p) - 1, i, len(p), j) for p, i in phrases.items() for j, w in enumerate(p)]
    asked = F.broadcast(spark.createDataFrame(words, "word string, last boolean, no long, k int, j int"))  # a stated set

    def begins(rows: DataFrame) -> DataFrame:
        said = F.when(F.col("last"), F.col("token").startswith(F.col("word"))).otherwise(F.col("token") == F.col("word"))
        met = _begin_with(rows, {w[0] for w in words}).join(asked, said).select("no", "k", "j", F.inline("found"))
        return met.select("no", "k", "of", F.explode("at").alias("at"), "j").select("no", "k", "of", (F.col("at") - F.col("j")).alias("at"))

    def times(rows: DataFrame) -> DataFrame:
        whole = rows.groupBy("of", "no", "k", "at").agg(F.count(F.lit(1)).alias("n")).where("n = k")
        return whole.groupBy("of", "no").agg(F.count(F.lit(1)).alias("f")).select("of", F.array(F.shiftleft("no", 32) + F.col("f")).alias("hits"))

    texts = begins(index.texts)
    before = texts.where("at < 0").join(docs, F.col("of") == F.col("blob")).select("no", "k", F.col("doc").alias("of"), (F.col("at") + F.col("start")).alias("at"))
    return times(texts.where("at >= 0")), times(begins(index.heads).unionByName(before))


def full_text_documents(index: TextIndex, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """path, found (qid, score): each row with the queries of a stated set (qid, text) that find it.

    scope (path, qids): the queries that may; those a row isn't in the scope of still count it for the corpus figures.  Each
    distinct phrase is looked up once, and what a document has of all of them is one row of numbers.
    """
    spark = index.docs.sparkSession
    asked = [(r["qid"], [tuple(p) for p in parse_query(r["text"] or "")]) for r in queries.select("qid", "text").collect()]
    phrases = {p: i for i, p in enumerate(dict.fromkeys(p for _, ps in asked for p in ps if p))}
    if not phrases:
        return spark.createDataFrame([], "path string, found array<struct<qid string, score double>>")
    single, several = {p[0]: i for p, i in phrases.items() if len(p) == 1}, {p: i for p, i in phrases.items() if len(p) > 1}
    hits: list[list[DataFrame]] = [[], []]
    if single:
        run = _hits_of_words({w: k for k, w in enumerate(single)})
        at = np.array(list(single.values()), np.int64)

        def numbered(batches):
            for b in run(batches):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False)
                moved = pa.array((at[x >> 32] << 32) + (x & 0xFFFFFFFF), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(b.column(1).offsets, moved)], names=["of", "hits"])

        for held, rows in zip(hits, (index.texts, index.heads), strict=True):
            held.append(_begin_with(rows, single).mapInArrow(numbered, "of string, hits array<bigint>"))
    if several:
        for held, rows in zip(hits, _hits_of_phrases(index, several), strict=True):
            held.append(rows)
    together = []
    for held in hits:
        rows = held[0] if len(held) == 1 else held[0].unionByName(held[1])
        together.append(rows.groupBy("of").agg(F.flatten(F.collect_list("hits")).alias("hits")))
    docs = index.docs.select("doc", "path", "blob", "len")
    if scope is not None:
        docs = docs.join(scope.select("path", "qids"), "path", "left")
    docs = docs.join(together[1].select(F.col("of").alias("doc"), F.col("hits").alias("h")), "doc", "left")
    docs = docs.join(together[0].select(F.col("of").alias("blob"), F.col("hits").alias("t")), "blob", "left")
    none = F.array().cast("array<bigint>")
    docs = docs.select("len", F.concat(F.coalesce("h", none), F.coalesce("t", none)).alias("hits"), "path", *(["qids"] if scope is not None else []))
    docs = written(docs.where(F.size("hits") > 0), "hits-of-documents")

    n, numbers = len(phrases), [[phrases.get(p, -1) for p in ps] for _, ps in asked]
    longest = max(map(len, numbers))
    nth = np.array([x + [-2] * (longest - len(x)) for x in numbers])  # -1: a field without a token, which never occurs; -2: no more fields

    column = np.maximum(nth, 0)

    def every(f: np.ndarray) -> np.ndarray:
        out = np.repeat((nth[:, 0] != -2)[None, :], len(f), 0)
        for i in range(longest):
            out &= np.where(nth[:, i] >= 0, f[:, column[:, i]] > 0, nth[:, i] == -2)
        return out

    def figures(batches):
        has, strict = np.zeros(n, np.int64), np.zeros(len(asked), np.int64)
        for _, f in _by_row(batches, n):
            has += (f > 0).sum(0)
            strict |= every(f).any(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + len(asked))), pa.array(np.concatenate([has, strict]))], names=["i", "n"])

    # bounded by the stated set: a number for each phrase and each query
    told = docs.select("len", "hits").mapInArrow(figures, "i long, n long").groupBy("i").agg(F.sum("n").alias("df")).join(F.broadcast(index.docs.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("avgdl"))))
    idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    told = {r["i"]: r for r in told.select("i", "df", "avgdl", F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf).alias("idf")).collect()}
    if not told:
        return spark.createDataFrame([], "path string, found array<struct<qid string, score double>>")
    avgdl, weight = told[0]["avgdl"], np.array([told[i]["idf"] if i < n and told[i]["df"] else 0.0 for i in range(n)])
    strict = np.array([told[n + i]["df"] > 0 for i in range(len(asked))])
    ids = pa.array([q for q, _ in asked], pa.string())

    def scores(batches):
        order = {q: i for i, (q, _) in enumerate(asked)}
        for part, f in _by_row(batches, n):
            length = part.column(0).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            parts = weight * f * (K1 + 1) / (f + K1 * (1 - B + B * length / avgdl))
            score, any_ = np.zeros((len(f), len(asked))), np.zeros((len(f), len(asked)), bool)
            for i in range(longest):  # added in the order of the phrases, so rows that tie do so to the last digit
                there = nth[:, i] >= 0
                score += np.where(there, parts[:, column[:, i]], 0.0)
                any_ |= there & (f[:, column[:, i]] > 0)
            ok = np.where(strict, every(f), any_)
            if part.num_columns > 3:
                allowed = np.zeros_like(ok)
                for i, qids in enumerate(part.column(3).to_pylist()):
                    allowed[i, [order[q] for q in qids or () if q in order]] = True
                ok &= allowed
            row, query = np.nonzero(ok)
            begins = np.searchsorted(row, np.arange(len(f)))
            found = pa.StructArray.from_arrays([ids.take(pa.array(query)), pa.array(score[row, query])], ["qid", "score"])
            yield pa.RecordBatch.from_arrays([part.column(2), _lists(begins, found)], names=["path", "found"])

    return docs.mapInArrow(scores, "path string, found array<struct<qid string, score double>>").where(F.size("found") > 0)


def full_text_batch(index: TextIndex, queries: DataFrame) -> DataFrame:
    """qid, path, score of every row that a query of a stated set (qid, text) finds: its whole ranking."""
    return full_text_documents(index, queries).select("path", F.inline("found")).select("qid", "path", "score")


def in_scope(scored: DataFrame, scope: DataFrame) -> DataFrame:
    """qid, path, rank of rankings (qid, path, score), cut to the scope (qid, path) of each query before they are numbered."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path"))
    return scored.join(scope, ["qid", "path"], "left_semi").select("qid", "path", rank.alias("rank"))


def vector_scores(chunks: DataFrame, queries: DataFrame, scope: DataFrame) -> DataFrame:
    """qid, path, score for the paths in the scope of each query (qid, q) only: its whole ranking there."""
    pairs = scope.select("qid", "path").join(chunks.select("path", "vec"), "path").join(F.broadcast(queries.select("qid", "q")), "qid")  # a stated set
    return pairs.groupBy("qid", "path").agg(F.max(dot("vec", "q")).alias("score"))


def fuse_batch(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the rankings (qid, path, rank) of each query."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    score = out.groupBy("qid", "path").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return score.select("qid", "path", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path")).alias("rank"))


def evaluate(benchmark, cache, mode: str = "hybrid") -> DataFrame:
    """Metrics of each question of a benchmark; rankings are cut to a question's scope before they are fused and judged."""
    found = []
    entries = benchmark.files.select("path", F.concat(F.lit("s2:"), F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), F.array().cast("array<string>").alias("labels"), "text")
    if mode != "vector":
        found.append(in_scope(full_text_batch(indexed(entries), benchmark.queries), benchmark.scope))
    if mode != "fts":
        cache.drain(entries)
        held = benchmark.queries.select("qid", "text").collect()  # a stated set
        asked = benchmark.queries.sparkSession.createDataFrame([(r["qid"], cache.query(r["text"])) for r in held], "qid string, q array<double>")
        found.append(in_scope(vector_scores(cache.chunks_of(entries), asked, benchmark.scope), benchmark.scope))
    return metrics(fuse_batch(*found) if mode == "hybrid" else found[0], benchmark.gold)


def ranked(top: DataFrame) -> DataFrame:
    """Numbers an already limited list."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def normalise(v: str):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def vector(chunks: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    """path, score, rank by the best chunk of a path; chunks (path, vec); lengths must agree."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.withColumn("q", q).withColumn("ok", F.when(F.size("vec") != len(query), F.raise_error(F.lit("vector length differs"))).otherwise(F.lit(True))).where("ok").withColumn("s", dot("vec", "q"))
    return ranked(scored.groupBy("path").agg(F.max("s").alias("score")).orderBy(F.desc("score"), "path").limit(limit if limit > 0 else 20))


def _packed(column: str, names: tuple[str, ...]):
    """One row a block: its number, its vectors as doubles, and names as they are."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(part[column].to_numpy()).astype(np.float64)
        return pd.DataFrame({"block": [part["block"].iloc[0]], "data": [pickle.dumps((vectors, *(part[n].tolist() for n in names)))]})

    return run


def _scored(limit: int):
    """Rows in the order of (block, turn): a block of chunks (turn -1), then the blocks of queries for it."""

    def best(vectors, paths, queries, ids, skips):
        order = np.argsort(np.array(paths, object), kind="stable")
        names, first = np.unique(np.array(paths, object)[order], return_index=True)
        vectors = vectors[order]
        pooled = np.maximum.reduceat(queries @ vectors.T, first, axis=1)
        most = min(len(names), limit + 1)  # one more than wanted: the path to skip may be among them
        cut = np.partition(pooled, len(names) - most, axis=1)[:, len(names) - most]
        ends = np.append(first[1:], len(vectors))
        for q in range(len(ids)):
            # products of matrices round by place, so what is near the cut is multiplied once more, one by one
            for p in np.flatnonzero(pooled[q] >= cut[q] - 1e-9 * (1 + abs(cut[q]))).tolist():
                if names[p] != skips[q]:
                    yield ids[q], names[p], float((vectors[first[p] : ends[p]] * queries[q]).sum(axis=1).max())

    def run(batches):
        chunks = None
        for batch in batches:
            for turn, data in zip(batch.column("turn").to_pylist(), batch.column("data"), strict=True):
                if turn < 0:
                    chunks = pickle.loads(data.as_py())
                    continue
                rows = list(best(*chunks, *pickle.loads(data.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["qid", "path", "s"])

    return run


def vector_batch(chunks: DataFrame, queries: DataFrame, limit: int = 20, rows: int = 8192, most: int = 512) -> DataFrame:
    """qid, path, score, rank of the best paths for a stated set of queries (qid, q, and skip, a path left out, if there) against all chunks (path, vec).

    Chunks are dealt to blocks of about rows, queries to blocks of about most; each block of chunks stays in one task, the
    blocks of queries come to it one at a time, and of each only the best limit paths a query go on.
    """
    spark = chunks.sparkSession
    if "skip" not in queries.columns:
        queries = queries.withColumn("skip", F.lit(None).cast("string"))
    chunks, queries = chunks.select("path", "vec").where("path is not null and vec is not null"), queries.select("qid", "q", "skip").where("q is not null")
    # two counts: numbers of blocks
    n = -(-chunks.count() // rows) or 1
    m = -(-queries.count() // most) or 1
    held = chunks.withColumn("block", F.expr(f"cast(pmod(xxhash64(path, monotonically_increasing_id()), {n}) as int)")).groupBy("block").applyInPandas(_packed("vec", ("path",)), "block int, data binary")
    asked = queries.withColumn("block", F.expr(f"cast(pmod(xxhash64(qid), {m}) as int)")).groupBy("block").applyInPandas(_packed("q", ("qid", "skip")), "block int, data binary")
    asked = asked.select(F.col("block").alias("turn"), "data").withColumn("block", F.explode(F.expr(f"sequence(0, {n - 1})")))
    both = held.select("block", F.lit(-1).alias("turn"), "data").unionByName(asked.select("block", "turn", "data"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(tasks, "block").sortWithinPartitions("block", "turn").select("turn", "data").mapInArrow(_scored(limit), "qid long, path string, s double")
    best = found.groupBy("qid", "path").agg(F.max("s").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= limit)


def fuse(*lists: DataFrame, k: int = 60, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of (path, rank) lists."""
    out = lists[0].select("path", "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select("path", "rank"))
    return ranked(out.groupBy("path").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "path").limit(limit))


CUTS = (1, 3, 5, 10)


def _figures(rank, cuts: tuple[int, ...]) -> list:
    """Of the gold rows of one query by their ranks (null: not found)."""
    gain = F.when(rank <= 10, 1 / F.log2(rank + 1.0)).otherwise(0.0)
    return [*(F.sum(F.coalesce((rank <= k).cast("int"), F.lit(0))).alias(f"h{k}") for k in cuts), F.min(rank).alias("first"), F.sum(gain).alias("dcg")]


def metrics_of(hits: DataFrame, sizes: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """metrics by hits (qid, rank), the gold rows that were found, and sizes (qid, gold), how many there are."""
    return _told(sizes.select("qid", "gold").join(hits.groupBy("qid").agg(*_figures(F.col("rank"), cuts)), "qid", "left"), cuts)


def _told(out: DataFrame, cuts: tuple[int, ...], *more: str) -> DataFrame:
    ideal = F.expr("aggregate(sequence(1, least(10, cast(gold as int))), 0D, (s, i) -> s + 1 / log2(i + 1.0D))")
    out = out.fillna(0, [*(f"h{k}" for k in cuts), "dcg"])
    return out.select("qid", *(F.round(F.col(f"h{k}") / F.col("gold"), 6).alias(f"recall_{k}") for k in cuts), *((F.col(f"h{k}") > 0).cast("int").alias(f"hit_{k}") for k in cuts), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg_10"), *more)


def metrics(found: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """qid, recall and hit at the cuts, mrr, ndcg10 of found (qid, path, rank) for the queries with gold (qid, path)."""
    gold = gold.select("qid", "path").distinct()
    return metrics_of(found.join(gold, ["qid", "path"]), gold.groupBy("qid").agg(F.count(F.lit(1)).alias("gold")), cuts)


def metrics_of_modes(scored: DataFrame, k: int = 60, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """metrics and mode of text, of vectors and of both fused, in scored (qid, path, text, near, good): all rows of the scope of each
    query once, with their scores where they have one.  The rows are dealt by query once for all three rankings.
    """
    of = lambda score: Window.partitionBy("qid").orderBy(F.desc_nulls_last(score), "path")
    place = lambda score: F.when(F.col(score).isNotNull(), F.row_number().over(of(score)))
    rows = scored.withColumn("fts", place("text")).withColumn("vector", place("near"))
    share = lambda rank: F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))
    rows = rows.withColumn("both", F.when(F.coalesce("fts", "vector").isNotNull(), share("fts") + share("vector"))).withColumn("hybrid", place("both"))
    modes = ("fts", "vector", "hybrid")
    sums = rows.where("good").groupBy("qid").agg(F.count(F.lit(1)).alias("gold"), *(c.alias(f"{m}-{i}") for m in modes for i, c in enumerate(_figures(F.col(m), cuts))))
    names = [*(f"h{k}" for k in cuts), "first", "dcg"]
    each = F.array(*(F.struct(F.lit(m).alias("mode"), *(F.col(f"{m}-{i}").alias(x) for i, x in enumerate(names))) for m in modes))
    return _told(sums.select("qid", "gold", F.inline(each)), cuts, "mode")
