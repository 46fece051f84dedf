"""Searches whose shuffles and tasks are to grow no faster than their tables."""

import random

from pyspark.sql import functions as F

from kbspark.operators import search
from kbspark.plans import registry

ENTRY = "path string, blob string, labels array<string>, text string"


def collection(spark):
    words = "a ab abc b-c walnut oil c".split()
    rows = [(f"p/{i:02}", f"s2:{i % 25}", ["walnut"] if i % 9 == 0 else [], " ".join(random.Random(i % 25).choices(words, k=i % 25))) for i in range(40)]
    return spark.createDataFrame(rows, ENTRY)


def test_a_document_is_one_row_for_all_queries_of_a_batch(spark):
    index = search.indexed(collection(spark))
    asked = spark.createDataFrame([("1", "a walnut"), ("2", "b-c"), ("3", "zz ab"), ("4", "&"), ("5", "wal zz &")], "qid string, text string")
    scope = spark.createDataFrame([(f"p/{i:02}", [str(i % 5 + 1), str((i + 2) % 5 + 1)]) for i in range(0, 40, 2)], "path string, qids array<string>")
    rows = search.full_text_documents(index, asked, scope).collect()
    assert len({r.path for r in rows}) == len(rows)
    got = {(x.qid, r.path, x.score) for r in rows for x in r.found}
    pairs = scope.select(F.explode("qids").alias("qid"), "path")
    assert got == {(r.qid, r.path, r.score) for r in search.full_text_batch(index, asked).join(pairs, ["qid", "path"], "left_semi").collect()}
    assert {q for q, *_ in got} == {"1", "2", "3", "5"}


def test_metrics_of_modes_are_those_of_each_ranking(spark):
    rng = random.Random(3)
    rows = [(str(q), f"p{i}", rng.choice([None, 0.5, rng.random()]), rng.choice([None, 0.5, rng.random()]), rng.random() < 0.3) for q in range(6) for i in range(30)]
    scored = spark.createDataFrame(rows, "qid string, path string, text double, near double, good boolean")
    got = {(r["mode"], r.qid): r for r in search.metrics_of_modes(scored).collect()}
    gold, scope = scored.where("good").select("qid", "path"), scored.select("qid", "path")
    text, near = (search.in_scope(scored.where(f"{c} is not null").select("qid", "path", F.col(c).alias("score")), scope) for c in ("text", "near"))
    for mode, found in (("fts", text), ("vector", near), ("hybrid", search.fuse_batch(text, near))):
        for r in search.metrics(found, gold).collect():
            assert got.pop((mode, r.qid)).asDict() == {**r.asDict(), "mode": mode}
    assert not got


def test_postings_stay_where_they_are_made(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("postings are shuffled")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", refuse)
    monkeypatch.setattr(search, "PIECE", 50)
    e = collection(spark)
    index = search.indexed(e)
    want = {}
    for r in e.collect():
        for i, t in enumerate(x for w in r.text.split() for x in w.split("-")):
            want.setdefault((t, r.blob), set()).add(i)
    rows = index.texts.where("token <> ''").select("token", F.inline("found")).collect()
    assert {(r.token, r.of): set(r.at) for r in rows} == want and len(rows) == len(want)


def test_a_key_is_not_written_in_full_for_each_of_its_words(spark, tmp_path):
    def texts(first, n):
        words = F.expr("array_join(transform(sequence(1, 12), i -> concat('w', pmod(xxhash64(id, i), 300))), ' ')")
        return spark.range(first, first + n, 1, 1).select(F.concat(F.lit("s2:"), F.sha2(F.col("id").cast("string"), 256)).alias("blob"), words.alias("text"))

    size = lambda place: sum(f.stat().st_size for f in place.glob("postings/*.parquet"))
    for n in (4000, 40000):
        search.text_postings(texts(0, n), str(tmp_path / str(n)))
    few = size(tmp_path / "4000")
    assert size(tmp_path / "40000") < 12 * few
    store = registry.textindex.IndexStore(spark, str(tmp_path / "index"))
    for name, n, before in (("M1", 20000, None), ("M2", 40000, "M1")):
        entries = texts(0, n).select(F.concat(F.lit("p/"), "blob").alias("path"), "blob", F.array().cast("array<string>").alias("labels"))
        store.update(name, entries, lambda blobs: texts(0, 40000).join(blobs, "blob", "left_semi"), before)
    (merged,) = store._state("M2")["texts"]
    assert merged["rows"] == 40000 and size(tmp_path / "index" / merged["at"]) < 12 * few


def test_gold_is_not_listed_as_pairs(spark, sf, monkeypatch):
    def refuse(*_):
        raise AssertionError("the gold is a list of pairs")

    c, asked = registry._asked(spark, sf)
    gold = c.select("path", "label").join(asked.select("qid", "label", "skip"), "label").where("path <> skip").select("qid", "path")
    found = search.vector_batch(c, asked, 10).select("qid", "path", "rank")
    want = sorted(map(tuple, search.metrics(found, gold).collect()))
    monkeypatch.setattr(search, "metrics", refuse)
    assert sorted(map(tuple, registry.eval_metrics(spark, sf).collect())) == want


def test_texts_to_be_indexed_meet_no_labels(spark, sf, monkeypatch):
    plans, update = [], registry.textindex.IndexStore.update

    def watched(self, name, entries, contents, before=None, changes=None):
        plans.append(contents(spark.createDataFrame([("s2:x",)], "blob string"))._jdf.queryExecution().optimizedPlan().toString())
        return update(self, name, entries, contents, before, changes)

    monkeypatch.setattr(registry.textindex.IndexStore, "update", watched)
    assert registry.fts_after_commits(spark, sf).count() == 20
    assert len(plans) == 3 and not any("quality" in p or "toxic" in p for p in plans)


def test_a_pack_shuffles_no_texts(spark, monkeypatch):
    plans, cls = [], type(spark.range(1))
    monkeypatch.setattr(cls, "collect", lambda self, f=cls.collect: plans.append(self._jdf.queryExecution().executedPlan().toString()) or f(self))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.createDataFrame([("p/01", 1.0, 1), ("p/02", 0.5, 2)], "path string, score double, rank int")
        assert [x["path"] for x in registry.recall.pack(found, collection(spark), "a", 100)] == ["p/01", "p/02"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plans and "BroadcastHashJoin" in plans[-1] and "SortMergeJoin" not in plans[-1]


def test_merged_segments_leave_out_what_is_mostly_dead(spark, tmp_path):
    texts = {f"s2:{i}": f"walnut w{i}" for i in range(16)}
    contents = lambda blobs: spark.createDataFrame([(r.blob, texts[r.blob]) for r in blobs.collect()], "blob string, text string")
    rows = lambda those: spark.createDataFrame([(f"p/{i}", f"s2:{i}", []) for i in those], "path string, blob string, labels array<string>")
    store = registry.textindex.IndexStore(spark, str(tmp_path / "index"))
    store.update("M1", rows(range(10)), contents)
    for name, those in (("M2", range(4, 14)), ("M3", (13, 14, 15))):  # at most half dead at first, then more
        store.update(name, rows(those), contents, "M1" if name == "M2" else "M2")
    held = store.open("M3")
    assert {r.path for r in search.full_text(held, "walnut").collect()} == {"p/13", "p/14", "p/15"}
    apart = textindex_of(spark, tmp_path / "apart", rows, contents)
    assert {r.of for r in apart.texts.select(F.inline("found")).collect()} == {"s2:9", *(f"s2:{i}" for i in range(10, 16))}
    assert {r.path for r in search.full_text(apart, "walnut").collect()} == {f"p/{i}" for i in range(9, 16)}


def textindex_of(spark, place, rows, contents):
    """One of ten contents is kept, six come: the two segments are merged, and nine of sixteen rows are dead."""
    store = registry.textindex.IndexStore(spark, str(place))
    store.update("M1", rows(range(10)), contents)
    store.update("M2", rows(range(9, 16)), contents, "M1")
    return store.open("M2")
