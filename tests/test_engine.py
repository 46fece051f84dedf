"""Snapshots, policy, organize, drift, merge, retrieval and recall on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from kbspark import policy as P
from kbspark.functions import chunks, paths
from kbspark.functions.text import parse_query
from kbspark.operators import dedup, drift, merge, organize, recall, search
from kbspark.sources import export, snapshots, transcripts
from kbspark.streaming import watch

DAY = datetime.datetime(2024, 3, 7)


def entries(spark, *rows):
    return spark.createDataFrame([(p, b, 1, DAY + datetime.timedelta(days=d), list(labels), rule, text) for p, b, d, labels, rule, text in rows], snapshots.ENTRY + ", text string")


def entry(path, blob=None, day=0, labels=(), rule=None, text="t"):
    """A content has one key, and unlike contents unlike ones."""
    return (path, blob or f"s2:{text}", day, labels, rule, text)


@pytest.mark.parametrize("bad", ["x = 1", "[[rule]]\nname='a'\nmatch={ext=['md']}", "[[rule]]\nname='a'\nmatch={}\ninto='x'", "[[rule]]\nname='a'\nmatch={ext=['md']}\ninto='../x'", "[[rule]]\nname='a'\nmatch={ext=['md']}\ninto='{nope}'", "[[rule]]\nname='a'\nmatch={content_matches='('}\ninto='x'", "[dedup]\nstrategy='best'", "[retrieval]\nmode='hybrid'", "[[event_sink]]\ntype='webhook'"])
def test_policy_rejects(bad):
    with pytest.raises(P.PolicyError):
        P.load(bad)


def test_globs():
    assert paths.glob_regex("a*.m?") == r"\Aa[^/]*\.m[^/]\z" and paths.clean_literal("a//b/../c/.") == "a/c"
    with pytest.raises(ValueError):
        paths.glob_regex("[")


def test_store(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    with pytest.raises(snapshots.StoreError):
        store.undo()
    one = store.commit(entries(spark, entry("a")), "observe")
    two = store.commit(entries(spark, entry("b")), "mutate")
    assert (one, two, store.head) == ("M1", "M2", "M2") and [r.id for r in store.history().collect()] == ["M2", "M1"]
    assert store.undo() == "M1" and store.at().first().path == "a" and store.at("M2").first().path == "b"
    assert store.commit(entries(spark, entry("c")), "mutate") == "M3"
    assert [r.id for r in store.history().collect()] == ["M3", "M1"]
    with pytest.raises(snapshots.StoreError):
        store.at("M9")


def test_claims_chain(spark):
    pol = P.load("[[rule]]\nname='a'\nmatch={path='a.md'}\nrename='z.md'\n[[rule]]\nname='b'\nmatch={path='b.md'}\nrename='a.md'\n[[rule]]\nname='c'\nmatch={path='c.md'}\nrename='b.md'\n[[rule]]\nname='s'\nmatch={path='d.md'}\nrename='e.md'\n")
    e = entries(spark, *map(entry, ("a.md", "b.md", "c.md", "d.md", "e.md")))
    got = {r.path: (r["class"], r.to, r.reason) for r in organize.plan(e, pol).collect()}
    assert got["a.md"][0] == got["b.md"][0] == got["c.md"][0] == "move" and got["d.md"] == ("conflict", "e.md", "target claimed by e.md")
    assert sorted(r.path for r in organize.apply(e, organize.plan(e, pol)).collect()) == ["a.md", "b.md", "d.md", "e.md", "z.md"]


def test_pins_and_labels(spark):
    pol = P.load("[[rule]]\nname='l'\nmatch={ext=['md']}\nlabel=['x']\n[[rule]]\nname='p'\nmatch={ext=['md']}\ninto='in'\n")
    got = {(r.path, r["class"]) for r in organize.plan(entries(spark, entry("a.md", labels=(P.PINNED,)), entry("b.md"), entry("c.bin")), pol).collect()}
    assert got == {("a.md", "pinned"), ("a.md", "label"), ("b.md", "move"), ("c.bin", "unsorted")}


def test_dedup_tie_and_last_copy(spark):
    e = entries(spark, entry("x/a", "t"), entry("y/b", "t"), entry("o", "u", 0), entry("n", "u", 3), entry("s", "v"))
    got = {r.blob: (r.keep, r.paths, r.is_conflict) for r in dedup.grouped(dedup.members(e)).collect()}
    assert got == {"t": (None, ["x/a", "y/b"], True), "u": ("o", ["n"], False)}
    assert dedup.members(e, "keep-newest").where("blob = 'u'").first().keep == "n"
    left = dedup.apply(e, dedup.members(e))
    assert {r.blob for r in left.collect()} == {"t", "u", "v"} and dedup.removed(dedup.members(left)).isEmpty()
    timeless = e.withColumn("mod_time", F.lit(None).cast("timestamp"))
    assert {(r.blob, r.keep, r.is_conflict) for r in dedup.members(timeless).collect()} == {("t", None, True), ("u", None, True)}


def test_drift(spark):
    head = entries(spark, entry("keep", "1"), entry("gone", "2"), entry("edit", "3", labels=("l",)), entry("moveme", "4", labels=("m",)))
    now = entries(spark, entry("keep", "1"), entry("edit", "33"), entry("moved", "4"), entry("fresh", "5"))
    assert {(r.kind, r.path, r.from_path) for r in drift.changes(head, now).collect()} == {("removed", "gone", None), ("modified", "edit", None), ("renamed", "moved", "moveme"), ("added", "fresh", None)}
    got = {r.path: r.labels for r in drift.absorb(head, now).collect()}
    assert got["edit"] == ["l"] and got["moved"] == ["m", P.PINNED] and got["fresh"] == []


def test_merge(spark):
    base = entries(spark, entry("a", "1"), entry("b", "2"), entry("c", "3"), entry("d", "4"))
    head = entries(spark, entry("a", "1"), entry("bb", "2"), entry("c", "3", rule="weak"), entry("d", "4"), entry("full", "9"))
    view = merge.stage(merge.View("v", "M1"), base, [merge.Op("a", "full"), merge.Op("b", labels=("x",)), merge.Op("c", "cc", rule="strong"), merge.Op("d", "dd")])
    new, out = merge.merge(view, base, head, {"strong": 0, "weak": 1})
    rows = {r.path: r for r in new.collect()}
    assert set(rows) == {"a", "bb", "cc", "dd", "full"} and rows["bb"].labels == ["x"] and rows["cc"].rule == "strong"
    assert len(out.applied) + len(out.dropped) + len(out.held) == 4 and out.held[0][0].path == "a"
    with pytest.raises(ValueError):
        merge.stage(view, base, [merge.Op("nope")])
    with pytest.raises(ValueError):
        merge.View("v", "M1", "MERGED").moved("STAGED")
    with pytest.raises(ValueError):
        merge.resolve(view, head, mine=False)
    assert merge.resolve(merge.settled(view, out), head, mine=False)[1].state == "ABORTED"


def test_search(spark):
    e = entries(spark, entry("finance/acme-1007.pdf", labels=("invoice",), text=""), entry("media/beach.jpg", labels=("photo",), text=""), entry("notes/x.md", text="called ACME about contract renewal"))
    index = search.indexed(e)
    paths_of = lambda q: [r.path for r in search.full_text(index, q).collect()]
    assert paths_of("acme-1007") == ["finance/acme-1007.pdf"] and paths_of("photo") == ["media/beach.jpg"] and paths_of("  ") == []
    assert paths_of("who talked about contract") == ["notes/x.md"] and parse_query("acme-1007 É") == [["acme", "1007"], ["e"]]
    lists = [spark.createDataFrame([(p, i + 1) for i, p in enumerate(x)], "path string, rank int") for x in ("abc", "bda")]
    assert [r.path for r in search.fuse(*lists).orderBy("rank").collect()] == ["b", "a", "d", "c"]
    vecs = spark.createDataFrame([("p", [1.0, 0.0]), ("p", [0.0, 1.0]), ("q", [0.6, 0.8])], "path string, vec array<float>")
    assert [(r.path, round(r.score, 3)) for r in search.vector(vecs, [0.0, 1.0]).collect()] == [("p", 1.0), ("q", 0.8)]
    with pytest.raises(Exception, match="length"):
        search.vector(vecs, [1.0]).collect()


def test_chunks_and_recall(spark):
    assert chunks.chunk("  ", 10, 2) == [] and all(len(c.encode()) <= 400 for c in chunks.chunk("word " * 1000, 400, 50))
    assert chunks.chunk("x" * 5000, 1000, 0) == ["x" * 1000] * 5
    for n in range(16):
        assert "héllo wörld".startswith(chunks.truncate("héllo wörld", n)) and len(chunks.truncate("héllo wörld", n).encode()) <= n
    text = "filler words. " * 150 + "Dana signed the renewal contract. " + "tail words. " * 50
    docs = spark.createDataFrame([("a", text, 1.0, 1), ("b", None, 0.5, 2)], "path string, text string, score double, rank int").withColumn("blob", F.lit("b1"))
    got = recall.pack(docs.select("path", "score", "rank"), docs, "Dana renewal contract", 200)
    assert len(got) == 1 and "Dana" in got[0]["content"] and sum(len(x["content"].encode()) for x in got) <= 800
    assert "Dana" in recall.windows(docs, "Dana renewal", 300).first().window


def test_export_filters(spark):
    e = entries(spark, entry("a.md", labels=("x",)), entry("b/c.txt", text=None))
    assert [r.path for r in export.records(e, "M1", ["path:*.txt"]).collect()] == ["b/c.txt"] and export.records(e, "M1", ["after:2024-03-07"]).count() == 0
    for bad in ("bogus:x", "label", "after:junk", "path:["):
        with pytest.raises(ValueError):
            export.parse_filter([bad])


def test_transcript(spark):
    lines = ['{"type":"system","message":{"content":"s"}}', '{"type":"user","message":{"content":"hi <system-reminder>x</system-reminder>"}}', '{"type":"assistant","message":{"content":[{"type":"text","text":"yes"},{"type":"tool_use","name":"Run","input":{"command":"ls"}}]}}', "junk", '{"type":"user","isMeta":true,"message":{"content":"m"}}']
    md = transcripts.render(spark.createDataFrame(list(enumerate(lines)), "seq int, value string")).first().md
    assert md == "## User\n\nhi\n\n## Assistant\n\nyes\n\n_tools:_\n- Run: ls"


def test_reconcile_is_idempotent(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    (folder / "b.txt").write_text("two")
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    pol = P.load("[[rule]]\nname='r'\nmatch={ext=['md']}\nlabel=['x']\n")
    now, blobs = snapshots.scan_folder(spark, str(folder))
    texts = now.join(blobs, "blob").selectExpr("path", "cast(content as string) as text")
    first = watch.reconcile(store, now, texts, pol)
    assert first.absorbed == "M1" and first.applied == "M2" and {r.path: r.labels for r in store.at().collect()} == {"a.md": ["x"], "b.txt": ["unsorted"]}
    assert watch.reconcile(store, now, texts, pol).empty()
    (folder / "c.md").write_text("one")
    now, blobs = snapshots.scan_folder(spark, str(folder))
    texts = now.join(blobs, "blob").selectExpr("path", "cast(content as string) as text")
    quiet = watch.reconcile(store, now, texts, pol, watching=True)
    assert quiet.absorbed == "M3" and quiet.applied is None and ("label", "c.md") in quiet.pending and any(k == "copies" for k, _ in quiet.pending)


def test_reconcile_lists_all_that_is_held_back(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    rows = entries(spark, *(entry(f"{side}/{i:04}.md", f"b{i:04}") for i in range(1100) for side in "xy"))
    now, texts = rows.drop("text"), rows.select("path", "text")
    pol = P.load("[[rule]]\nname='r'\nmatch={path='x/*.md'}\nlabel=['x']\nautonomy='propose'\n")
    got = watch.reconcile(store, now, texts, pol, watching=True).pending
    assert got == [("label", f"x/{i:04}.md") for i in range(1100)] + [("copies", f"b{i:04}") for i in range(1100)]
    shown = spark.createDataFrame(got[:1000] + got[1100:2100], watch.SHOWN)
    assert watch.reconcile(store, now, texts, pol, watching=True, shown=shown).pending == got[1000:1100] + got[2100:]


def test_watch_shows_each_held_back_item_once(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    pol = P.load("[[rule]]\nname='r'\nmatch={ext=['md']}\nlabel=['x']\nautonomy='propose'\n")
    passes = []

    def on_pass(got):
        passes.append(got.pending)
        if len(passes) == 1:
            (folder / "b.md").write_text("two")

    running = watch.watch(spark, store, str(folder), pol, on_pass, "1 second")
    for _ in range(60):  # two passes that show something, then two quiet ones
        if len(passes) >= 2 or running.awaitTermination(2):
            break
    last = running.lastProgress["batchId"]
    for _ in range(60):
        if running.lastProgress["batchId"] >= last + 2 or running.awaitTermination(2):
            break
    running.stop()
    assert passes == [[("label", "a.md")], [("label", "b.md")]]
