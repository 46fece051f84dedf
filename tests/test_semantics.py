"""The rules that are easy to get subtly wrong: the merge ladder, commits that meet, transcripts, scans, windows, postings, embedding rounds."""

import json
import os
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import entries, entry

from kbspark import base as kbase
from kbspark import policy as P
from kbspark.functions import chunks
from kbspark.functions.text import parse_query
from kbspark.operators import drift, merge, recall, search, textindex
from kbspark.operators.merge import Op, View
from kbspark.operators.numbering import numbered
from kbspark.plans import registry
from kbspark.sources import snapshots, transcripts, vectors
from kbspark.sources.durable import release, scratch, shared_dir, written
from kbspark.streaming import watch

RANK = {"strong": 0, "weak": 1, "weakest": 2}


def folded(base, head, *ops, rank=RANK):
    """Paths, labels and rules of the new head, the outcome, and the view after it."""
    view = View("v", "M1", "STAGED", ops)
    new, out = merge.merge(view, base, head, rank)
    return {r.path: (r.labels, r.rule) for r in new.collect()}, out, merge.settled(view, out)


def test_labels_of_two_views_add_up(spark):
    base = entries(spark, entry("a/f.txt", "1"))
    head = entries(spark, entry("a/f.txt", "1", labels=("alpha",)))
    rows, _, view = folded(base, head, Op("a/f.txt", labels=("beta", "alpha")))
    assert rows == {"a/f.txt": (["alpha", "beta"], None)} and view.state == "MERGED"
    edited = entries(spark, entry("a/f.txt", "2", labels=("alpha",)))
    assert folded(base, edited, Op("a/f.txt", labels=("beta",)))[0] == {"a/f.txt": (["alpha", "beta"], None)}


def test_a_label_follows_a_file_that_moved(spark):
    base, head = entries(spark, entry("a/f.txt", "1")), entries(spark, entry("moved/f.txt", "1"))
    rows, out, view = folded(base, head, Op("a/f.txt", labels=("tagged",), rule="strong"))
    assert rows == {"moved/f.txt": (["tagged"], "strong")} and view.state == "MERGED" and out.moves == []


def test_an_agreeing_move_is_nothing_to_do(spark):
    base, head = entries(spark, entry("a/f.txt", "1")), entries(spark, entry("same/place.txt", "1"))
    rows, out, view = folded(base, head, Op("a/f.txt", "same/place.txt", ("l",)))
    assert rows == {"same/place.txt": (["l"], None)} and view.state == "MERGED" and out.moves == []


@pytest.mark.parametrize("mine", ["strong", "weak", "weakest", ""])
def test_a_disagreeing_move_of_a_file_that_moved_is_held(spark, mine):
    base, head = entries(spark, entry("inbox/f", "1")), entries(spark, entry("weak/f", "1", rule="weak"))
    rows, out, view = folded(base, head, Op("inbox/f", "strong/f", rule=mine))
    assert rows == {"weak/f": ([], "weak")} and [o.path for o, _ in out.held] == ["inbox/f"] and view.state == "ESCALATED" and not out.dropped


@pytest.mark.parametrize(("mine", "theirs", "state", "place"), [("strong", "weak", "MERGED", "claimed/f"), ("weakest", "weak", "MERGED", "a/f"), ("weak", "weak", "MERGED", "a/f"), ("", "weak", "ESCALATED", "a/f"), ("strong", None, "ESCALATED", "a/f"), ("strong", "other", "ESCALATED", "a/f")])
def test_rules_settle_a_move_of_changed_content(spark, mine, theirs, state, place):
    base, head = entries(spark, entry("a/f", "1", rule=theirs)), entries(spark, entry("a/f", "2", rule=theirs))
    rows, out, view = folded(base, head, Op("a/f", "claimed/f", rule=mine))
    assert set(rows) == {place} and view.state == state
    assert folded(base, head, Op("a/f", "claimed/f", rule=mine), rank=None)[2].state == "ESCALATED"
    assert out.moves == ([("a/f", "claimed/f")] if place == "claimed/f" else [])


def test_only_what_conflicts_is_held(spark):
    base = entries(spark, entry("won/f", "1"), entry("area1/f1", "2"), entry("full", "3"), entry("gone", "4"))
    head = entries(spark, entry("theirs/f", "1"), entry("area1/f1", "2"), entry("full", "3"))
    rows, out, view = folded(base, head, Op("won/f", "mine/f"), Op("area1/f1", "fine/f1"), Op("full", "fine/f1"), Op("gone", labels=("x",)))
    assert set(rows) == {"theirs/f", "fine/f1", "full"} and [o.path for o, _ in out.held] == ["won/f", "full", "gone"] == [o.path for o in view.ops]
    new, later, again = merge.resolve(view, head, mine=True)
    assert later.state == "ESCALATED" and [o.path for o, _ in again.held] == ["won/f", "gone"]  # full moves now, as area1 isn't folded here
    assert merge.resolve(view, head, mine=False)[1].state == "ABORTED"


def test_held_moves_apply_once_the_place_is_free(spark):
    base = entries(spark, entry("a0/f0", "1"), entry("a1/f1", "2"))
    head = entries(spark, entry("spot", "1"), entry("a1/f1", "2"))
    _, _, view = folded(base, head, Op("a1/f1", "spot"))
    assert view.state == "ESCALATED"
    freed = entries(spark, entry("archive/spot", "1"), entry("a1/f1", "2"))
    new, later, _ = merge.resolve(view, freed, mine=True)
    assert later.state == "MERGED" and {r.path for r in new.collect()} == {"archive/spot", "spot"}
    with pytest.raises(ValueError):
        merge.resolve(later, freed, mine=True)


def test_operations_of_a_view_see_one_another(spark):
    rows = entries(spark, entry("a", "1"), entry("b", "2"), entry("c", "3"))
    got, out, _ = folded(rows, rows, Op("a", "x"), Op("b", "a"), Op("a", labels=("l",)), Op("c", labels=("m",)), Op("c", "b", ("n",)), Op("c", labels=("o",)), Op("c", "z"))
    assert {p: r[0] for p, r in got.items()} == {"x": [], "a": ["l"], "b": ["m", "n", "o"]}
    assert [o.to for o, _ in out.held] == ["z"] and out.moves == [("a", "x"), ("b", "a"), ("c", "b")]


def test_large_label_views_are_joined(spark):
    n = 3000
    base = entries(spark, *(entry(f"f{i:05}", f"b{i}") for i in range(n)))
    head = base.where("path <> 'f00003'").withColumn("path", F.when(F.col("path") == "f00007", "new/7").otherwise(F.col("path")))
    ops = spark.range(n).selectExpr("id as seq", "concat('f', lpad(id, 5, '0')) as path", "'' as to", "array(concat('l', id % 3)) as labels", "if(id % 2 = 0, 'r', '') as rule")
    new, outcome, moves = merge.merge_table(ops, base, head)
    assert moves.isEmpty() and outcome.where("status = 'held'").collect()[0].seq == 3 and outcome.count() == n
    assert new.where("size(labels) = 1").count() == n - 1 and new.where("path = 'new/7'").first().labels == ["l1"] and new.where("rule = 'r'").count() == n // 2


def test_views_move_files(spark, tmp_path):
    root = tmp_path / "kb"
    root.mkdir()
    for n in ("a.md", "b.md"):
        (root / n).write_text(n)
    kb = kbase.KnowledgeBase.init(spark, str(root))
    kb.scan()
    kb.work_create("v")
    kb.work_stage("v", [Op("a.md", "in/a.md", ("x",)), Op("b.md", "in/a.md")])
    view, out = kb.work_merge("v")
    assert view.state == "ESCALATED" and view.base == kb.store.head and (root / "in/a.md").read_text() == "a.md" and not (root / "a.md").exists()
    (root / "in/a.md").rename(root / "free.md")
    kb.reconcile(apply=True)
    assert kb.work_resolve("v", mine=True).state == "MERGED" and (root / "in/a.md").read_text() == "b.md"
    assert kb.drift()["changes"] == []


def test_commits_that_meet(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    row = lambda p: spark.createDataFrame([(p, "b", 1, None, [], None)], snapshots.ENTRY)
    store.commit(row("first"), "observe", expected=None)
    failed = []

    def work(i):
        try:
            store.update(lambda head: head.unionByName(row(f"w{i}")), "mutate", f"w{i}")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {r.path for r in store.at().collect()} == {"first", *(f"w{i}" for i in range(8))}
    log = store.history().collect()
    assert [r["entries"] for r in log] == list(range(9, 0, -1)) and len({r.id for r in log}) == 9 and all(r.created_at for r in log)
    old = store.head
    store.commit(row("x"), "mutate", expected=old)
    with pytest.raises(snapshots.HeadMoved):
        store.commit(row("y"), "mutate", expected=old)
    late = store._head()[0] - 1
    with pytest.raises(snapshots.HeadMoved):
        store._move(late, "M1")
    assert [r.path for r in store.at().collect()] == ["x"]


def test_blobs_of_writers_that_meet(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    rows = spark.createDataFrame([("k1", bytearray(b"1")), ("k1", bytearray(b"1")), ("k2", bytearray(b"2"))], "blob string, content binary")
    threads = [threading.Thread(target=store.put_blobs, args=(rows,)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted((r.blob, bytes(r.content)) for r in store.blobs().collect()) == [("k1", b"1"), ("k2", b"2")]


def test_scan_sees_every_file(spark, tmp_path):
    root = tmp_path / "k b's"
    names = ["x.txt", "_note.md", ".env", "_dir/sub/y.md", "a/.git/config", "a/b.txt", "a/_c.txt", "a/d/e/.f", "ü é/z.md"]
    for n in [*names, ".kb/store/z", "a/.kb/q"]:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)
    os.utime(root / "_note.md", (1e9, 1e9))
    found, blobs = snapshots.scan_folder(spark, str(root))
    rows = {r.path: r for r in found.collect()}
    assert sorted(rows) == sorted(names) and rows["_note.md"].mod_time.timestamp() == 1e9 and rows[".env"].size == 4
    assert {bytes(r.content).decode() for r in blobs.collect()} == set(names)
    kb = kbase.KnowledgeBase.init(spark, str(tmp_path / "kb2")) if (tmp_path / "kb2").mkdir() is None else None
    kb.retain("kept", "_note.md")
    assert kb.reconcile(apply=True)["absorbed"] is None and [r.path for r in kb.store.at().collect()] == ["_note.md"]


def test_hidden_files_are_read_by_executors(spark, tmp_path, monkeypatch):
    from kbspark.sources import listing

    root = tmp_path / "k b's"
    names = [f"{a}/{b}{i}.md" for a in ("x", ".x", "y/_z/w", "y/v") for b in ("", ".", "_") for i in range(4)] + [".env", "top.md", ".crc.md"]
    for n in [*names, ".kb/no", "y/.kb/no", ".a.crc"]:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)
    reader = listing.HiddenReader({"path": f"file:{root}", "tasks": "7"})
    shares = reader.partitions()
    assert len(shares) >= 7
    got = [r for s in shares for r in reader.read(s)]
    assert sorted(r[0] for r in got) == sorted(n for n in names if any(p[0] in "._" for p in n.split("/"))) and all(r[3].decode() == r[0] and r[1] == len(r[0]) for r in got)
    made = lambda: sorted((r.path, r.blob, r["size"], r.mod_time) for r in snapshots.scan_folder(spark, str(root))[0].collect())
    direct = made()
    assert [r[0] for r in direct] == sorted(names)
    copied = []
    hidden = snapshots.hidden_files
    monkeypatch.setattr(snapshots, "hidden_files", lambda *a: copied.append(a) or hidden(*a))
    assert made() == direct and not copied
    monkeypatch.setattr(listing, "known", lambda uri: False)  # a file system that only Spark reaches
    assert made() == direct and copied
    assert listing.known("viewfs://in/x") is False and listing.known(f"file:{root}/nowhere") is False


TRANSCRIPT = [
    {"type": "system", "subtype": "init", "message": {}},
    {"type": "user", "message": {"role": "user", "content": "Should we move billing?<system-reminder>inner\nnote</system-reminder>"}},
    {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": " Yes. "}, {"type": "tool_use", "name": "Run", "input": {"command": "go  test\n./...", "description": " "}}, {"type": "tool_use", "input": {"query": 3, "path": "x" * 101}}, {"type": "tool_use", "name": "Bare", "input": {}}, {"type": "tool_use", "name": "Colon", "input": {"prompt": "ends so: "}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "content": "ok"}]}},
    {"type": "user", "message": {"content": "<local-command-caveat>Caveat: dump</local-command-caveat>"}},
    {"type": "user", "message": {"content": "Caveat: a person wrote this"}},
    {"type": "user", "isMeta": True, "message": {"content": "injected"}},
    {"type": "user", "message": {"content": "<command-name>/next</command-name>\n <command-args> now </command-args><system-reminder>r</system-reminder>"}},
    {"type": "user", "message": {"content": "<command-name> </command-name>said"}},
    {"type": "user", "message": {"content": "<system-reminder>only</system-reminder>\u00a0"}},
    {"type": "assistant", "message": {"content": "a plain string"}},
    "not even json",
    {"type": "user", "message": {"content": [{"type": "text", "text": "The diagram"}, {"type": "tool_result", "content": "noise"}]}},
    {"type": "user", "message": {}},
]
RENDERED = ["## User\n\nShould we move billing?", "## Assistant\n\nYes.\n\n_tools:_\n- Run: go test ./...\n- tool: " + "x" * 100 + "…\n- Bare\n- Colon: ends so:", "## User\n\nCaveat: a person wrote this", "## User\n\n/next now", "## User\n\na plain string", "## User\n\nThe diagram"]


def test_transcripts(spark):
    lines = [x if isinstance(x, str) else json.dumps(x) for x in TRANSCRIPT]
    assert transcripts.render(spark.createDataFrame(list(enumerate(lines)), "seq int, value string")).first().md == "\n\n".join(RENDERED)


@pytest.mark.parametrize("bad", ["[[event_sink]]\non='bogus'\ntype='webhook'\nurl='http://x'", "[[event_sink]]\ntype='exec'", "[retrieval]\nchunk_overlap=1500", "[retrieval]\nchunk_size=100\nchunk_overlap=100", "[retrieval]\nrrf_k=-1"])
def test_policy_refuses(bad):
    with pytest.raises(P.PolicyError):
        P.load(bad)


def test_policy_accepts():
    got = P.load("[retrieval]\nchunk_size=100\n[[event_sink]]\non='changeset.committed'\ntype='exec'\ncommand='x'\nurl='http://x'")
    assert got.retrieval.tuning()["chunk_overlap"] == 50 and len(got.sinks) == 1


def test_dry_run_sees_the_tree_it_would_make(spark, tmp_path):
    root = tmp_path / "kb"
    root.mkdir()
    (root / "a.md").write_text("one")
    (root / "b.txt").write_text("one")
    os.utime(root / "a.md", (1e9, 1e9))
    kb = kbase.KnowledgeBase.init(spark, str(root))
    (root / ".kb/policy.toml").write_text("[[rule]]\nname='r'\nmatch={ext=['md']}\ninto='in'\n")
    got = kb.reconcile()
    assert {(o["class"], o["path"]) for o in got["ops"]} == {("move", "a.md"), ("unsorted", "b.txt")} and kb.store.head is None
    assert [(c["keep"], c["paths"]) for c in got["copies"]] == [("in/a.md", ["b.txt"])] and (root / "a.md").exists()
    done = kb.reconcile(apply=True)
    assert [done[k] for k in ("absorbed", "applied", "deduped")] == ["M1", "M2", "M3"] and [r.path for r in kb.store.at().collect()] == ["in/a.md"]
    assert [(r["id"], r["entries"]) for r in kb.log()] == [("M3", 1), ("M2", 2), ("M1", 2)]


def test_numbers_inside_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) as key", "concat('p', lpad(id, 5, '0')) as path").unionByName(spark.createDataFrame([(None, "a"), (None, "b")], "key string, path string"))
    got = {}
    for r in numbered(rows, "key", "path").collect():
        got.setdefault(r.key, []).append((r.path, r.k))
    assert all([k for _, k in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values()) and sum(map(len, got.values())) == 5002


def test_renames_of_one_content_at_many_paths(spark):
    head = spark.range(900).selectExpr("concat('old/', lpad(id, 4, '0')) as path", "'empty' as blob")
    now = spark.range(1000).selectExpr("concat('new/', lpad(id, 4, '0')) as path", "'empty' as blob")
    got = drift.changes(head, now).collect()
    assert {(r.path, r.from_path) for r in got if r.kind == "renamed"} == {(f"new/{i:04}", f"old/{i:04}") for i in range(900)}
    assert sum(r.kind == "added" for r in got) == 100


# --- windows, chunks and packs, by other means ----------------------------------------------------------------------------


def cut_by_hand(text, size, overlap):
    data, out = text.strip().encode(), []
    while data:
        if len(data) <= size:
            out.append(data)
            break
        window, best = data[:size], size
        for mark in ("\n\n", ". ", "\n", " "):
            ends = [m.end() for m in re.finditer(re.escape(mark.encode()), window) if m.start() > size // 2]
            if ends:
                best = ends[-1]
                break
        out.append(data[:best])
        data = data[best - overlap if best > overlap else best :]
    return [p for p in (x.decode("utf-8", "replace").strip() for x in out) if p]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.path: r.text for r in registry.entries_of(spark, sf).select("path", "text").collect()}


def test_chunks_by_hand(spark, sf, texts):
    got = {}
    for r in registry.chunk_text(spark, sf).collect():
        got.setdefault(r.path, []).append((r.seq, r.bytes, r.hash))
    import hashlib

    for path, text in texts.items():
        want = [(i, len(c.encode()), hashlib.md5(c.encode()).hexdigest()) for i, c in enumerate(cut_by_hand(text, 1000, 200))]
        assert sorted(got.get(path, [])) == want


def points(text, words):
    return sum(min(2, len(re.findall(re.escape(t), text.lower()))) for t in words)


def window_by_hand(text, words, size):
    """seq, window, score."""
    if len(text.encode()) <= size:
        return 0, text, points(text, words)
    pieces = [(points(p, words), -i, p) for i, p in enumerate(cut_by_hand(text, size, size // 5))]
    best = max(pieces, key=lambda x: x[:2])
    if not best[0]:
        return 0, text.encode()[:size].decode("utf-8", "ignore"), points(text, words)
    return -best[1], best[2].encode()[:size].decode("utf-8", "ignore"), best[0]


def test_windows_by_hand(spark, sf, texts):
    import hashlib

    words = ["the", "license", "token"]
    got = {r.path: (r.seq, r.hash, r.score) for r in registry.recall_windows(spark, sf).collect()}
    assert set(got) == set(texts)
    for path, text in texts.items():
        seq, window, score = window_by_hand(text, words, 400)
        assert got[path] == (seq, hashlib.md5(window.encode()).hexdigest(), score)


def test_packs_by_hand(spark, sf, texts):
    found = search.full_text(registry.stored_index(spark, sf), "apache license", recall.CANDIDATES).orderBy("rank").collect()
    used, want = 0, []
    for r in found:
        if used >= 4000:
            break
        window = window_by_hand(texts[r.path], ["apache", "license"], min(1333, 4000 - used))[1]
        if window:
            want.append((r.path, len(window.encode())))
            used += len(window.encode())
    got = registry.recall_pack(spark, sf).orderBy("place").collect()
    assert [(r.path, r.bytes) for r in got] == want and len(want) > 2


def test_packs_keep_texts_that_fit(spark):
    docs = spark.createDataFrame([("a", "b1", "  spaced text \n", 1.0, 1), ("b", "b2", "no such word here at all, and long enough to be cut somewhere", 0.5, 2)], "path string, blob string, text string, score double, rank int")
    got = recall.pack(docs.select("path", "score", "rank"), docs, "spaced", 12)
    assert [(x["blob"], x["content"]) for x in got] == [("b1", "  spaced text \n"), ("b2", "no such word her")]
    assert recall.best_window("head and more text", [], 4) == "head" and recall.best_window("x" * 9, ["y"], 4) == "xxxx"


# --- search ---------------------------------------------------------------------------------------------------------------


def test_phrases_in_the_postings(spark):
    e = entries(spark, entry("p/1", text="a a ab, xa b. A-a"), entry("p/2", text=""), entry("p/3", text="a"), entry("p/4", labels=("xa",), text="b ab"))
    index = search.indexed(e)
    path = {r.doc: r.path for r in index.docs.collect()}
    count = lambda phrase: {path[r.doc]: r.n for r in search._occurrences(index, phrase).collect()}
    assert count(["a", "a"]) == {"p/1": 3} and count(["a", "a", "a"]) == {"p/1": 1} and count(["a"]) == {"p/1": 5, "p/3": 1, "p/4": 1}
    assert count(["xa", "b"]) == {"p/1": 1}  # not across labels and body
    lengths = {r.path: r.len for r in index.docs.collect()}
    assert lengths["p/2"] == 4 and lengths["p/4"] == 7


def test_queries_read_no_text(spark, sf):
    plan = search.full_text(registry.stored_index(spark, sf), "token lic", 20)._jdf.queryExecution().toString()
    assert "StartsWith(token,lic)" in plan.replace("StringStartsWith", "StartsWith") and "text" not in re.sub(r"documents|Context", "", plan).lower().replace("context", "")


def test_letters_lose_their_marks(spark):
    e = entries(spark, entry("1", text="łódź źrebię"), entry("2", text="Ťažký šum"), entry("3", text="ERDŐ űr"), entry("4", text="Ὀδυσσεύς řeka"), entry("5", text="cafe\u0301 ñu"))
    index = search.indexed(e)
    paths_of = lambda q: [r.path for r in search.full_text(index, q).collect()]
    assert paths_of("zrebie") == paths_of("ŁÓDŹ") == ["1"] and paths_of("sum") == ["2"] and paths_of("erdo") == paths_of("ur") == ["3"]
    assert paths_of("οδυσσευς") == paths_of("reka") == ["4"] and paths_of("café") == ["5"] and parse_query("ř &") == [["r"], []]


def test_the_stored_index_follows_the_head(spark, tmp_path):
    root = tmp_path / "kb"
    root.mkdir()
    (root / "a.md").write_text("walnut oil")
    kb = kbase.KnowledgeBase.init(spark, str(root))
    for i in range(3):
        (root / f"b{i}.md").write_text("walnut")
        kb.scan()
        assert len(kb.find("walnut")) == i + 2 == len(kb.find("waln"))
    assert sorted(n for n in os.listdir(root / ".kb/index/states") if not n.startswith(".")) == ["M2.json", "M3.json"]


def test_index_segments_equal_a_rebuild(spark, tmp_path):
    """States that add, edit, move, relabel and remove; each state's rankings are those of an index made anew."""
    rng, store = random.Random(4), textindex.IndexStore(spark, str(tmp_path / "index"))
    texts, read, words = {}, [], "walnut oil oak ash a bb ab river stone".split()

    def contents(blobs):
        read.append(sorted(r.blob for r in blobs.collect()))
        return spark.createDataFrame([(b, texts[b]) for b in read[-1]], "blob string, text string")

    model, before, known, schema = {}, None, set(), "path string, blob string, labels array<string>, text string"
    for step in range(7):
        for _ in range(rng.choice((0, 1, 2, 6)) if step else 14):
            blob = f"s2:{rng.randrange(40)}"
            texts.setdefault(blob, None if blob == "s2:7" else " ".join(rng.choice(words) for _ in range(rng.randrange(9))))
            model[f"{rng.choice(words)}/{rng.randrange(12)}.md"] = (blob, tuple(rng.sample(words, rng.randrange(2))))
        for p in rng.sample(sorted(model), rng.randrange(3)):
            if rng.random() < 0.5:
                model["moved/" + p] = model[p]
            del model[p]
        rows = spark.createDataFrame([(p, b, list(labels), texts[b]) for p, (b, labels) in model.items()], schema)
        told = store.update(f"M{step}", rows.drop("text"), contents, before)
        new = {b for b, _ in model.values()} - known
        assert told["texts"] == len(new) and (not new or read[-1] == sorted(new))
        known |= new
        before = f"M{step}"
        state = store._state(before)
        known = {r.blob for r in store._read(state["texts"], "sizes", "blob string").collect()}  # merging leaves out what no path holds
        assert all(a["rows"] > 2 * b["rows"] for part in state.values() for a, b in zip(part, part[1:], strict=False))
        fresh, held = search.indexed(rows), store.open(before)
        for q in ("walnut", "oak a-b", "md-walnut", "moved 1-md"):
            hits = lambda index: [(r.path, r.score) for r in search.full_text(index, q, 99).orderBy("rank").collect()]  # noqa: B023, E731
            assert hits(held) == hits(fresh), q
    store.prune({"M5", "M6"})
    assert sorted(store.names()) == ["M5", "M6"] and search.full_text(store.open("M6"), "walnut").count() == search.full_text(fresh, "walnut").count()
    # the same state again reads nothing
    assert store.update("M7", rows.drop("text"), contents, "M6") == {"texts": 0, "entries": 0} and store._state("M7") == store._state("M6")


def test_a_commit_indexes_what_it_brings(spark, tmp_path, monkeypatch):
    root = tmp_path / "kb"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.md").write_text(f"walnut {i}")
    kb = kbase.KnowledgeBase.init(spark, str(root))
    told = []
    update = textindex.IndexStore.update
    monkeypatch.setattr(textindex.IndexStore, "update", lambda self, *a, **b: told.append(update(self, *a, **b)) or told[-1])
    kb.scan()
    assert len(kb.find("walnut")) == 6
    kb.retain("walnut again")
    kb.retain("walnut 3", "copy.md")
    assert len(kb.find("walnut")) == 8 and {"3.md", "copy.md"} <= {r["path"] for r in kb.find("3")}
    kb.undo()
    assert len(kb.find("walnut")) == 7
    assert told[:2] == [{"texts": 6, "entries": 6}, {"texts": 1, "entries": 2}] and told[2]["texts"] == 0


def test_batches_of_queries_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)).round(2)
    v[100:160] = v[7]  # ties
    chunk_rows = [(f"p{i % 150:03}", v[i].tolist()) for i in range(400)] + [("none", None), (None, v[0].tolist())]
    asked = [(i, v[i].tolist(), f"p{i % 150:03}" if i % 2 else None) for i in range(0, 400, 13)]
    got = {}
    for r in search.vector_batch(spark.createDataFrame(chunk_rows, "path string, vec array<double>"), spark.createDataFrame(asked, "qid long, q array<double>, skip string"), 6, rows=50, most=4).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.path, round(r.score, 9))
    for q, vec, skip in asked:
        best = {}
        for p, x in chunk_rows[:400]:
            best[p] = max(best.get(p, -np.inf), round(float(np.dot(x, vec)), 9))
        want = sorted((-s, p) for p, s in best.items() if p != skip)[:6]
        assert [got[q][k] for k in range(1, 7)] == [(p, -s) for s, p in want]


def flaky(bad):
    """An embedder that fails on texts with bad in them; of a class that workers get by value."""

    class Flaky:
        name = "flaky"

        def __init__(self):
            self.bad = bad

        def __call__(self, texts):
            if any(self.bad in t for t in texts):
                raise vectors.EmbeddingError("endpoint is down")
            return [chunks.embed(t) for t in texts]

    return Flaky()


def test_a_failed_request_loses_its_own_batch_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BATCH", 1)
    docs = spark.createDataFrame([(f"b{i}", f"word {'bad' if i == 3 else i} " * 3) for i in range(9)] + [("binary", None)], "blob string, text string")
    cache = vectors.VectorCache(spark, str(tmp_path / "v"), P.Retrieval(), flaky("bad"))
    with pytest.raises(vectors.EmbeddingError, match="1 of 4"):
        cache.drain(docs, round_=4)
    assert [r.blob for r in cache.pending(docs).orderBy("blob").collect()] == ["b3", *(f"b{i}" for i in range(4, 9)), "binary"]
    well = vectors.VectorCache(spark, str(tmp_path / "v"), P.Retrieval(), flaky("never"))
    assert well.path == cache.path and well.drain(docs, 2, round_=4) == 2 and well.drain(docs, round_=3) == 5 and well.pending(docs).count() == 0
    rows = well.vectors().collect()
    assert len(rows) == 10 and {r.blob for r in rows if r.vec is None} == {"binary"}


def test_watch_indexes_embeds_and_says_so(spark, tmp_path, monkeypatch):
    root = tmp_path / "kb"
    root.mkdir()
    (root / "a.md").write_text("walnut")
    (root / "b.pdf").write_text("oak")
    kb = kbase.KnowledgeBase.init(spark, str(root))
    pol = P.load("[[rule]]\nname='r'\nmatch={ext=['md']}\ninto='in'\nautonomy='auto'\n[[rule]]\nname='p'\nmatch={ext=['pdf']}\nlabel=['x']\n")
    endpoint = flaky("walnut")
    cache, said, heads = vectors.VectorCache(spark, str(tmp_path / "v"), P.Retrieval(), endpoint), [], []
    done = threading.Event()

    def on_pass(got):
        said.extend(watch.rendered(got))
        endpoint.bad = "never"
        done.set()

    running = watch.watch(spark, kb.store, str(root), pol, on_pass, "1 second", lambda h: (heads.append(h), kb.index(h)), cache, kb._texts)
    assert done.wait(240)
    for _ in range(120):
        if cache.vectors().count() == 2 or running.awaitTermination(2):
            break
    running.stop()
    assert "absorbed added a.md" in said and "applied a.md → in/a.md (r)" in said and any(x.startswith("PROPOSED b.pdf") for x in said) and any("stalled" in x for x in said)
    assert cache.vectors().count() == 2 and heads[0] == kb.store.head and os.path.exists(root / f".kb/index/states/{heads[0]}.json") and (root / "in/a.md").exists()


def test_items_surface_once_also_after_a_restart(spark, tmp_path, monkeypatch):
    of = lambda *names: spark.createDataFrame([("move", n) for n in names], watch.SHOWN)
    told = []
    deliver = lambda rows: told.append(sorted(r.path for r in rows.collect()))
    first = watch.Surfacing(spark, str(tmp_path / "shown"))
    first.offer(of("a", "b", "a"), deliver)
    first.offer(of("a", "b", "a"), deliver)
    first.offer(of("b", "c"), deliver)
    assert told == [["a", "b"], ["c"]]
    again = watch.Surfacing(spark, str(tmp_path / "shown"))
    again.offer(of("a", "b", "c"), deliver)
    again.offer(of("d", "a"), deliver)
    assert told[2:] == [["d"]]

    def broken(rows):
        raise RuntimeError("not delivered")

    with pytest.raises(Exception, match="not delivered"):
        again.offer(of("e"), broken)
    watch.Surfacing(spark, str(tmp_path / "shown")).offer(of(), deliver)
    assert told[3:] == [["e"]]


def test_escalated_views_surface(spark, tmp_path):
    root = tmp_path / "kb"
    root.mkdir()
    for n in ("a.md", "b.md"):
        (root / n).write_text(n)
    kb = kbase.KnowledgeBase.init(spark, str(root))
    kb.scan()
    kb.work_create("v")
    kb.work_stage("v", [Op("a.md", "b.md")])
    assert kb.work_merge("v")[0].state == "ESCALATED"
    said, done = [], threading.Event()

    def on_pass(got):
        said.extend(watch.rendered(got))
        done.set()

    running = watch.watch(spark, kb.store, str(root), P.Policy(), on_pass, "1 second", views=kb._views)
    assert done.wait(240)
    running.stop()
    assert sum(x.startswith("ESCALATED view v") for x in said) == 1
    again = []
    running = watch.watch(spark, kb.store, str(root), P.Policy(), again.append, "1 second", views=kb._views)
    for _ in range(60):
        if (running.lastProgress or {}).get("batchId", 0) >= 1 or running.awaitTermination(2):
            break
    running.stop()
    assert again == []


# --- benchmarks -----------------------------------------------------------------------------------------------------------

SPEAKERS = [{"sample_id": "s1", "conversation": {"session_1": [{"speaker": "Ann", "text": "walnut tree"}, {"speaker": "Bo", "text": "oak"}], "session_1_date_time": "1 May", "session_2": [{"speaker": "Ann", "text": "river"}], "speaker_a": "Ann"}, "qa": [{"question": "walnut", "evidence": ["D1:1"], "category": 2}, {"question": "x", "evidence": ["D1:1"], "category": 5}, {"question": "river", "evidence": ["D2:1", "D9:1", "bad"], "category": 1}, {"question": "y", "evidence": [], "category": 1}]}, {"sample_id": "s2", "conversation": {"session_1": [{"speaker": "C", "text": "walnut walnut walnut"}]}, "qa": []}]
TURNS = [{"conversation_id": "7", "turns": [{"id": 3, "role": "user", "content": "walnut"}, {"id": 4, "role": "assistant", "content": "oak"}], "questions": [{"qid": "q1", "type": "fact", "question": "oak", "evidence_ids": [4, 99]}, {"qid": "q2", "type": "none", "question": "z", "evidence_ids": [99]}]}]
HAYSTACKS = [{"question_id": f"h{i}", "question_type": "t", "question": "who said walnut", "question_date": "d", "haystack_session_ids": ["a", "b"], "haystack_dates": ["1 May"], "haystack_sessions": [[{"role": "user", "content": f"walnut {i}"}], [{"role": "user", "content": "oak"}]], "answer_session_ids": ["a"] if i < 2 else []} for i in range(3)]


def test_benchmark_loaders(spark, tmp_path):
    from kbspark.sources.benchmarks import LOADERS

    got = {}
    for name, data in (("locomo", SPEAKERS), ("beam", TURNS), ("longmemeval", HAYSTACKS)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
        b = LOADERS[name](spark, str(tmp_path / f"{name}.json"))
        got[name] = ({r.path: r.text for r in b.files.collect()}, {(r.qid, r.text, r.type) for r in b.queries.collect()}, {(r.qid, r.path) for r in b.gold.collect()}, {(r.qid, r.path) for r in b.scope.collect()})
        assert b.sampled() is b and b.sampled(2, 1).queries.count() == 1
    files, queries, gold, scope = got["locomo"]
    assert files == {"s1/session_1.txt": "DATE: 1 May\nAnn: walnut tree\nBo: oak\n", "s1/session_2.txt": "Ann: river\n", "s2/session_1.txt": "C: walnut walnut walnut\n"}
    assert queries == {("s1-0", "walnut", "2"), ("s1-2", "river", "1")} and gold == {("s1-0", "s1/session_1.txt"), ("s1-2", "s1/session_2.txt")}
    assert {p for q, p in scope if q == "s1-0"} == {"s1/session_1.txt", "s1/session_2.txt"}
    files, queries, gold, scope = got["beam"]
    assert files == {"c7/t00003.txt": "user: walnut", "c7/t00004.txt": "assistant: oak"} and queries == {("q1", "oak", "fact")} and gold == {("q1", "c7/t00004.txt")}
    files, queries, gold, scope = got["longmemeval"]
    assert files == {"sessions/a.txt": "DATE: 1 May\nuser: walnut 0\n", "sessions/b.txt": "user: oak\n"} and {q for q, *_ in queries} == {"h0", "h1"} and ("h0", "sessions/a.txt") in gold


def test_scope_comes_before_the_cut(spark, tmp_path):
    from kbspark.sources.benchmarks import sessions_of_speakers

    (tmp_path / "b.json").write_text(json.dumps(SPEAKERS))
    b = sessions_of_speakers(spark, str(tmp_path / "b.json"))
    for mode in ("fts", "vector", "hybrid"):
        rows = search.evaluate(b, vectors.VectorCache(spark, str(tmp_path / mode), P.Retrieval()), mode).collect()
        assert {r.qid: (r.recall_1, r.mrr) for r in rows} == {"s1-0": (1.0, 1.0), "s1-2": (1.0, 1.0)}  # s2's session says walnut more often


def test_rankings_of_a_batch_are_those_of_each_query(spark, sf):
    index = registry.stored_index(spark, sf)
    asked = ["the tion", "token license", "apache-lic", "license zzzzqqq", "&", "Tok &"]
    batch = {}
    for r in search.full_text_batch(index, spark.createDataFrame([(str(i), q) for i, q in enumerate(asked)], "qid string, text string")).collect():
        batch.setdefault(r.qid, []).append((-r.score, r.path))
    for i, q in enumerate(asked):
        want = [(r.path, r.score) for r in search.full_text(index, q, 50).orderBy("rank").collect()]
        assert [(p, -s) for s, p in sorted(batch.get(str(i), []))][:50] == want


def test_generated_collections(spark, tmp_path):
    from kbspark.sources.generated import SIZES, files, generate

    made_of = lambda seed, size: {r.path: bytes(r.content) for r in files(spark, seed, *SIZES[size]).collect()}
    for size, (texts, copies, others, levels) in SIZES.items():
        made = made_of(3, size)
        assert made == made_of(3, size) != made_of(4, size) and len(made) == texts + copies + others
        assert len(set(made.values())) == texts + others and max(p.count("/") for p in made) <= levels
        assert sum(b"\xc0\xc1" == c[:2] for c in made.values()) == others
    assert len({p.rpartition("/")[0] for p in made}) > 20
    names = generate(spark, str(tmp_path / "g"), 3, "small")
    found = snapshots.scan_folder(spark, str(tmp_path / "g"))[0].collect()
    assert names == sorted(r.path for r in found) and len({r.blob for r in found}) == 17


# --- intermediates --------------------------------------------------------------------------------------------------------


def test_intermediates_go(spark):
    with scratch(spark) as keep:
        inner = written(spark.range(3), "inner")
        kept = keep(inner.selectExpr("id + 1 as id"))
    assert not os.path.exists(inner._kb_path.removeprefix("file:")) and kept.count() == 3
    release(kept, spark.range(1), None)
    assert not os.path.exists(kept._kb_path.removeprefix("file:"))


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://x"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *_: None)}), Context

    with pytest.raises(RuntimeError):
        shared_dir(Session)
