"""The knowledge base on a real folder: operations, files that follow, sinks, embedding and services."""

import datetime
import json
import os
import threading
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from kbspark import base, services
from kbspark.operators.merge import Op
from kbspark.policy import EventSink, Retrieval
from kbspark.sources import sinks, vectors

POLICY = "[[rule]]\nname='notes'\nmatch={ext=['txt']}\ninto='notes'\nlabel=['note']\n"


@pytest.fixture
def kb(spark, tmp_path):
    root = tmp_path / "kb"
    (root / "in").mkdir(parents=True)
    (root / "in" / "a b.txt").write_text("walnut harvest in autumn")
    (root / "b.md").write_text("walnut oil")
    (root / "c.md").write_text("walnut oil")
    os.utime(root / "b.md", (1e9, 1e9))  # the older copy
    (root / "x.bin").write_bytes(b"\xff\xfe\x00")
    return base.KnowledgeBase.init(spark, str(root))


def paths(kb):
    return sorted(r.path for r in kb.store.at().collect())


def files(kb, tmp_path):
    return sorted(str(p.relative_to(tmp_path / "kb")) for p in (tmp_path / "kb").rglob("*") if p.is_file() and ".kb" not in p.parts and not p.name.endswith(".crc"))


def test_files_follow_org_dedup_and_undo(kb, tmp_path):
    assert kb.scan(dry=True) == {"files": 4, "manifest": None} and kb.scan()["manifest"] == "M1"
    (tmp_path / "kb/.kb/policy.toml").write_text(POLICY)
    before = files(kb, tmp_path)
    plan = kb.org()
    assert plan["manifest"] is None and [(o["class"], o["path"], o["to"]) for o in plan["ops"] if o["class"] == "move"] == [("move", "in/a b.txt", "notes/a b.txt")]
    assert kb.org(apply=True)["manifest"] == "M2" and paths(kb) == files(kb, tmp_path) == ["b.md", "c.md", "notes/a b.txt", "x.bin"]
    assert not (tmp_path / "kb/in").exists()
    assert kb.drift()["changes"] == []
    assert kb.undo() == {"manifest": "M1"} and files(kb, tmp_path) == before == paths(kb)
    got = kb.reconcile(apply=True)
    collapsed = ["b.md", "notes/a b.txt", "x.bin"]
    assert got["applied"] and got["deduped"] and paths(kb) == files(kb, tmp_path) == collapsed
    assert [x["id"] for x in kb.log()][-1] == "M1"
    kb.undo()
    assert paths(kb) == files(kb, tmp_path) and (tmp_path / "kb/c.md").read_text() == "walnut oil"
    assert kb.dedup()["manifest"] is None and kb.dedup(apply=True)["manifest"] and paths(kb) == files(kb, tmp_path) == collapsed


def test_moves_are_all_or_none(kb, tmp_path):
    root = tmp_path / "kb"
    swap = lambda: [("b.md", "x.bin"), ("x.bin", "b.md")]
    assert kb.folder.move(swap) == 2 and (root / "x.bin").read_text() == "walnut oil" and kb.folder.move(swap) == 2
    for bad in ([("b.md", "n.md"), ("x.bin", "c.md")], [("b.md", "n.md"), ("gone", "o.md")]):
        with pytest.raises(Exception):  # noqa: B017
            kb.folder.move(lambda bad=bad: bad)
        assert files(kb, tmp_path) == ["b.md", "c.md", "in/a b.txt", "x.bin"] and (root / "b.md").read_text() == "walnut oil"
    with pytest.raises(FileNotFoundError):
        kb.folder.collapse(["gone"], ["b.md"])
    assert (root / "b.md").exists()


def test_find_recall_retain_export(kb, tmp_path):
    kb.scan()
    assert {h["path"] for h in kb.find("walnut")} == {"in/a b.txt", "b.md", "c.md"} and kb.find("nothinglikeit") == []
    made = kb.retain("# Session\nwalnut trees", day=datetime.date(2024, 5, 6))
    assert made["path"].startswith("memory/2024/05/06/") and (tmp_path / "kb" / made["path"]).exists()
    pack = kb.recall("walnut trees", budget=10)
    assert pack["items"][0]["path"] == made["path"] and pack["used"] <= 10 and pack["manifest"] == made["manifest"]
    rows = kb.export("path:*.md")
    assert [r["path"] for r in rows] == ["b.md", "c.md", made["path"]] and rows[0]["text"] == "walnut oil"
    assert kb.export("path:x.bin")[0]["binary"] is True and len(kb.export(at="M1")) == 4
    for bad in ("", "/a", "../a", ".kb/x"):
        with pytest.raises(base.KbError):
            base.safe(bad)
    with pytest.raises(base.KbError):
        kb.retain("")
    kb.undo()
    assert made["path"] not in paths(kb) and not (tmp_path / "kb" / made["path"]).exists()


def test_vectors_are_drained_once(kb):
    kb.scan()
    texts, cache = kb._texts(kb.store.at()), kb._cache()
    assert cache.pending(texts).count() == 3  # two files share a blob
    cache.drain(texts, 1)
    assert cache.pending(texts).count() == 2 and kb.embed() == {"pending": 0}
    assert kb.find("walnut oil", "vector", 2)[0]["path"] == "b.md" and kb.find("walnut oil", "hybrid")[0]["path"] == "b.md"
    other = vectors.VectorCache(kb.spark, f"{kb.root}/.kb/vectors", Retrieval(chunk_size=10))
    assert other.path != cache.path and other.pending(texts).count() == 3
    with pytest.raises(base.KbError):
        kb.find("x", "best")


def test_views_are_kept(kb, tmp_path):
    kb.scan()
    kb.work_create("v")
    with pytest.raises(base.KbError):
        kb.work_create("v")
    kb.work_stage("v", [Op("b.md", labels=("seen",)), Op("c.md", to="b.md")])
    view, out = kb.work_merge("v")
    assert view.state == "ESCALATED" and len(out.applied) == 1 and [o.path for o in kb.view("v").ops] == ["c.md"]
    assert kb.work_resolve("v", mine=False).state == "ABORTED" and [v.name for v in kb.views()] == ["v"]


@pytest.fixture
def endpoint():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.server.seen.append((self.path, body))
            status, out = 200, {}
            if self.path == "/embeddings":
                if any(len(t) > 8 for t in body["input"]):
                    status, out = 400, {"error": "input exceeds the context size"}
                else:
                    out = {"data": [{"index": i, "embedding": [3.0, 4.0 * (i == 0)]} for i in reversed(range(len(body["input"])))]}
            elif self.path == "/bad":
                status = 500
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    server.seen = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_embedder_batches_and_halves(endpoint):
    e = vectors.HttpEmbedder(f"http://127.0.0.1:{endpoint.server_port}", "m")
    got = e(["abc"] * 65)
    assert len(got) == 65 and got[0].tolist() == pytest.approx([0.6, 0.8]) and got[1].tolist() == [1.0, 0.0]
    assert [len(b["input"]) for _, b in endpoint.seen] == [64, 1]
    endpoint.seen.clear()
    e(["0123456789"])
    assert [b["input"] for _, b in endpoint.seen] == [["0123456789"], ["01234"]]
    with pytest.raises(vectors.EmbeddingError):
        e(["x" * 40])


def test_sinks(endpoint, tmp_path, monkeypatch):
    url = f"http://127.0.0.1:{endpoint.server_port}"
    event = sinks.Event(sinks.COMMITTED, "/kb", "M3", "mutate", "org", 7)
    out = tmp_path / "out"
    listed = [EventSink(type="webhook", url=f"{url}/bad"), EventSink(type="webhook", url=f"{url}/hook"), EventSink(on="other", type="webhook", url=f"{url}/other"), EventSink(type="exec", command=f"printf %s $KB_MANIFEST > {out}")]
    monkeypatch.delenv(sinks.ALLOW_COMMANDS, raising=False)
    failed = sinks.fire(listed, event)
    assert len(failed) == 2 and "500" in failed[0] and "skipped" in failed[1] and not out.exists()
    assert [p for p, _ in endpoint.seen] == ["/bad", "/hook"] and endpoint.seen[1][1]["manifest"] == "M3"
    monkeypatch.setenv(sinks.ALLOW_COMMANDS, "1")
    assert len(sinks.fire(listed, event)) == 1 and out.read_text() == "M3"
    assert "exit 3" in sinks.fire([EventSink(type="exec", command="exit 3")], event)[0]


def test_services(kb):
    kb.scan()
    open_kb = lambda _: kb
    assert services.answer(open_kb, "GET", "/health")[0] == 200
    assert services.answer(open_kb, "POST", "/find?query=walnut")[0] == 405 and services.answer(open_kb, "GET", "/org")[0] == 405
    assert services.answer(open_kb, "GET", "/nope")[0] == 404 and services.answer(open_kb, "GET", "/find")[0] == 400
    status, hits = services.answer(open_kb, "GET", "/find?query=walnut%20oil&limit=1")
    assert status == 200 and [h["path"] for h in hits] == ["b.md"]
    assert services.answer(open_kb, "POST", "/retain?as=n/new.md", b"pecan")[1]["path"] == "n/new.md"
    with pytest.raises(base.KbError):
        services.http_server(open_kb, "0.0.0.0", 0)
    server = services.http_server(open_kb, port=0)
    t = threading.Thread(target=server.handle_request)
    t.start()
    assert json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/log"))[0]["created_by"] == "retain"
    t.join()
    server.server_close()

    said = []
    ask = lambda i, method, **p: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": p})
    lines = ["not json", json.dumps({"method": "notifications/initialized"}), ask(1, "initialize", protocolVersion="x"), ask(2, "tools/list"), ask(3, "tools/call", name="kb_find", arguments={"query": "pecan"}), ask(4, "tools/call", name="kb_find", arguments={}), ask(5, "nope"), ask(6, "ping")]
    services.tool_service(open_kb, lines, said.append)
    got = [json.loads(x) for x in said]
    assert [x["id"] for x in got] == [1, 2, 3, 4, 5, 6] and got[0]["result"]["protocolVersion"] == "x"
    assert {t["name"] for t in got[1]["result"]["tools"]} == {f"kb_{n}" for n in base.OPERATIONS}
    assert "n/new.md" in got[2]["result"]["content"][0]["text"] and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601


def test_command_line(kb, capsys):
    from kbspark.__main__ import main

    assert main(["--kb", kb.root, "scan"]) == 0 and main(["--kb", kb.root, "find", "walnut", "oil"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert json.loads(said[0])["files"] == 4 and json.loads(said[1])[0]["path"] == "b.md"
    assert main(["--kb", kb.root, "work-resolve", "v"]) == 1 and main(["init", kb.root]) == 1
