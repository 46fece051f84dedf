"""Merges split into components against the sequential rule over everything; views under several writers; components themselves."""

import random
import threading

import pytest

from kbspark import base as kbase
from kbspark.operators import merge
from kbspark.operators.components import components, ends
from kbspark.operators.merge import Op
from kbspark.sources import snapshots

RANK = {"strong": 0, "weak": 1}


def plain(base, head, ops):
    """The ladder, one operation after the other over the whole head: path -> (blob, labels, rule) and the verdicts."""
    first = {p: p for p in head}
    rows = {p: [b, list(labels), rule, p] for p, (b, labels, rule) in head.items()}
    verdicts = []
    for seq, path, to, labels, rule in ops:
        was = base.get(path, (None,))[0]
        row, at = rows.get(path), path
        free = not to or to == path or to not in rows
        if row is None:
            follow = min((p for p, (b, _, _) in head.items() if b == was and was is not None), default=None)
            at = next((p for p, r in rows.items() if r[3] == follow), None) if follow is not None else None
            ok = at is not None and (not to or to == at)
            verdict = "applied" if ok else "held"
        elif head.get(path, (None,))[0] == was or not to or to == path:
            verdict = "applied" if free else "held"
        elif rule not in RANK or row[2] not in RANK:
            verdict = "held"
        elif RANK[rule] >= RANK[row[2]]:
            verdict = "dropped"
        else:
            verdict = "applied" if free else "held"
        verdicts.append((seq, verdict))
        if verdict == "applied":
            r = rows.pop(at)
            r[1] += [x for x in labels if x not in r[1]]
            r[2] = rule or r[2]
            rows[to or at] = r
    assert first
    return {p: (r[0], sorted(r[1]), r[2]) for p, r in rows.items()}, verdicts


@pytest.mark.parametrize("seed", range(5))
def test_components_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    names = [f"{c}{i}" for c in "ab" for i in range(14)]
    row = lambda: (f"c{rng.randrange(18)}", tuple(rng.sample("xyz", rng.randrange(2))), rng.choice((None, "strong", "weak")))
    base = {p: row() for p in rng.sample(names, 20)}
    head = {}
    for p, (b, labels, rule) in base.items():
        kind = rng.randrange(6)
        if kind == 0:
            continue
        head[p if kind > 1 else rng.choice(names)] = (b if kind != 2 else "edited", labels, rule)
    ops = []
    for i in range(40):
        path = rng.choice(sorted(base))
        to = "" if rng.random() < 0.4 else path if rng.random() < 0.1 else rng.choice(names + [f"new{i}"] * 9)
        ops.append((i * 3, path, to, tuple(rng.sample("pqr", rng.randrange(2))), rng.choice(("", "strong", "weak"))))
    want, verdicts = plain(base, head, ops)
    table = lambda d: spark.createDataFrame([(p, b, 1, None, list(labels), rule) for p, (b, labels, rule) in d.items()], snapshots.ENTRY)
    staged = spark.createDataFrame([(s, p, t, list(x), r) for s, p, t, x, r in ops], merge.OPS)
    new, outcome, moves = merge.merge_table(staged, table(base), table(head), RANK)
    assert sorted((r.seq, r.status) for r in outcome.collect()) == verdicts
    assert {r.path: (r.blob, sorted(r.labels), r.rule) for r in new.collect()} == want
    went = {r.path: r.to for r in moves.collect()}
    assert {went.get(p, p) for p in head} == set(want) and all(p in head and p != t for p, t in went.items())


def test_long_chains_and_many_moves(spark, monkeypatch):
    n = 4000
    head = spark.range(n).selectExpr("concat('f', lpad(id, 5, '0')) as path", "concat('s2:', id) as blob", "1L as size", "cast(null as timestamp) as mod_time", "cast(array() as array<string>) as labels", "cast(null as string) as rule")
    # the even ones go into folders, the others each to where the one before was
    ops = spark.range(n).selectExpr("id as seq", "concat('f', lpad(id, 5, '0')) as path", "if(id % 4 = 0, concat('in/', id), concat('f', lpad(id - 1, 5, '0'))) as to", "array('moved') as labels", "'' as rule")
    collected = []
    monkeypatch.setattr(type(head), "collect", lambda self: collected.append(self) or [])
    new, outcome, moves = merge.merge_table(ops, head, head)
    monkeypatch.undo()
    assert not collected, "operations came to the driver"
    assert outcome.where("status = 'applied'").count() == moves.count() == n == new.where("array_contains(labels, 'moved')").count() and new.select("path").distinct().count() == n


def test_components(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(160)] + [("alone", "alone")] + [(f"c{i:04}", f"c{i + 1:04}") for i in range(500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = {}
    for x in root:
        want.setdefault(find(x), set()).add(x)
    got = {}
    for r in components(spark.createDataFrame(edges, "a string, b string")).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
    chain = ends(spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(100)], "node string, to string"))
    assert {r.to for r in chain.collect()} == {"100"} and chain.count() == 100


def test_eight_writers_lose_nothing(spark, tmp_path):
    root = tmp_path / "kb"
    root.mkdir()
    for i in range(8):
        (root / f"{i}.md").write_text(f"text {i}")
    kb = kbase.KnowledgeBase.init(spark, str(root))
    kb.scan()
    kb.work_create("v")
    failed = []

    def work(i):
        try:
            kbase.KnowledgeBase(spark, str(root)).work_stage("v", [Op(f"{i}.md", labels=(f"a{i}",)), Op(f"{i}.md", labels=(f"b{i}",))])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    view = kb.view("v")
    assert not failed and view.state == "STAGED" and len(view.ops) == 16
    assert all(view.ops[i].path == view.ops[i + 1].path and view.ops[i].labels[0][0] == "a" for i in range(0, 16, 2))  # each writer's stay in order
    # operations staged while others are merged stay in the view
    late, change = [], kb._views.change

    def meanwhile(name, to, tries=100):
        if not late:
            late.append(True)
            kbase.KnowledgeBase(spark, str(root)).work_stage("v", [Op("1.md", labels=("late",))])
        return change(name, to, tries)

    kb._views.change = meanwhile
    view, out = kb.work_merge("v")
    assert len(out.applied) == 16 and view.state == "STAGED" and [o.labels for o in view.ops] == [("late",)] and view.base == kb.store.head
    assert kb.work_merge("v")[0].state == "MERGED"
    assert {r.path: sorted(r.labels) for r in kb.store.at().collect()} == {f"{i}.md": sorted([f"a{i}", f"b{i}"] + ["late"] * (i == 1)) for i in range(8)}
    with pytest.raises(ValueError):
        kb.work_stage("v", [Op("1.md", labels=("x",))])
    kb.work_create("v")
    table = spark.createDataFrame([(0, "2.md", "x/2.md", [], "")], merge.OPS)
    assert kb.work_stage("v", table).ops == () and kb.work_merge_table("v")[0].state == "MERGED" and (root / "x/2.md").exists()
    with pytest.raises(ValueError):
        kb.work_create("w") and kb.work_stage("w", [Op("nowhere.md", labels=("x",))])
