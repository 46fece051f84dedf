"""Snapshots as a base and a log: states, sizes of what is written, history and claims against plain models."""

import random

import pytest

from kbspark.operators import organize
from kbspark.sources import durable, snapshots


def state(df):
    rows = [(r.path, (r.blob, r["size"], tuple(r.labels or []), r.rule)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def entries(spark, model):
    return spark.createDataFrame([(p, b, n, None, list(labels), rule) for p, (b, n, labels, rule) in model.items()], snapshots.ENTRY)


def rows_of(spark, store, place):
    return spark.read.parquet(f"{store.path}/{place}").count()


@pytest.mark.parametrize("seed", [1, 2])
def test_every_snapshot_equals_a_full_one(spark, tmp_path, seed):
    rng = random.Random(seed)
    value = lambda: (f"s2:{rng.randrange(5)}", rng.randrange(3), tuple(rng.sample("abc", rng.randrange(3))), rng.choice((None, "r")))
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    model = {f"p{i}": value() for i in range(30)}
    kept = {store.commit(entries(spark, model), "observe"): dict(model)}
    for _ in range(16):
        before, model = model, dict(model)
        for p in rng.sample(sorted(model), rng.choice((0, 1, 1, 3, 8))):
            del model[p]
        for _ in range(rng.choice((0, 1, 1, 4, 12))):
            model[f"p{rng.randrange(60)}"] = value()
        if rng.random() < 0.5:
            changes = snapshots.replaced(entries(spark, {k: v for k, v in before.items() if model.get(k) != v}), entries(spark, {k: v for k, v in model.items() if before.get(k) != v or rng.random() < 0.1}))
            if rng.random() < 0.5:  # a path that isn't there can't go
                changes = changes.unionByName(snapshots.taken_away(spark.createDataFrame([("nowhere",)], "path string")))
            new = store.commit_changes(changes, "mutate")
        else:
            new = store.commit(entries(spark, model), "mutate")
        kept[new] = dict(model)
        row = store.manifest(new)
        assert row["entries"] == len(model) and sum(x["rows"] for x in row["log"]) <= snapshots.LOG_SHARE * row["base_rows"]
        assert all(a["rows"] > 2 * b["rows"] for a, b in zip(row["log"], row["log"][1:], strict=False))
        if rng.random() < 0.2 and len(kept) > 3:
            model = dict(kept[store.undo()])
    for name, want in kept.items():
        assert state(store.at(name)) == want
        told = store.changed(name)
        parent = kept.get(store.manifest(name)["parent"], {})
        assert {r.path: r.gone for r in told.collect() if r.known == (r.path in parent)}.keys() == {r.path for r in told.collect()}
        if parent:
            assert {r.path for r in told.collect()} >= {p for p in {*want, *parent} if want.get(p) != parent.get(p)}


def test_one_file_is_one_row_whatever_the_size(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    many = spark.range(100_000).selectExpr("concat('f/', id) as path", "concat('s2:', id) as blob", "id as size", "cast(null as timestamp) as mod_time", "cast(array() as array<string>) as labels", "cast(null as string) as rule")
    store.commit(many, "observe")
    one = lambda i: spark.createDataFrame([(f"memory/{i}", "s2:x", 1, None, [], None, False)], snapshots.ENTRY + ", gone boolean")
    for i in range(9):
        new = store.amend(lambda head, i=i: one(i), "mutate", "retain")
        row = store.manifest(new)
        assert rows_of(spark, store, f"changes/manifest_id={new}") == 1 and not store.folder.exists(f"entries/manifest_id={new}")
        assert row["entries"] == 100_001 + i and len(row["log"]) == bin(i + 1).count("1") or len(row["log"]) <= 4
    assert store.at().count() == 100_009 and sum(rows_of(spark, store, x["at"]) for x in row["log"]) == 9
    # the same state again writes nothing
    same = store.commit(store.at(), "observe")
    assert rows_of(spark, store, f"changes/manifest_id={same}") == 0 and store.manifest(same)["log"] == row["log"]


def test_contents_are_read_from_the_writes_that_hold_them(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "kb")).init()
    wanted = spark.createDataFrame([("k1",), ("k1",), ("nothing",)], "blob string")
    assert store.contents(wanted).count() == store.has(wanted).count() == 0
    for i in range(3):
        store.put_blobs(spark.createDataFrame([(f"k{i}", bytearray(b"%d" % i))], "blob string, content binary"))
    assert [r.blob for r in store.has(wanted).collect()] == ["k1"]
    found = store.contents(wanted)
    assert [(r.blob, bytes(r.content)) for r in found.collect()] == [("k1", b"1")]
    assert len(found.inputFiles()) >= 1 and "batch" in found._jdf.queryExecution().executedPlan().toString()


def test_history_takes_few_rounds(spark, monkeypatch):
    n = 3000
    chain = spark.range(n).selectExpr("concat('M', id) as id", "if(id = 0, null, concat('M', id - 1)) as parent", "'mutate' as kind", "'x' as created_by", "cast(null as timestamp) as created_at", "id as entries")
    rounds = []
    monkeypatch.setattr(snapshots, "written", lambda df, name: rounds.append(name) or durable.written(df, name))
    got = [(r.id, r.depth) for r in snapshots.history(chain, f"M{n - 1}").collect()]
    assert got == [(f"M{n - 1 - i}", i) for i in range(n)] and rounds.count("ancestors") == 12
    assert [r.id for r in snapshots.history(chain, "M0").collect()] == ["M0"] and snapshots.history(chain, None).count() == snapshots.history(chain, "M-").count() == 0
    # a row whose parent isn't there ends the chain
    assert [r.id for r in snapshots.history(chain.where("entries >= 2996"), f"M{n - 1}").collect()] == ["M2999", "M2998", "M2997", "M2996"]


def sequential(paths, moves):
    """Claims one after the other in path order: a target must be free at that time."""
    at, ok = set(paths), {}
    for path, to in sorted(moves):
        ok[path] = to not in at
        if ok[path]:
            at.remove(path)
            at.add(to)
    return ok


@pytest.mark.parametrize("seed", range(4))
def test_claims_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    paths = [f"{i:03}" for i in range(120)]
    moves = [(p, t) for p in rng.sample(paths, 90) if (t := f"{max(0, int(p) - rng.choice((1, 1, 1, 2, 3, -1, -30))):03}") != p]
    got = organize.settle(spark.createDataFrame(moves, "path string, to string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r.path: r.ok for r in got.collect()} == sequential(paths, moves)


def test_a_long_chain_of_claims_takes_few_rounds(spark, monkeypatch):
    n = 2000
    rounds = []
    monkeypatch.setattr(organize, "written", lambda df, name: rounds.append(name) or durable.written(df, name))
    occupied = spark.range(1, n + 1).selectExpr("lpad(cast(id as string), 5, '0') as path")
    for free in (True, False):
        rounds.clear()
        # each goes where the one before was; the first goes to a place that is free, or stays
        moves = spark.range(1 if free else 2, n + 1).selectExpr("lpad(cast(id as string), 5, '0') as path", "lpad(cast(id - 1 as string), 5, '0') as to")
        got = organize.settle(moves, occupied)
        assert got.where("ok").count() == (n if free else 0) and rounds.count("claim-links") <= 13
