"""Moves, removals and restored files by executors, and what a killed run leaves."""

import hashlib

import pytest

from kbspark.sources import effects


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and ".kb" not in p.parts and p.suffix != ".crc"}


def moves_of(spark, *pairs):
    return spark.createDataFrame(pairs, "path string, to string")


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "k b's"
    for n in ("a", "b", "d/c", "d/e/f", "ü/x"):
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(n)
    (root / ".kb").mkdir()
    return root


def test_chains_swaps_and_empty_folders(spark, root):
    fx = effects.Effects(spark, str(root))
    assert fx.able
    fx.move(moves_of(spark, ("a", "b"), ("b", "a"), ("d/c", "d/e/f"), ("d/e/f", "new/place/f"), ("ü/x", "x")))
    assert tree(root) == {"a": "b", "b": "a", "d/e/f": "d/c", "new/place/f": "d/e/f", "x": "ü/x"} and not (root / "ü").exists()
    assert not list((root / ".kb").rglob("*.json")) and fx.recover() == {}


@pytest.mark.parametrize("bad", [("a", "b"), ("nowhere", "z")])
def test_all_or_none(spark, root, bad):
    before, fx = tree(root), effects.Effects(spark, str(root))
    with pytest.raises((FileExistsError, FileNotFoundError)):
        fx.move(moves_of(spark, ("d/c", "moved"), ("ü/x", "x"), bad))
    assert tree(root) == before and fx.recover() == {}
    fx.move(moves_of(spark, ("nowhere", "z"), ("a", "y")), missing_ok=True)
    assert (root / "y").read_text() == "a" and not (root / "z").exists()


@pytest.mark.parametrize("killed", ["_stage", "_look", "_place"])
def test_a_killed_run_is_ended_by_the_next(spark, root, killed, monkeypatch):
    before, fx = tree(root), effects.Effects(spark, str(root))
    each, step = fx._each, getattr(effects, killed)

    def dying(rows, what, intent=""):
        if what is step:  # half of the pass is done
            each(rows.where("path < 'b'"), what, intent)
            raise KeyboardInterrupt
        return each(rows, what, intent)

    fx._each = dying
    with pytest.raises(KeyboardInterrupt):
        fx.move(moves_of(spark, ("a", "b"), ("b", "c"), ("ü/x", "d/c2")))
    again = effects.Effects(spark, str(root))
    told = list(again.recover().values())
    if killed == "_place":
        assert told == ["finished"] and tree(root) == {"b": "a", "c": "b", "d/c": "d/c", "d/e/f": "d/e/f", "d/c2": "ü/x"}
    else:
        assert told == ["put back"] and tree(root) == before
    assert again.recover() == {} and not (root / ".kb/intents").exists() or not list((root / ".kb/intents").iterdir())


def test_steps_can_be_run_twice(spark, root):
    files = effects._Files(f"file:{root}", "i")
    row = {"path": "a", "to": "t/a"}
    for step in (effects._stage, effects._stage, effects._look, effects._place, effects._place, effects._put_back):
        assert step(files, row) == ""
    assert tree(root)["t/a"] == "a" and "a" not in tree(root)
    for step in (effects._remove, effects._remove):
        assert step(files, {"path": "d/e/f", "blob": "s2:" + hashlib.sha256(b"d/e/f").hexdigest()}) == ""
    assert not (root / "d/e").exists() and effects._remove(files, {"path": "b", "blob": "s2:other"}) == "" and (root / "b").exists()


def test_checksums_of_files_that_went_are_not_held_against_others(spark, root):
    fx = effects.Effects(spark, str(root))
    fx.folder.write("r/one", b"written by the engine")
    fx.folder.write("two", b"and this")
    assert (root / "r/.one.crc").exists()
    fx.move(moves_of(spark, ("r/one", "two"), ("two", "three")))
    assert not (root / "r").exists() and fx.folder.read("two") == b"written by the engine" and fx.folder.read("three") == b"and this"
    fx.folder.write("four", b"4")
    fx.remove(spark.createDataFrame([("four", None)], "path string, blob string"))
    (root / "four").write_text("by another program")
    assert fx.folder.read("four") == b"by another program"


def test_copies_and_contents(spark, root):
    fx = effects.Effects(spark, str(root))
    paths = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    with pytest.raises(FileNotFoundError):
        fx.collapse(paths("a", "gone"), paths("b"))
    assert (root / "b").exists()
    fx.collapse(paths("a"), paths("b", "d/c"))
    fx.restore(spark.createDataFrame([("b", bytearray(b"back")), ("a", bytearray(b"not written"))], "path string, content binary"))
    assert tree(root) == {"a": "a", "b": "back", "d/e/f": "d/e/f", "ü/x": "ü/x"}


def test_where_executors_have_no_access(spark, root, monkeypatch):
    monkeypatch.setattr(effects, "known", lambda uri: False)
    fx = effects.Effects(spark, str(root))
    fx.move(moves_of(spark, ("a", "b"), ("b", "a")))
    fx.remove(spark.createDataFrame([("d/c", "s2:" + hashlib.sha256(b"d/c").hexdigest()), ("ü/x", "s2:no")], "path string, blob string"))
    fx.restore(spark.createDataFrame([("r/s", bytearray(b"s"))], "path string, content binary"))
    fx.collapse(spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("d/e/f",)], "path string"))
    assert tree(root) == {"a": "b", "b": "a", "ü/x": "ü/x", "r/s": "s"}
