"""Line dedup, spelling variants and whitening: brute force on small and whole tables, and the cases that the docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import line_dedup, spelling, whitening
from kbspark.llm import queries as Q

DOCS = "doc_id long, text string, h int, n int, last int, batch int, word string, block string, gone string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, 1, 1, 1, 1, "x", "x", "x") for d, t in rows], DOCS)


# --- lines -------------------------------------------------------------------------------------------------------------


def lines_left(rows, chars, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip("\t\n\x0b\x0c\r "))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= chars:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held[key(x)]) < least or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["", " ", "aBcd", "\tABCD\r", "abcd", "ÀBCD", "àbcd", "abc ", "x\x0by", "zzzz", "yyyy " * 3]
    rows = [(rng.choice((None, *range(40))), "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for _ in range(120)] + [(7, None), (8, ""), (9, "q\n" * 20_000 + "abcd")]
    want = lines_left(rows, 4, 3)
    assert sum(r[2] for r in want) > 50
    for batches in (1, 3, 6):
        got = line_dedup.dedup_lines(docs_of(spark, rows), True, batches, 4, 3).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == want
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_lines_key_lengths_are_in_code_points():
    assert line_dedup.line_hash(("é" * 39).encode()) is None and line_dedup.line_hash(("é" * 40).encode()) is not None
    assert line_dedup.line_hash(b"a" * 39 + b" " * 9) is None and line_dedup.line_hash(b"\x0b" + b"A" * 40 + b"\r") == line_dedup.line_hash(b"a" * 40)


def test_runs_are_levelled_and_go_on_after_a_restart(spark, tmp_path):
    rng, seen = random.Random(5), defaultdict(set)
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), least=3, buckets=4)
    for batch in range(7):
        lines = [(bytes([rng.randrange(60)]) * 16, 100 * batch + rng.randrange(100)) for _ in range(80)]
        for h, d in lines:
            seen[h].add(d)
        runs.add(spark.createDataFrame(lines, "h binary, doc_id long"))
        levels = [r[0] for r in runs.runs]
        assert len(levels) == len(set(levels)) == bin(batch + 1).count("1")
        if batch == 3:
            for _, name in runs.runs:
                spark.sql(f"drop table {name}")
            runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), least=3)  # as another driver would open it
            assert runs.buckets == 4
    assert {(bytes(r.h), r["last"]) for r in runs.frequent().collect()} == {(h, max(d)) for h, d in seen.items() if len(d) >= 3}
    # a settled key adds nothing, one of a larger document or one that isn't settled does
    settled = next(h for h, d in seen.items() if len(d) >= 3)
    keys = spark.createDataFrame([(settled, 1, 0), (settled, 1, 10**6), (b"new", 1, 0)], "h binary, n long, last long")
    assert sorted((bytes(r.h), r["last"]) for r in runs.fresh(keys).collect()) == sorted([(settled, 10**6), (b"new", 0)])
    plan = runs.fresh(spark.createDataFrame([(b"x", 1, 1)], "h binary, n long, last long").hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    runs.close()


# --- words -------------------------------------------------------------------------------------------------------------


def words_of(rows, chars, least):
    counts = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{d}:{r}".encode())
            if d is not None and h % 97 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            counts[r] += 1
    held = {w: n for w, n in counts.items() if len(w) >= chars and n >= least}
    near, holes = defaultdict(set), defaultdict(list)
    for w in held:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].append(w)
            if (x := w[:i] + w[i + 1 :]) in held:
                near[w].add(x), near[x].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(x for x in group if x != a)
    form = {}
    for w, n in held.items():
        if near[w] and held[best := min(near[w], key=lambda x: (-held[x], x))] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), held.get(form.get(w))) for w, n in held.items())


@pytest.mark.parametrize(("chars", "most"), [(5, 50_000), (5, 3), (1, 50_000), (2, 4)])
def test_words_against_brute_force(spark, chars, most):
    rng = random.Random(chars)
    rows = [(rng.choice((None, *range(30))), " ".join("".join(rng.choice("aAbéÉ×") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [(1, None), (2, ""), (3, "abab" * 5_000), (4, "12 _ Ÿ ÿ"), (5, "aaaaaaa " * 3_000), (None, "kanton " * 40 + "kantons " * 15 + "kantonsä " * 4)]
    want = words_of(rows, chars, 3)
    got = spelling.group_variants(docs_of(spark, rows), chars, most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want and any(r[1] != r[2] for r in want if r[1])


def test_words_of_an_empty_table(spark):
    assert spelling.group_variants(docs_of(spark, [])).count() == 0


@given(st.text("abc", min_size=1, max_size=7), st.integers(0, 20), st.sampled_from("abcd"), st.sampled_from(("put", "cut", "set")))
@settings(max_examples=300, deadline=None)
def test_blocks_lose_no_pair(word, at, c, kind):
    at %= len(word)
    other = word[:at] + c + word[at:] if kind == "put" else word[:at] + word[at + 1 :] if kind == "cut" else word[:at] + c + word[at + 1 :]
    a, b = sorted((word, other), key=lambda x: (len(x), x))
    if a == b or not a:
        return
    size, found = len(a), 0
    for first in (True, False):
        h = size // 2
        half = (lambda w: w[:h]) if first else (lambda w: w[len(w) - (size - h) :])
        if half(a) == half(b):
            block = spelling.Block(size, first)
            block.put(b, 1)
            found += sum(x == b for x, _ in block.near(a))
    assert found == 1


def test_op12_against_brute_force(spark, sf):
    want = words_of(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall(), 5, 3)
    assert sorted(map(tuple, Q.op12_spelling_variants(spark, sf).collect())) == want


# --- vectors -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_eigen_solve(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    for m in (a + a.T, a @ a.T, np.zeros((n, n)), np.eye(n), np.ones((n, n)), np.diag(np.repeat([3.0, 1.0], n)[:n]), np.diag(10.0 ** -np.arange(n))):
        values, axes = whitening.symmetric_qr(m)
        top = max(1e-300, np.abs(m).max())
        assert (np.diff(values) <= 0).all() and np.abs(values - np.linalg.eigvalsh(m)[::-1]).max() <= 1e-12 * top
        assert np.abs(axes.T @ axes - np.eye(n)).max() < 1e-12 and np.abs(m @ axes - axes * values).max() <= 1e-12 * top


def test_moments_merge_to_those_of_all(spark):
    x = np.random.default_rng(1).integers(-50, 50, (300, 5)) + 10**6
    parts = []
    for part in np.split(x, [0, 1, 40, 299]):
        m = whitening.Moments.of(5, np.int64)
        m.add(part)
        parts.append(m)
    out = parts[0]
    for m in parts[1:]:
        out = out.merged(m)
    off = x - x.mean(axis=0)
    assert out.n == 300 and (out.sums == x.sum(axis=0)).all() and np.abs(out.outer - off.T @ off).max() < 1e-10 * (off.T @ off).max()


def checked(got, vectors, k=32):
    """Rows of whiten against the definition; vectors: vec_id -> floats."""
    x = np.floor(64 * np.array([v for _, v in vectors], np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = x - sums / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert len(got) == n * min(k, x.shape[1])
    signs = None
    for i, (vec, _) in enumerate(vectors):
        rows = sorted(by[vec], key=lambda r: r.component)
        assert [r.component for r in rows] == list(range(1, len(values) + 1))
        assert all(r.n == n and r.deviation == sum(int(d) ** 2 for d in n * x[i] - sums) for r in rows)
        assert np.allclose([r.explained for r in rows], values / np.trace(off.T @ off / n), rtol=1e-9)
        white, want = np.array([r.whitened for r in rows]), off[i] @ axes / np.sqrt(values)
        signs = np.sign(white * want) if signs is None else signs
        assert np.allclose(white * signs, want, atol=1e-6)
        assert all(r.identity_error == rows[0].identity_error < 1e-9 for r in rows)


def test_op13_against_the_definition(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    checked(Q.op13_whitening(spark, sf).collect(), rows)


def test_vectors_that_take_no_part_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=3) * 5 + 1000]) for i in range(50)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 0.0]), (95, [0.0, 0.0, float("-inf")])]
    table = spark.createDataFrame([(i, v, 1, 1, "x", 1.0) for i, v in good + bad], "vec_id long, embedding array<float>, n int, component int, part string, whitened double").repartition(6)
    checked(whitening.whiten(table).collect(), good)
    assert whitening.whiten(table.limit(0)).count() == whitening.whiten(table.where("vec_id >= 90")).count() == 0


def test_vectors_without_variance(spark):
    of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(of([(1, [2.0, 3.0]), (None, [2.0, 3.0])])).collect()
    assert len(got) == 4 and all((r.whitened, r.deviation, r.explained, r.identity_error) == (0, 0, 0, 0) for r in got)
    # the second entry follows the first: one component has all the variance
    got = whitening.whiten(of([(i, [i / 2, i / 1.0]) for i in range(8)] + [(3, [1.5, 3.0])])).collect()
    assert len(got) == 18 and all(abs(r.explained - (r.component == 1)) < 1e-12 and r.identity_error < 1e-9 for r in got)
    assert all(r.whitened == 0 for r in got if r.component == 2)
    for rows in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30]), (2, [0.0])]):
        with pytest.raises(Exception, match="vectors of|whole numbers"):
            whitening.whiten(of(rows)).collect()


def test_deviations_beyond_a_long_are_null():
    white = whitening.Whitening(1 << 50, np.array([0, 1 << 55]), np.ones(1), np.ones((1, 2)), 1.0)
    assert whitening._squares(white.deviations(np.array([[0, 32], [1 << 40, 5]]))) == [0, None]
