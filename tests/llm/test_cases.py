"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: the cases that the docstrings define."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import hmm, html_text, langid, mixing, mtree, near_dedup, packing, quality, secrets, substring_dedup
from kbspark.llm.common import WordHashes, gram_hashes
from kbspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, node int, comp int, kept string, quality string, c int, word string, bin int, s int, slot int"
LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(30_000))
TOKENS = packing.Tokens(tokenizer_path())


def row(doc, text, lang="en", source="a"):
    return (doc, text, lang, source, None, "x", 1, 1, "x", "x", 1, "x", 1, 1, 1)


@pytest.fixture(scope="module")
def odd(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one two"), row(5, passage), row(6, passage + " tail"), row(6, passage + " tail"), row(6, "other text of one id"), row(None, passage), row(None, None, None, None), row(7, LONG), row(8, LONG + " z"), row(9, "a " * 400, None, None), row(10, "12 34"), row(11, "x" * 70_000)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (5, 1, 0), (None, 1, None), (7, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def test_gram_hashes_depend_on_exactly_k_words():
    h = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    for k in (1, 2, 3, 5, 16, 31, 50, 64):
        got = gram_hashes(h, k)
        assert len(got) == 301 - k and all(gram_hashes(h[i : i + k], k)[0] == got[i] for i in (0, 7, 300 - k))
    assert len(gram_hashes(h[:4], 5)) == 0


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("kbspark.llm.common.CACHE_WORDS", 10)
    hashes = WordHashes()
    words = [b"%d" % i for i in range(100)]
    assert (hashes.of(words) == WordHashes().of(words)).all() and len(hashes) <= 10


def test_substring_dedup(odd, empty):
    got = sorted(substring_dedup.remove_repeated_spans(odd).collect(), key=str)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == odd.count() and by[1, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5, 80].n_removed == 0 and by[6, 81].n_removed == 80 and by[6, 81].kept_text == "tail" and by[6, 5].n_removed == 0
    assert by[None, 80].n_removed == 0 and by[7, 30_000].n_removed == 0 and by[8, 30_001].n_removed == 30_000 and by[9, 400].n_removed == 0
    assert substring_dedup.remove_repeated_spans(empty).count() == substring_dedup.repeated_spans(empty).count() == 0


def test_substring_dedup_small_windows_against_brute_force(spark):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join("abc"[x] for x in rng.integers(0, 3, rng.integers(0, 60)))) for i in range(120)]
    first = {}
    for d, t in docs:
        w = t.split()
        for i in range(len(w) - 7):
            first.setdefault(tuple(w[i : i + 8]), d)
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), 8, 3).collect()}
    for d, t in docs:
        w = t.split()
        gone = {j for i in range(len(w) - 7) if first[tuple(w[i : i + 8])] < d for j in range(i, i + 8)}
        assert got[d] == len(gone)


def test_spans_come_from_source_coordinates(spark):
    rng = np.random.default_rng(12)
    w = [f"w{i}" for i in range(400)]
    texts = [w[:120], w[60:300] + ["x"] * 5 + w[0:70], ["y"] * 3 + w[10:320], w, w[200:260] + w[30:90]]
    texts += [[f"r{x}" for x in rng.integers(0, 4, 90)] for _ in range(6)]
    docs = spark.createDataFrame([(10 * i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = substring_dedup.repeated_spans(docs).collect()
    gone = defaultdict(set)
    for r in spans:
        own, source = texts[r.doc_id // 10], texts[r.source_id // 10]
        assert r.source_id < r.doc_id and r.length >= 50 and own[r.start : r.start + r.length] == source[r.source_start : r.source_start + r.length]
        gone[r.doc_id] |= set(range(r.start, r.start + r.length))
    for r in substring_dedup.remove_repeated_spans(docs).collect():
        assert r.n_removed == len(gone[r.doc_id]) and r.kept_text.split() == [x for i, x in enumerate(texts[r.doc_id // 10]) if i not in gone[r.doc_id]]
    assert (10, 0, 60) in {(r.doc_id, r.start, r.length) for r in spans}  # the path goes on as long as the source does


def test_paths_end_where_the_graph_branches(spark):
    a, b, c = ([f"{x}{i}" for i in range(100)] for x in "abc")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([a + b, a + b, a + c, a + c, b])], "doc_id long, text string")
    _, runs = substring_dedup.graph(docs)
    starts = {(r.source, r.path) for r in runs.select("source", "path").distinct().collect()}
    assert starts == {(0, 0), (0, 51), (2, 51)}  # 49 words of a, then b or c


def test_near_duplicates(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[1, 0].kept and by[2, 0].component_id == 2 and by[4, 1].kept
    assert by[6, 77].component_id == 5 and not by[6, 77].kept and by[None, 76].component_id is None and by[None, 76].kept
    assert by[8, 29_997].component_id == 7
    assert near_dedup.near_duplicates(empty).count() == near_dedup.keep_one(empty).count() == 0


def test_near_duplicates_under_repeated_ids_against_brute_force(spark):
    rng = np.random.default_rng(21)
    bases = [[f"b{i}_{j}" for j in range(60)] for i in range(12)]
    rows = []
    for n in range(240):  # unlike texts under one id, alike texts under many, whole rows repeated
        w = list(bases[rng.integers(0, 12)])
        for j in rng.integers(0, 60, rng.integers(0, 2)):
            w[j] = f"n{n}"
        rows.append((int(rng.integers(0, 40)), " ".join(w), f"s{n}"))
    rows += rows[:30] + [(1, None, "x"), (1, "", "x"), (None, rows[0][1], "x"), (None, None, "x")]
    p, q = " ".join(bases[0]), " ".join(bases[1])
    rows += [(105, p.replace("b0", "z"), "x"), (106, p.replace("b0", "z") + " tail", "x"), (106, q.replace("b1", "y"), "x"), (107, q.replace("b1", "y"), "x")]
    texts = sorted({(d, t) for d, t, _ in rows if d is not None and t})
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k in texts for w in [k[1].split()]}
    top = {k: k for k in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {t: len(x) for (_, t), x in sets.items()}
    want = sorted(str((d, size.get(t, 0), find((d, t))[0] if (d, t) in top else d)) for d, t, _ in rows)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in near_dedup.near_duplicates(docs).collect()) == want
    kept = near_dedup.keep_one(docs).collect()
    named = [(r.doc_id, r.text) for r in kept if r.doc_id is not None and r.text]
    assert sorted(find(k) for k in named) == sorted({find(k) for k in texts}) and all(find(k)[0] == k[0] for k in named)
    assert {(106, q.replace("b1", "y"))} <= set(named) and (106, p.replace("b0", "z") + " tail") not in named
    assert sum(r.doc_id is None for r in kept) == 2 and sorted(str(r.text) for r in kept if r.doc_id is not None and not r.text) == ["", "None"]


def test_near_duplicates_of_a_drifting_group_against_brute_force(spark):
    rng = np.random.default_rng(9)
    word, docs = [f"v{i}" for i in range(80)], []
    for i in range(160):  # a chain: each a few words off the last, far ones unlike
        word = list(word)
        for j in rng.integers(0, 80, 2):
            word[j] = f"n{i}_{j}"
        docs.append((1000 - i, " ".join(word)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in docs for w in [t.split()]}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: find(d) for d in sets}


def test_near_duplicates_of_a_template_in_narrow_buckets(spark, monkeypatch):
    rng = np.random.default_rng(31)
    template, docs = [f"t{i}" for i in range(60)], []
    for i in range(60):  # pages of one template that don't link, and near copies of some of them
        page = template + [f"p{i}_{j}" for j in range(16)]
        for k in range(1 + i % 3):
            w = list(page)
            if k:
                w[rng.integers(60, 76)] = f"x{i}_{k}"
            docs.append((int(rng.permutation(10_000)[0]) * 100 + len(docs), " ".join(w)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in docs for w in [t.split()]}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    frame, compared = spark.createDataFrame(docs, "doc_id long, text string"), []
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    narrowed = near_dedup._narrowed
    monkeypatch.setattr(near_dedup, "_narrowed", lambda *a: compared.append(narrowed(*a)) or compared[-1])
    got = near_dedup.near_duplicates(frame).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: find(d) for d in sets} and len(set(map(find, sets))) > 30
    assert compared and compared[0].groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 3


def test_language(odd, empty):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3, 10))
    assert {r.lang_pred for r in got} <= {"en", "und"} and langid.identify(empty).count() == 0
    nothing = langid.identify(odd.where("doc_id = 9")).collect()
    assert nothing[0].lang_pred == "und"


def test_language_kernel_against_brute_force():
    texts = ["Ab, abc", "é日本 x", "zz" * 50, LONG, "a", "日本語" * 40_000]

    def sets(t):
        b = t.lower().encode()
        return {b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)}

    own = [sets(t) for t in texts]
    want = [[len(x & y) / (len(x) * len(y)) ** 0.5 for y in own[:4]] for x in own]
    marks = langid.Landmarks(texts[:4])
    assert np.allclose(marks.kernel(texts), want)
    model = langid.Model(["a", "b"], marks, np.arange(8.0).reshape(4, 2))
    assert np.allclose(model.scores(texts), np.array(want) @ model.weights)


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    whole = langid.grams(LONG)
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert (langid.grams(LONG) == whole).all()


def test_no_language_is_left_out(spark):
    rng = np.random.default_rng(2)
    letters = [chr(0x4E00 + 8 * i + j) for i in range(90) for j in range(8)]
    rows = [(90 * k + i, " ".join("".join(rng.choice(letters[8 * i : 8 * i + 8], 5)) for _ in range(20)), f"l{i:02}") for k in range(12) for i in range(90)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {d: x for d, _, x in rows}
    assert {r.lang_pred for r in got} == set(lang.values()) and np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97


def test_long_texts_are_learned_from_whole(spark):
    """Each language shows only at the end of its texts."""
    rows = [(i, "0 " * 15_000 + ("the of and to " if i % 2 else "der die und das ") * 9, "en" if i % 2 else "de") for i in range(40)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got)


def test_numbers_are_not_letters(spark):
    texts = ["½ 100", "②", "Ⅻ", "٣ 4_5", "ª", "ß", "日", "x"]
    rows = [(2 * i, "the of and to it", "en") for i in range(20)] + [(1000 + i, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[1000 + i].lang_pred for i in range(len(texts))] == ["und"] * 4 + ["en"] * 4 and all(got[1000 + i].score == 0 for i in range(4))


def test_scores_are_equal_by_either_order_of_products(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdé "), rng.integers(0, 300))) for _ in range(60)] + ["", "~", LONG]
    model = langid.Model(["a", "b", "c"], langid.Landmarks(texts[:20]), rng.normal(size=(20, 3)))
    narrow = model.scores(texts)
    monkeypatch.setattr(langid, "FOLD", 0)
    wide = model.scores(texts)
    monkeypatch.setattr(langid, "ENTRIES", 100)
    single = model.scores(texts)
    monkeypatch.setattr(langid, "FOLD", 1 << 24)
    assert np.allclose(narrow, wide, rtol=1e-9) and np.allclose(single, wide, rtol=1e-12) and (model.scores(texts) == narrow).all() and model.scores([]).shape == (0, 3)


def test_texts_longer_than_those_learned_from(spark):
    rows = [(i, ("the of and to " if i % 2 else "der die und das ") * 30, "en" if i % 2 else "de") for i in range(40)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got)


def test_mixing(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and len({(r.slot, r.position) for r in got}) == len(got) and None in {r.source for r in got}
    assert mixing.mix_sources(empty).count() == 0
    kept = mixing.in_order(odd)
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert mixing.in_order(empty).count() == 0


def test_schedule_bounds():
    blocks, weights = {"a": 700, "b": 50, "c": 3, "d": 9}, {"a": 0.5, "b": 0.3, "c": 0.2}
    plan = mixing.schedule(blocks, weights)
    assert len(plan) == sum(blocks.values()) and [p[2] for p in plan] == list(range(len(plan)))
    assert all(release <= slot < due for _, _, slot, release, due, _ in plan)
    assert plan[-9:] == [p for p in plan if p[0] == "d"]  # without a weight: last


def test_mixing_equals_the_schedule_without_spark(spark):
    sizes = {"a": 700, "b": 50, "c": 3, "d": 9, "e": 1, "f": 131, "g": 1}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    for weights in (None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"f": 1.0}):
        target = weights or {s: n**mixing.TEMPER for s, n in sizes.items()}
        want = mixing.schedule({s: -(-n // 4) for s, n in sizes.items()}, target)
        got = mixing.mix_sources(docs, weights, block=4).collect()
        assert sorted({(r.slot, r.source, r.block, r.release, r.due, r.phase) for r in got}) == [(t, s, i, a, d, k) for s, i, t, a, d, k in want]
        assert len(got) == sum(sizes.values()) and all(a <= t < d for _, _, t, a, d, _ in want)


def test_ranges_of_slots_agree_with_one_pass(spark):
    most = 0
    for seed in range(3):
        rng = np.random.default_rng(seed)
        sizes = {f"s{i}": int(rng.choice((1, 2, 5, 30, 80, 200))) for i in range((2, 9, 25)[seed])}
        weights = {s: float(rng.choice((0.001, 0.5, 1, 3, 10))) for s in sizes if rng.random() < 0.9}
        docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
        target = spark.createDataFrame([(f"={s}", w) for s, w in weights.items()], "src string, w double")
        windows = mixing._windows(mixing._numbered(docs)[1], target, 1)
        want = sorted((f"={s}", *x) for s, *x in mixing.schedule(sizes, weights))
        for piece in (7, 40):
            plan, rounds = mixing._plan(windows, piece)
            assert sorted((r.src, r.block, r.slot, r.release, r.due, r.phase) for r in plan.collect()) == want
            most = max(most, rounds)
    assert 1 < most < 6


def test_ranges_mend_any_wrong_start(spark, monkeypatch):
    """However the edges are guessed, runs again end in the one schedule."""
    sizes, weights = {"a": 120, "b": 40, "c": 7, "d": 1}, {"a": 3.0, "b": 1.0, "c": 0.2}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    target = spark.createDataFrame([(f"={s}", w) for s, w in weights.items()], "src string, w double")
    windows = mixing._windows(mixing._numbered(docs)[1], target, 1)
    guess = mixing._carried
    monkeypatch.setattr(mixing, "_carried", lambda *a: guess(*a).where("false"))
    plan, rounds = mixing._plan(windows, 30)
    assert sorted((r.src, r.block, r.slot, r.release, r.due, r.phase) for r in plan.collect()) == sorted((f"={s}", *x) for s, *x in mixing.schedule(sizes, weights)) and 1 < rounds <= 6


def test_shares_stay_within_one_block_of_the_fluid(spark):
    """The fluid by fractions of the weights themselves, source after source running out."""
    sizes, weights = {"a": 300, "b": 90, "c": 40, "d": 20, "e": 11}, {"a": Fraction(1, 2), "b": Fraction(1, 4), "c": Fraction(1, 8), "d": Fraction(1, 8)}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    got = sorted((r.slot, r.source) for r in mixing.mix_sources(docs, {s: float(w) for s, w in weights.items()}, block=1).collect())
    fluid, seen, time = dict.fromkeys(sizes, Fraction(0)), Counter(), Fraction(0)
    for slot, source in got:
        seen[source] += 1
        while time < slot + 1:
            left = {s for s in sizes if fluid[s] < sizes[s]}
            flows = {s: weights[s] for s in left if s in weights} or dict.fromkeys(left, Fraction(1))
            total = sum(flows.values())
            step = min(slot + 1 - time, *((sizes[s] - fluid[s]) * total / w for s, w in flows.items()))
            for s, w in flows.items():
                fluid[s] += step * w / total
            time += step
        assert all(abs(seen[s] - fluid[s]) < 1 for s in sizes), slot
    assert seen == sizes


def test_rows_without_ids_are_spread_and_kept(spark):
    docs = spark.range(3000).selectExpr("if(id % 2 = 0, null, id) as doc_id", "'hot' as source", "concat('t', id % 700) as text")
    got = mixing.mix_sources(docs, block=4).collect()
    assert sorted((r.slot, r.position) for r in got) == [(i // 4, i % 4) for i in range(3000)]
    rows, _ = mixing._numbered(docs)
    groups = [r["count"] for r in rows.groupBy("salt").count().collect()]
    assert sorted(r.number for r in rows.collect()) == list(range(3000)) and len(groups) > 4 and max(groups) < 1000
    assert sorted(map(str, mixing.in_order(docs).collect())) == sorted(map(str, docs.collect()))


def test_mixing_of_many_sources_and_blocks(spark):
    docs = spark.range(100_001).selectExpr("id as doc_id", "concat('www.', id % 50001, '.example') as source")
    got = mixing.mix_sources(docs, block=1).toPandas()
    assert len(got) == got.doc_id.nunique() == 100_001 and got.source.nunique() == 50_001
    assert (got.position == 0).all() and sorted(got.slot) == list(range(100_001))
    assert ((got.release <= got.slot) & (got.slot < got.due)).all()


def test_packing(odd, empty):
    got = packing.pack(odd, tokenizer_path(), near=0, fan=2, chunk=3).collect()
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and sum(r.length == 1 and r.start == 0 for r in got) == 3
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_runs_pack_like_items():
    rng = np.random.default_rng(0)
    for _ in range(200):
        capacity, n, parts = int(rng.integers(8, 60)), int(rng.integers(1, 300)), int(rng.integers(1, 5))
        fills = rng.integers(1, capacity + 1, n)
        histogram = Counter(zip(rng.integers(0, parts, n).tolist(), fills.tolist(), strict=True))
        rows = packing.pack_runs([k[0] for k in histogram], [k[1] for k in histogram], list(histogram.values()), capacity, 0, False)
        bins, ends, seen = defaultdict(list), defaultdict(set), Counter()
        for part, fill, lo, hi, base, m, bin0, shift, into, rank, _ in rows:
            for r in range(lo, hi):
                seen[part, fill] += 1
                b = bin0 + (r - base) // m
                bins[b].append((shift + (r - base) % m * fill, fill))
                ends[b].add((into, rank + (r - base) // m))
        assert seen == histogram and len(bins) == len(packing.best_fit(fills, capacity)[2])
        ranks = defaultdict(list)
        for b, items in bins.items():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            ((into, rank),) = ends[b]
            assert at == into <= capacity
            ranks[into].append(rank)
        assert all(sorted(r) == list(range(len(r))) for r in ranks.values())


def test_packing_of_many_underfull_bins(spark):
    texts = ["word " * (600 + i % 5) for i in range(300)] + ["word " * (100 + i % 7) for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    got = packing.pack(docs, tokenizer_path(), fan=2, chunk=4).collect()
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and len(got) == 800 and len({(r.doc_id, r.piece) for r in got}) == 800
    assert len(fill) == 300  # nothing joins two of the large ones, and the small ones fit in beside them


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("aé's  \n\t1#日\u0130\u00a0<|>", max_size=60))
def test_any_text_has_the_tokenizers_ids(text):
    assert TOKENS.ids(text).tolist() == TOKENS.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a  b   c\n\n d\t\tx ", "it's  I'LL we've ’s 日本 x", "<|endoftext|> hi", "\x1c a \x1d", " 　  ", "don't 'tis", "a\x85b", "123abc ½ ª", "y" * 5000, " " * 5000 + "a", "\U0001f600 z"])
def test_tokens_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    assert packing.Tokens(tokenizer_path()).ids(text).tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_quality(odd, empty, labels):
    got = quality.judge(odd, labels).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert quality.judge(empty, labels).count() == 0
    kept = quality.keep_good(odd, labels.where("false"))
    assert kept.columns == odd.columns and kept.count() == sum(not r.base_failed for r in got)


@pytest.mark.parametrize("text", ["is " + "word " * 399, "a word " * 600, "word a " * 600, " ab\tabc\x0bé é1\r\n" * 2000, "word " * 19_999 + "a"])
def test_short_words_are_counted_over_the_whole_text(text):
    w = text.encode().split()
    feats = dict(zip(quality.FEATURES, quality.statistics(text.encode(), WordHashes())[1], strict=True))
    assert feats["shorts"] == sum(len(x) <= 2 for x in w) / len(w)


def test_forest_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (rng.random(4000) < 0.2) ^ (np.abs(x[:, 2] - 0.9) < 0.05)).astype(float)
    forest = quality.fit(x, y)
    grid = np.repeat(rng.random((20, len(quality.FEATURES))), 50, axis=0)
    grid[:, 2] = np.tile(np.linspace(0, 1, 50), 20)
    assert (np.diff(forest.raw(grid).reshape(20, 50), axis=1) <= 1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.7


def test_html():
    text = html_text.main_text
    assert text(None) == text("") == text("<p") == "" and text("<<<>>>") in ("<<<>>>", "")
    page = "<nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>The one of the words in a line that is for you and not for them<br>end</p><p>Short.</p><form>Sign up</form></article><div class='comments'><p>The comment of the day is that it was not in the article</p></div><footer>&copy;</footer>"
    assert text(page) == "T & t The one of the words in a line that is for you and not for them end Short."
    bare = "<div id='sidebar'>Links</div><p>The plain page of the site with words that are in it and not for the rest of us.</p><p>So.</p><ul class=menu><li>x</li></ul><script>if (a < b) '</p>'</script>"
    assert text(bare) == "The plain page of the site with words that are in it and not for the rest of us. So."
    assert text("<article>a <b>b</b>c<!-- x --> d") == "a bc d" and len(text("<article>" + "<p>z " * 20_000)) == 39_999


SNOW = {
    "ru": "Вчера вечером жители нашего города собрались на площади, чтобы вместе встретить первый снег этой зимы.",
    "zh": "昨天晚上，城里的居民聚集在广场上，一起迎接这个冬天的第一场雪。孩子们在雪地里奔跑，老人们坐在长椅上聊天。",
    "ja": "昨夜、町の人々は広場に集まり、この冬の初雪を一緒に迎えました。子供たちは雪の中を走り回っていました。",
    "it": "Ieri sera gli abitanti della nostra città si sono riuniti nella piazza per accogliere insieme la prima neve di questo inverno.",
    "th": "เมื่อวานตอนเย็นชาวเมืองมารวมตัวกันที่จัตุรัสเพื่อต้อนรับหิมะแรกของฤดูหนาวนี้ด้วยกัน",
    "pl": "Wczoraj wieczorem mieszkańcy naszego miasta zebrali się na rynku, aby wspólnie powitać pierwszy śnieg tej zimy.",
    "ar": "تجمع سكان مدينتنا مساء أمس في الساحة من أجل استقبال أول ثلوج هذا الشتاء معا في أجواء من الفرح التي لم نر مثلها",
    "eo": "Hieraŭ vespere loĝantoj kolektiĝis placo kune bonvenigi unuan neĝon vintro infanoj kuris neĝo maljunuloj sidis benkoj babilis",
}


@pytest.mark.parametrize("lang", sorted(SNOW))
def test_html_of_other_languages_without_a_container(lang):
    long, short = SNOW[lang], SNOW[lang][:9].strip()
    menu = "<div class=menu><a href=x>A</a></div><p>" + "<a href=y>link word</a> " * 9 + "</p>"
    assert html_text.main_text(f"{menu}<h1>Title</h1><p>{long}</p><p>{short}</p><p>{long}</p><footer>x</footer>") == f"Title {long} {short} {long}"
    assert html_text.main_text(f"{menu}<h1>{short}</h1><p>{short}.</p><footer>x</footer>") == f"{short} {short}."
    assert html_text.main_text(f"{menu}<article><p>{short}</p></article><footer>x</footer>") == short


def test_html_densities_decide(monkeypatch):
    text, en = html_text.main_text, "The plain page of the site with words that are in it and not for the rest of us."
    assert text(f"<article><p>{en}</p><p><a href=x>Only a link here</a></p><p>Short.</p><p>{en}</p></article>") == f"{en} Only a link here Short. {en}"
    assert text(f"<article><div class='post-header'><h1>T</h1></div><p>{en}</p><div class='share-bar'>Share</div></article>") == f"T {en}"
    junk = "<p>" + "Lorem quux " * 20 + "</p>"
    pages = {
        f"<div><p>{en}</p>{junk}<p>{en}</p></div>": f"{en} {en}",  # long, no stop words, outside an article
        f"<article><p>{en}</p>{junk}<p>{en}</p></article>": f"{en} {'Lorem quux ' * 20}{en}",
        f"<article><p>Teaser.</p></article><div><p>{en}</p><p>{en}</p></div><ul><li><a href=x>{en}</a></ul>": f"Teaser. {en} {en}",
        f"<article><p>{en}</p></article><div><p>Near.</p></div><p>{en}</p>" + f"<article><p>{en}</p></article>": f"{en} {en}",
        f"<p><a href=a>{en}</a></p><p>Menu</p><p><a href=a>x y</a></p><p>x</p><p>{en}</p>": f"x {en}",
    }
    for page, want in pages.items():
        assert text(page) == want
    monkeypatch.setattr(html_text, "LONG", 10**9)
    monkeypatch.setattr(html_text, "LINKS", 2)
    assert not any(text(page) == want for page, want in pages.items())


def test_html_names_count_whole_and_not_against_the_text():
    text, en = html_text.main_text, "The plain page of the site with words that are in it and not for the rest of us."
    inside, want = f"<p>{en}</p><p>Short.</p><p>{en}</p>", f"{en} Short. {en}"
    for page in ("<article class='post share'>%s</article>", "<div class='no-sidebar'>%s</div>", "<main><section id='search-engines'>%s</section></main>", "<article><div class='ad-hoc'>%s</div></article>", "<div class='social-history'>%s</div>", "<div class='sidebar'>%s</div>", "<form>%s</form>", "<article><p class='alert-system'>Short.</p>%s</article>"):
        assert text(page % inside) in (want, f"Short. {want}"), page
    note = f"<p>{en[:60]}</p>"
    for name in ("sidebar", "site-footer", "cookieBanner", "ad", "ad-slot", "comments", "comment-list", "related_items"):
        assert text(f"<div>{inside}</div><div class='x {name}'>{note}</div>") == text(f"<article>{inside}<div id={name}>{note}</div></article>") == want, name
    # an article beside it: the name counts, however much stands there
    assert text(f"<article><p>Brief.</p></article><div class=comments>{inside * 9}</div>") == "Brief."
    assert text(f"<div hidden>{inside}</div><p>Brief.</p><div style='display: none'>{inside}</div><nav>{inside}</nav>") == "Brief."


def test_html_pages_of_many_elements_take_linear_time():
    page = "<article>" + "<b><div class=ad>x</div><i><p>The one of the words in a line that is for you and not for them" * 3000
    assert html_text.main_text(page).count("The one") == 3000


def test_vectors_and_pages_with_clashing_columns_and_without_rows(spark):
    names = "query_id long, rank int, score long, dim int, shard int, qb int, v string, rid long, tree string, d int, shards int, blocks int, n int, q int"
    rows = [(i, [float(i % 7), 1.0 - i % 3], *([1] * 6), "x", 1, "x", 1, 1, 1, 1, 1) for i in range(120)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, {names}")
    plain = lambda df: sorted(map(tuple, mtree.top_k(df).collect()))
    assert plain(table) == plain(table.select("vec_id", "embedding")) and len(plain(table)) == 15
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long")).count() == 0


def test_html_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<article>a</article>", 3)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in html_text.extract(pages).collect()) == [0, 0, 1]


def test_language_model(odd, empty):
    got = hmm.score_texts(odd, head=50, n_classes=20, rounds=1, sample=8).collect()
    assert len(got) == odd.count() and all(np.isfinite([r.score, r.base_score]).all() and r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert hmm.score_texts(empty).count() == 0
    alone = hmm.score_texts(odd.where("doc_id = 4"), mod=1, remainder=0).collect()
    assert alone[0].train_tokens == 0 and alone[0].n_known == 0 and alone[0].base_score == 0


def test_forward_is_exact_and_proper():
    rng = np.random.default_rng(4)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    every = np.array(np.meshgrid(*[range(5)] * 4)).T.reshape(-1)
    p = 10 ** model.forward(every, np.arange(0, len(every), 4), np.full(len(every) // 4, 4))
    assert p.sum() == pytest.approx(1)
    one = every[40:44]
    paths = np.array(np.meshgrid(*[range(3)] * 4)).T.reshape(-1, 4)
    want = sum(model.start[s[0]] * np.prod([model.emit[one[t], s[t]] for t in range(4)]) * np.prod([model.move[s[t], s[t + 1]] for t in range(3)]) for s in paths)
    assert p[10] == pytest.approx(want)


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(6)
    ids = np.concatenate([rng.integers(0, 4, 40) if i % 2 else rng.integers(4, 8, 40) for i in range(50)])
    begin, size = np.arange(0, 2000, 40), np.full(50, 40)
    model, last = hmm.first_model([], np.full(8, 1 / 8), 2, 0), -np.inf
    model.emit = model.emit * rng.uniform(0.8, 1.2, model.emit.shape)
    model.emit /= model.emit.sum(axis=0)
    for _ in range(8):
        now = model.forward(ids, begin, size).sum()
        assert now > last - 1e-3 * abs(now)
        last, totals = now, [np.zeros(2), np.zeros((2, 2)), np.zeros((8, 2))]
        model.expected(ids, begin, size, totals)
        assert totals[2].sum() == pytest.approx(2000) and totals[1].sum() == pytest.approx(1950) and totals[0].sum() == pytest.approx(50)
        model = model.updated(totals, np.full(8, 1e-6))
    assert last > 2000 * np.log10(1 / 8) * 0.8


def test_expected_counts_against_all_paths():
    rng = np.random.default_rng(14)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    size = np.array([1, 6, 3, 6, 2])
    ids = rng.integers(0, 5, size.sum())
    begin = np.cumsum(size) - size
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    for lo, n in zip(begin, size, strict=True):
        x = ids[lo : lo + n]
        paths = np.array(np.meshgrid(*[range(3)] * n)).T.reshape(-1, n)
        p = np.array([model.start[s[0]] * np.prod([model.emit[x[t], s[t]] for t in range(n)]) * np.prod([model.move[s[t], s[t + 1]] for t in range(n - 1)]) for s in paths])
        for s, w in zip(paths, p / p.sum(), strict=True):
            want[0][s[0]] += w
            for t in range(n):
                want[2][x[t], s[t]] += w
                if t:
                    want[1][s[t - 1], s[t]] += w
    for steps in (1, 2, 4, 100):  # held values a step, some steps, or the whole sequence apart
        got = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
        model.expected(ids, begin, size, got, steps)
        assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_scores_are_those_of_the_model_over_all_words(spark, monkeypatch):
    rng = np.random.default_rng(15)
    docs = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 60)).clip(max=400))) for i in range(150)]
    models, forward = [], hmm._forward
    monkeypatch.setattr(hmm, "_forward", lambda model: models.append(model) or forward(model))
    got = {r.doc_id: r for r in hmm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), head=30, n_classes=7).collect()}
    (model,) = models
    train = Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2 for w in t.lower().split())
    least = min(sorted(np.floor(16 * np.log2(c)) for c in train.values())[-(len(model.emit) - 8) :])
    head = sorted((w for w, c in train.items() if np.floor(16 * np.log2(c)) >= least), key=lambda w: (-train[w], w))
    assert len(head) == len(model.emit) - 8 > 10
    shares = [1] * 7
    for w, c in train.items():
        if w not in head:
            shares[zlib.crc32(w.encode()) % 7] += c + 1
    for d, t in docs:
        alpha, score = model.start, 0.0
        for k, w in enumerate([*t.lower().split(), None]):
            k7 = zlib.crc32((w or "").encode()) % 7
            e = model.emit[-1] if w is None else model.emit[head.index(w)] if w in head else model.emit[len(head) + k7] * (train[w] + 1) / shares[k7]
            alpha = (alpha @ model.move if k else alpha) * e
            score, alpha = score + np.log10(alpha.sum()), alpha / alpha.sum()
        assert got[d].score == pytest.approx(score)


def test_top_k(spark):
    rows = [(i, [float(i % 7), 0.5, -1.0]) for i in range(200)] + [(300, None), (301, [1.0, None, 0.0]), (302, [float("nan"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (400, [1.0, 2.0]), (50, [9.0, 9.0, 9.0])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=40).collect()
    best = sorted((r.rank, r.vec_id) for r in got if r.query_id == 100)
    assert best == [(1, 50), (2, 6), (3, 13), (4, 20), (5, 27)]
    assert not [r for r in got if r.query_id in (300, 400)]
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_huge_components_and_repeated_rows(spark):
    rows = [(50, [1e18, 1.0]), (1, [1e18, -3.0]), (2, [-1e300, 1.0]), (3, [0.5, 1.0]), (100, [2.0**40, 3.0]), (4, [2.0**40, 4.0]), (5, [2.0**40, 4.0])] + [(7, [0.0, 1.0])] * 300
    got = defaultdict(dict)
    for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=40).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    cut = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    whole = [(i, [cut(floor(256 * Fraction(x))) for x in v]) for i, v in rows]
    for q in (50, 100):
        (own,) = [v for i, v in whole if i == q]
        want = sorted((-cut(sum(a * b for a, b in zip(own, v, strict=True))), i) for i, v in whole if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, -s) for s, i in want]


def test_m_tree_prunes():
    rng = np.random.default_rng(8)
    v = np.repeat(rng.normal(0, 2000, (40, 8)), 100, axis=0) + rng.normal(0, 20, (4000, 8))
    tree = mtree.MTree(np.arange(4000), v.astype(np.int64))
    best, computed = tree.search(0, v[0].astype(np.int64), 5)
    s = v.astype(np.int64) @ v[0].astype(np.int64)
    assert [x for _, x in best] == [int(i) for i in np.lexsort((np.arange(4000), -s)) if i != 0][:5] and computed < 2000


def test_secrets(spark, odd, empty):
    key, rare = "AKIA" + "Z" * 16, "AKIA" + "Q" * 16
    opaque = "Ab3" * 12
    texts = [f"é\U0001f600 password = 'hunter22' {key} token:x secret: token: abcdefgh", f"x {key}", f"y {key} {opaque}", f"z {rare} API_KEY=\"abc.def-123\"", "0123456789abcdef01234567 "]
    docs = spark.createDataFrame([row(i, t, "en", f"s{i}") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[0].spans == "assign:3:23,access:25:45" and (got[0].n_assign, got[0].n_copied, got[0].n_live) == (1, 1, 1)
    assert got[2].spans.endswith("opaque:23:59") and got[3].n_live == 2 and got[4].spans == "hex:0:24"
    assert (got[0].max_owners, got[0].max_repositories) == (3, 3) and (got[4].max_owners, got[4].max_repositories) == (1, 1)
    spread = spark.createDataFrame([row(i, f"key {rare}", f"l{i % n}", s) for n, s in ((7, "a"), (6, "b")) for i in range(14) for rare in ["AKIA" + s.upper() * 16]], SCHEMA)
    assert {(r.spans, r.n_live) for r in secrets.scan(spread).collect()} == {("access:4:24", 0), ("access:4:24", 1)}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[1] == "x [EXAMPLE]" and clean[4] == "[SECRET] " and clean[0].startswith("é\U0001f600 [SECRET]' [EXAMPLE] token:x")
    assert secrets.scan(odd).count() == secrets.redact(odd).count() == odd.count() and secrets.scan(empty).count() == 0


def test_pipeline(spark, sf, odd, empty, tmp_path, labels):
    import corpus_pipeline as C

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns and got.count() <= odd.count()
        assert stage(spark, empty, str(tmp_path)).count() == 0
    pieces = C.packing_stage(spark, odd, str(tmp_path)).collect()
    assert sum(r.piece == 0 for r in pieces) == odd.count() and C.packing_stage(spark, empty, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in C.quality_rules(spark, docs, sf).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    ids = C.near_duplicates(spark, docs, sf).select("doc_id").collect()
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect())
    out = C.run(spark, sf)
    assert out.select("doc_id").distinct().count() > 500 and not [c for c in out.columns if re.match("__", c)]
