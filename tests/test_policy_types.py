"""Types of policy fields, and the regular-expression dialect of content rules."""

import re

import pytest
from pyspark.sql import functions as F

from kbspark import base as kbase
from kbspark import policy as P
from kbspark.functions import patterns

RULE = "[[rule]]\nname='a'\nmatch={%s}\n%s\n"


@pytest.mark.parametrize(
    "text",
    [RULE % ("ext=['md']", "label='spam'"), RULE % ("ext='md'", "into='x'"), RULE % ("ext=['md', 3]", "into='x'"), RULE % ("path=['a']", "into='x'"), RULE % ("ext=['md']", "into=3"), RULE % ("ext=['md']", "into='x'\nautonomy=true"), "[[rule]]\nname=3\nmatch={ext=['md']}\ninto='x'", "[[rule]]\nname='a'\nmatch='md'\ninto='x'", "rule=3", "rule=['a']", "[rule]\nname='a'", "[retrieval]\nrrf_k='60'", "[retrieval]\nrrf_k=true", "[retrieval]\nrrf_k=6.0", "[retrieval]\nmode=1", "[dedup]\nstrategy=['keep-oldest']", "dedup=1", "retrieval=[]", "event_sink='x'", "[[event_sink]]\ntype='exec'\ncommand=['ls']"],
)
def test_ill_typed_policies_are_refused(spark, text, tmp_path):
    with pytest.raises(P.PolicyError):
        P.load(text)
    (tmp_path / "kb").mkdir()
    kb = kbase.KnowledgeBase.init(spark, str(tmp_path / "kb"))
    (tmp_path / "kb/.kb/policy.toml").write_text(text)
    assert kb._lenient() == P.Policy()


REFUSED = ["a++b", "a**", "a*+", "a{2}{3}", "a{1001}", "a{3,2}", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", r"(a)\1", r"\k<x>", "(?#c)", "(?x)a", "(?P=x)", "*a", "a|*b", "(a", "a)", "[a", "[[:no:]]", r"\Z", r"\G", r"\h", r"\R", "a\\", r"\x{110000}", "(?P<1>a)", "(?)", r"\8", "(+a)"]


@pytest.mark.parametrize("pattern", REFUSED)
def test_patterns_beyond_the_dialect_are_refused(spark, pattern):
    with pytest.raises(patterns.PatternError):
        patterns.java(pattern)
    with pytest.raises(P.PolicyError):
        P.load("[[rule]]\nname='a'\nmatch={content_matches='''%s'''}\ninto='x'" % pattern)


#: pattern, texts that it finds, texts that it doesn't.
ACCEPTED = [
    ("(?P<x>ab)+", ["xABAB"], ["ba"]),
    ("(?<year_1>[0-9]{4})", ["in 1999"], ["199"]),
    ("a{2,3}?b", ["aab"], ["ab"]),
    ("a{,3}", ["xa{,3}y"], ["aaa"]),
    ("end$", ["the end"], ["the end\n", "ends"]),
    ("(?m)^end$", ["x\nend\ny"], ["x end"]),
    ("^a.c$", ["a\rc", "a c"], ["a\nc"]),
    ("(?s)a.c", ["a\nc"], ["ac"]),
    ("[[:alpha:]_]{3}", ["ab_"], ["a1_"]),
    ("[^[:digit:]]", ["x"], ["123"]),
    ("[a&&b]x", ["&x", "bx"], ["cx"]),
    ("[[a]x", ["[x"], ["bx"]),
    ("[]a]x", ["]x"], ["bx"]),
    ("[^]a]x", ["bx"], ["]x"]),
    (r"a\sb", ["a b", "a\tb"], ["a\x0bb"]),
    (r"[\s]", ["\f"], ["\x0b"]),
    (r"\v", ["\x0b"], ["\n"]),
    (r"\Q(a+$\E!", ["(a+$!"], ["a!"]),
    (r"\x41\x{1F600}", ["a\U0001f600"], ["b"]),
    (r"\p{Greek}\pL\P{Lu}", ["αβ1"], ["ab1"]),
    (r"\p{^Greek}", ["a"], ["α"]),
    (r"\101", ["a"], ["b"]),
    ("(?U)a+?", ["aa"], ["b"]),
    ("(?-i:A)b", ["AB", "Ab"], ["ab"]),
    ("x{y}", ["x{y}"], ["xy"]),
    (r"\.\{\*", [".{*"], ["."]),
    ("straße|ÉTÉ", ["STRAßE", "été"], ["strase"]),
    ("", ["", "a"], []),
]


@pytest.mark.parametrize(("pattern", "found", "not_found"), ACCEPTED)
def test_patterns_mean_the_same_on_the_engine(spark, pattern, found, not_found):
    patterns.java(pattern)
    rows = spark.createDataFrame([(t,) for t in found + not_found], "text string")
    hits = {r.text for r in rows.where(F.col("text").rlike(patterns.matcher(pattern))).collect()}
    assert hits == set(found)


def test_plain_patterns_agree_with_another_engine(spark):
    """Constructs that mean the same in both."""
    parts = ["a", "b", "ab", "(a|b)", "[ab]", "[^a]", "a*", "b+?", "(?:ab)?", "\\d", "\\w", "^", "a{2}", "\\b"]
    texts = ["", "a", "b", "ab", "ba", "aab", "abab", "1", "a1b", " a ", "bb a", "Ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    made = [x + y + z for x in parts for y in parts[:7] for z in ("", "$")][::3]
    made = [p for p in made if not re.search(r"[*+?}][*+?]{2}", p)]
    got = rows.select("text", *(F.col("text").rlike(patterns.matcher(p)).alias(f"p{i}") for i, p in enumerate(made))).collect()
    for r in got:
        for i, p in enumerate(made):
            assert r[f"p{i}"] == bool(re.search(p.replace("$", "\\Z"), r.text, re.I)), (p, r.text)
