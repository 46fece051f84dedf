"""op 8: secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found in every text by their patterns.  Two more kinds are candidates only: vendor-formatted keys, and long
opaque strings that mix upper case, lower case and digits.  The value of every span is hashed and counted over distinct
(owner, repository) pairs of the whole corpus, pre-aggregated before each shuffle.  A value seen under at most ``OWNERS``
owners and in at most ``REPOSITORIES`` repositories of theirs looks live, as a credential that an owner uses in several places
does; a value seen under more owners or in more repositories is a widely copied example.  Candidate kinds are reported only if
they look live and overlap no base span; base spans are always reported, and counted as live or copied.

An owner is the ``source`` of a row, a repository its (source, lang) pair; nulls count as one owner of their own.

Positions come without a UDF: the lengths of the pieces between matches (``split``) and of the matches
(``regexp_extract_all``), added up alternately, are the code-point offsets.

Defined cases: null and empty texts have no spans; repeated rows get equal results; rows that repeat a doc_id are told apart by
their text; a null doc_id is scanned like any other.  Other columns than doc_id, text, source and lang are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

OWNERS, REPOSITORIES = 2, 6
#: kind, pattern, value group, fewest characters of that group; fixed values of the contract, then the candidate kinds.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", 0, 14),
    ("opaque", r"[A-Za-z0-9+/_-]{32,}", 0, 32),
)
KINDS = (*BASE, *MORE)
_SPAN = "array<struct<start:int,kind:int,stop:int,value:bigint>>"


def _spans(kind: int) -> Column:
    """Spans of one kind: (start, kind, stop, hash of the value)."""
    name, pattern, group, least = KINDS[kind]
    text, p = F.col("text"), F.lit(pattern)
    # the bare match never enters a shuffle, only its 64-bit hash
    parts = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("g"), F.slice(F.split(text, pattern, -1), 1, 1_000_000_000).alias("b"))
    zipped = F.transform(parts, lambda x: F.struct(F.length(x["b"]).alias("b"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("m"), x["m"].alias("t"), x["g"].alias("g")))
    # running offset: total so far, then the spans kept
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        good = x["g"].isNotNull() & (F.length(x["g"]) >= least)
        if name == "opaque":
            good = good & x["t"].rlike("[0-9]") & x["t"].rlike("[a-z]") & x["t"].rlike("[A-Z]")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["m"]).alias("stop"), F.xxhash64(x["g"]).alias("value"))
        return F.struct((start + x["m"]).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, begin, step, lambda a: a["out"])).otherwise(F.array().cast(_SPAN))


def _overlaps(x: Column, y: Column) -> Column:
    return (x["start"] < y["stop"]) & (y["start"] < x["stop"])


def _found(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, th, owner, repository, spans of the base, candidate spans clear of them."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), "source", "lang")
    owner = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), owner.alias("owner"), F.concat(owner, F.lit("/"), F.coalesce("lang", F.lit(""))).alias("repository"), *(_spans(k).alias(f"s{k}") for k in range(len(KINDS))))
    return rows.select("doc_id", "th", "owner", "repository", F.array_sort(F.concat("s0", "s1", "s2")).alias("base"), F.concat("s3", "s4").alias("more"))


def _verdicts(found: DataFrame, owners: int, repositories: int) -> DataFrame:
    """doc_id, th, shown (all spans reported, in order, with verdict and counts) of the rows that have candidates."""
    keyed = found.where("size(base) + size(more) > 0")
    spans = keyed.select("doc_id", "th", "owner", "repository", F.explode(F.concat("base", F.filter("more", lambda x: ~F.exists("base", lambda y: _overlaps(x, y))))).alias("s"))
    seen = spans.select(F.col("s.value").alias("value"), "owner", "repository").distinct()
    seen = seen.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    seen = seen.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    known = spans.select("doc_id", "th", "s").distinct().withColumn("value", F.col("s.value")).join(seen, "value")
    live = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    known = known.where((F.col("s.kind") < len(BASE)) | live)
    shown = F.struct(F.col("s.start"), F.col("s.kind"), F.col("s.stop"), live.alias("live"), "owners", "repositories")
    return known.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(shown)).alias("shown"))


def _written(spans: str) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["stop"])), ",")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def scan(docs: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of every row of docs (doc_id, text, source, lang).

    max_owners and max_repositories follow: of the row's most widely seen span (0 without spans).
    """
    found = materialize(_found(docs), "spans")
    verdicts = _verdicts(found, owners, repositories)
    out = found.join(verdicts.withColumnsRenamed({"doc_id": "doc", "th": "hash"}), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("hash")), "left")
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    most = lambda c: F.coalesce(F.array_max(F.transform("shown", lambda x: x[c])), F.lit(0)).cast("long").alias(f"max_{c}")
    live = lambda yes: F.coalesce(F.size(F.filter("shown", lambda x: x["live"] == yes)), F.lit(0)).cast("long")
    return out.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), F.coalesce(_written("shown"), F.lit("")).alias("spans"),
        F.when(F.col("shown").isNull(), 0).otherwise(live(True)).cast("long").alias("n_live"), F.when(F.col("shown").isNull(), 0).otherwise(live(False)).cast("long").alias("n_copied"), most("owners"), most("repositories"),
    )


LIVE, COPIED = "[SECRET]", "[EXAMPLE]"


def redact(docs: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """docs, all columns kept, with live-looking spans written over by [SECRET] and widely copied ones by [EXAMPLE]; n_chars, if there, follows."""
    found = materialize(_found(docs), "spans")
    verdicts = _verdicts(found, owners, repositories).select(F.col("doc_id").alias("__kb_doc"), F.col("th").alias("__kb_th"), F.col("shown").alias("__kb_shown"))
    joined = docs.join(verdicts, F.col("doc_id").eqNullSafe(F.col("__kb_doc")) & (F.xxhash64("text") == F.col("__kb_th")), "left")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.when(x["live"], F.lit(LIVE)).otherwise(F.lit(COPIED))
        before = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["start"] >= acc["at"], F.struct(x["stop"].alias("at"), F.concat(acc["out"], F.array(before, mark)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("__kb_shown", begin, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.col("__kb_shown").isNull(), F.col("text")).otherwise(done)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kb_shown").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
