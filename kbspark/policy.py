"""Declarative policy: strict TOML, validated on the driver, compiled to Column expressions."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import paths, patterns

VARIABLES = ("year", "month", "day", "name", "ext")
AUTONOMY = ("", "propose", "auto")
PINNED, UNSORTED = "kb:pinned", "unsorted"
#: The only event that sinks fire on: fixed value.
COMMITTED = "changeset.committed"
#: Characters of a text that content rules look at.
CONTENT_LIMIT = 1 << 20


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Match:
    ext: tuple[str, ...] = ()
    mime: tuple[str, ...] = ()
    path: str = ""
    content_matches: str = ""


@dataclass(frozen=True)
class Rule:
    name: str
    match: Match
    into: str = ""
    rename: str = ""
    label: tuple[str, ...] = ()
    autonomy: str = ""

    @property
    def places(self) -> bool:
        return bool(self.into or self.rename)


@dataclass(frozen=True)
class Dedup:
    strategy: str = "keep-oldest"
    on_conflict: str = ""


@dataclass(frozen=True)
class Retrieval:
    mode: str = ""
    base_url: str = ""
    model: str = ""
    api_key_env: str = ""
    doc_prefix: str = ""
    query_prefix: str = ""
    rrf_k: int = 0
    candidate_factor: int = 0
    chunk_size: int = 0
    chunk_overlap: int = 0

    def tuning(self) -> dict[str, int]:
        size = self.chunk_size or 1000
        return {"rrf_k": self.rrf_k or 60, "candidate_factor": self.candidate_factor or 4, "chunk_size": size, "chunk_overlap": self.chunk_overlap or min(200, size // 2)}


@dataclass(frozen=True)
class EventSink:
    on: str = ""
    type: str = ""
    command: str = ""
    url: str = ""


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()
    dedup: Dedup = field(default_factory=Dedup)
    retrieval: Retrieval = field(default_factory=Retrieval)
    sinks: tuple[EventSink, ...] = ()

    def rank(self) -> dict[str, int]:
        return {r.name: i for i, r in enumerate(self.rules)}


_TYPES = {"str": "a string", "int": "a whole number", "tuple[str, ...]": "a list of strings", "Match": "a table"}


def _table(raw, where: str) -> dict:
    if not isinstance(raw, dict):
        raise PolicyError(f"{where}: not a table")
    return raw


def _tables(raw, where: str) -> list[dict]:
    if not isinstance(raw, list):
        raise PolicyError(f"{where}: not a list of tables")
    return [_table(x, where) for x in raw]


def _build(kind, raw: dict, where: str):
    """kind of the keys of raw, each of the type that its field has."""
    kinds = {f.name: f.type for f in fields(kind)}
    if unknown := set(_table(raw, where)) - set(kinds):
        raise PolicyError(f"{where}: unknown keys {sorted(unknown)}")
    values = {}
    for k, v in raw.items():
        fits = {"str": isinstance(v, str), "int": type(v) is int, "tuple[str, ...]": isinstance(v, list) and all(isinstance(x, str) for x in v), "Match": isinstance(v, Match)}
        if not fits[kinds[k]]:
            raise PolicyError(f"{where}: {k} must be {_TYPES[kinds[k]]}, not {v!r}")
        values[k] = tuple(v) if isinstance(v, list) else v
    return kind(**values)


def _check_pattern(pattern: str, rule: str) -> None:
    """Of the dialect, and good for the engine that runs it, if there is one by now."""
    try:
        text = patterns.matcher(pattern)
    except patterns.PatternError as e:
        raise PolicyError(f"rule {rule}: {e}") from e
    if spark := SparkSession.getActiveSession():
        try:
            spark._jvm.java.util.regex.Pattern.compile(text)
        except Py4JJavaError as e:
            raise PolicyError(f"rule {rule}: {pattern!r}: {e.java_exception.getMessage()}") from e


def _check_template(text: str, rule: str) -> None:
    if unknown := set(re.findall(r"\{([^}]*)\}", text)) - set(VARIABLES):
        raise PolicyError(f"rule {rule}: unknown variables {sorted(unknown)}")
    if text.startswith("/") or ".." in text.split("/"):
        raise PolicyError(f"rule {rule}: {text} leaves the collection")


def load(text: str) -> Policy:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise PolicyError(str(e)) from e
    if unknown := set(raw) - {"rule", "dedup", "retrieval", "event_sink"}:
        raise PolicyError(f"unknown keys {sorted(unknown)}")
    rules, seen = [], set()
    for r in _tables(raw.get("rule", []), "rule"):
        name = r.get("name", "")
        if not name or not isinstance(name, str) or name in seen:
            raise PolicyError(f"rule name missing or repeated: {name!r}")
        seen.add(name)
        rule = _build(Rule, {**r, "match": _build(Match, r.get("match", {}), f"rule {name} match")}, f"rule {name}")
        if rule.match == Match():
            raise PolicyError(f"rule {name}: empty match")
        if not (rule.places or rule.label):
            raise PolicyError(f"rule {name}: no action")
        for t in (rule.into, rule.rename):
            _check_template(t, name)
        if "/" in rule.rename:
            raise PolicyError(f"rule {name}: rename holds a slash")
        if rule.autonomy not in AUTONOMY:
            raise PolicyError(f"rule {name}: autonomy {rule.autonomy!r}")
        if rule.match.path:
            try:
                paths.glob_regex(rule.match.path)
            except ValueError as e:
                raise PolicyError(f"rule {name}: {e}") from e
        if rule.match.content_matches:
            _check_pattern(rule.match.content_matches, name)
        rules.append(rule)
    dedup = _build(Dedup, raw.get("dedup", {}), "dedup")
    if dedup.strategy not in ("", "keep-oldest", "keep-newest") or dedup.on_conflict not in ("", "escalate"):
        raise PolicyError(f"dedup: {dedup}")
    retrieval = _build(Retrieval, raw.get("retrieval", {}), "retrieval")
    if retrieval.mode not in ("", "fts", "vector", "hybrid"):
        raise PolicyError(f"retrieval mode {retrieval.mode!r}")
    if retrieval.mode in ("vector", "hybrid") and not (retrieval.base_url and retrieval.model):
        raise PolicyError("retrieval: base_url and model are needed")
    if min(retrieval.rrf_k, retrieval.candidate_factor, retrieval.chunk_size, retrieval.chunk_overlap) < 0:
        raise PolicyError("retrieval: tuning out of range")
    tuned = retrieval.tuning()
    if tuned["chunk_overlap"] >= tuned["chunk_size"]:
        raise PolicyError(f"retrieval: an overlap of {tuned['chunk_overlap']} isn't smaller than a chunk of {tuned['chunk_size']}")
    sinks = []
    for s in _tables(raw.get("event_sink", []), "event_sink"):
        s = _build(EventSink, s, "event_sink")
        if s.on not in ("", COMMITTED):
            raise PolicyError(f"event_sink: on {s.on!r}")
        if s.type not in ("webhook", "exec") or s.type == "webhook" and not s.url or s.type == "exec" and not s.command:
            raise PolicyError(f"event_sink: {s}")
        sinks.append(s)
    return Policy(tuple(rules), dedup, retrieval, tuple(sinks))


def condition(m: Match, path: str = "path", text: str = "text") -> Column:
    """All set conditions, cheapest first; unset ones don't count."""
    out = F.lit(True)
    if m.ext:
        out = out & F.lower(paths.extension(path)).isin([e.lower().lstrip(".") for e in m.ext])
    if m.mime:
        kind, any_of = paths.mime(path), F.lit(False)
        for x in m.mime:
            any_of = any_of | (kind.startswith(x[:-1].lower()) if x.endswith("/*") else kind == x.lower())
        out = out & F.coalesce(any_of, F.lit(False))
    if m.path:
        out = out & paths.matches_glob(path, m.path)
    if m.content_matches:
        out = out & F.coalesce(F.substring(text, 1, CONTENT_LIMIT).rlike(patterns.matcher(m.content_matches)), F.lit(False))
    return out


def render(template: str, path: str = "path", mod_time: str = "mod_time") -> Column:
    """One pass over the template: values are never expanded again."""
    values = {"year": F.date_format(mod_time, "yyyy"), "month": F.date_format(mod_time, "MM"), "day": F.date_format(mod_time, "dd"), "name": paths.stem(path), "ext": paths.extension(path)}
    parts = re.split(r"\{([a-z]+)\}", template)
    return F.concat(*(values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def target(rule: Rule, path: str = "path", mod_time: str = "mod_time") -> Column:
    directory = render(paths.clean_literal(rule.into), path, mod_time) if rule.into else paths.parent(path)
    name = render(rule.rename, path, mod_time) if rule.rename else paths.base(path)
    return F.when(directory.isin("", "."), name).otherwise(F.concat_ws("/", directory, name))
