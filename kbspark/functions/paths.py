"""Path and glob helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> media type, pinned so that results don't depend on a host's table.
MIME = {"md": "text/markdown", "txt": "text/plain", "log": "text/plain", "csv": "text/csv", "pdf": "application/pdf", "html": "text/html", "json": "application/json", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif"}


def base(path) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path) -> Column:
    """After the last dot of the base name; '' without a dot."""
    return F.regexp_extract(base(path), r"\.([^.]*)$", 1)


def stem(path) -> Column:
    return F.regexp_replace(base(path), r"\.[^.]*$", "")


def parent(path) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def mime(path) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.try_element_at(table, F.lower(extension(path)))


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob whose * and ? never cross a slash; ValueError if malformed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1)
            if end <= i + 1:
                raise ValueError(f"malformed glob: {pattern}")
            out += "(?!/)[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]"
            i = end
        elif c == "\\":
            i += 1
            if i == len(pattern):
                raise ValueError(f"malformed glob: {pattern}")
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return rf"\A{out}\z"


def matches_glob(path, pattern: str) -> Column:
    regex = glob_regex(pattern)
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(regex) | base(path).rlike(regex)


def clean_literal(path: str) -> str:
    """Lexical cleaning: no '.', '//' or inner '..'."""
    out: list[str] = []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part != ".." or not path.startswith("/"):
            out.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(out) or "."


def escapes(path) -> Column:
    """A cleaned path leaves the collection: absolute, or climbing out."""
    return path.startswith("/") | (path == "..") | path.startswith("../")
