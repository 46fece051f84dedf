"""Tokens of texts and phrases of queries for full-text search."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str, str]:
    """By Unicode's own decomposition: letters that are one plain letter with marks, those plain letters, and the marks."""
    marks = [c for i in range(0x110000) if unicodedata.category(c := chr(i)) == "Mn"]
    marked, plain = [], []
    for i in range(0xC0, 0x30000):
        parts = [x for x in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(x) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(i) and unicodedata.category(chr(i)) != "Mn":
            marked.append(chr(i)), plain.append(parts[0])
    return "".join(marked), "".join(plain), "".join(marks)


ACCENTED, PLAIN, MARKS = _folds()
#: Letters, numbers and private-use characters, as in both of the regular expressions.
_TOKENS = regex.compile(r"[\p{L}\p{N}\p{Co}]+")
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text) -> Column:
    """Lower case, letters without their marks; marks that stand alone go."""
    return F.translate(F.lower(text), ACCENTED + MARKS, PLAIN)


def tokens(text) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def path_terms(path) -> Column:
    return F.translate(path, "/_-.", "    ")


def parse_query(query: str) -> list[list[str]]:
    """Phrases of a query: each white-space field gives its tokens, the last of them a prefix."""
    plain = query.lower().translate(str.maketrans(ACCENTED, PLAIN, MARKS))
    return [_TOKENS.findall(field) for field in plain.split()]
