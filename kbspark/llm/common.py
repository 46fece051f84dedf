"""Helpers shared by the operators: table access, durable intermediates, word and shingle hashing.

Words are maximal runs of characters outside ``\\x20 \\x09-\\x0D``.  ``bytes.split()`` splits UTF-8 text on
exactly those six characters, so the Python side works on bytes and never decodes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.durable import new_path, release  # noqa: F401
from kbspark.sources.durable import written as materialize  # noqa: F401

U64 = np.uint64
_MULT = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
#: The word-hash cache of a Python worker is emptied at this many words.
CACHE_WORDS = 1 << 19
#: Java form of the word separator.
SPACES = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """word -> 64-bit hash, computed once per distinct word and worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gram_hashes(h: np.ndarray, k: int, mult: int = _MULT) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, by doubling; not yet mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out, done, power, size = None, 0, h, 1
    parts = []
    while size <= k:
        if k & size:
            parts.append((size, power))
        if size * 2 <= k:
            m = U64(pow(mult, size, 1 << 64))
            power = power[: len(power) - size] * m + power[size:]
        size *= 2
    for size, power in reversed(parts):
        piece = power[done : done + n]
        out = piece.copy() if out is None else out * U64(pow(mult, size, 1 << 64)) + piece
        done += size
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def held_out(mod: int, remainder: int):
    """crc32 of the doc_id as text, modulo mod, is remainder (a null id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == remainder, F.lit(False))
