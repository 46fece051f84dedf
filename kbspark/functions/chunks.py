"""Chunking, hashed embeddings and byte-bounded cuts: the few functions that are sequential by nature, as Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

DIMENSIONS = 256


def chunk(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most size bytes, cut at the last paragraph, sentence, line or word end in their second half."""
    size = size or 1000
    if not 0 <= overlap < size:
        overlap = 0
    left = text.strip().encode()
    if not left:
        return []
    out, at = [], 0
    while len(left) - at > size:
        window, cut = left[at : at + size], size
        for mark in (b"\n\n", b". ", b"\n", b" "):
            i = window.rfind(mark)
            if i > size // 2:
                cut = i + len(mark)
                break
        out.append(window[:cut])
        step = cut - overlap
        at += step if step > 0 else cut
    out.append(left[at:])
    return [p for x in out if (p := x.decode("utf-8", "replace").strip())]


def chunks(size: int = 1000, overlap: int = 200):
    @F.pandas_udf("array<string>")
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t or "", size, overlap))

    return f


def embed(text: str) -> np.ndarray:
    """Unit vector of word counts hashed by 32-bit FNV-1a: the offline embedder."""
    v = np.zeros(DIMENSIONS, np.float32)
    for word in text.lower().split():
        h = 2166136261
        for b in word.strip(".,;:!?\"'()[]{}").encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        v[h % DIMENSIONS] += 1
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def embeddings(f=embed, prefix: str = ""):
    @F.pandas_udf("array<float>")
    def g(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(prefix + (t or "")).tolist())

    return g


def truncate(text: str, limit: int) -> str:
    """Longest prefix of at most limit bytes."""
    return text.encode()[: max(0, limit)].decode("utf-8", "ignore")


def truncated(limit: int):
    @F.pandas_udf("string")
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else truncate(t, limit))

    return f
