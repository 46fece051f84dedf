"""What the operations need of their exchangeable parts."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame


class BlobStore(Protocol):
    """Contents by hash; ``sources.snapshots.Store`` is one."""

    def put_blobs(self, blobs: DataFrame) -> None: ...

    def blobs(self) -> DataFrame: ...

    def has(self, wanted: DataFrame) -> DataFrame: ...

    def contents(self, wanted: DataFrame) -> DataFrame: ...


class ContentsOf(Protocol):
    """blob, text of given blobs (blob), for an index or a cache that knows which it lacks."""

    def __call__(self, blobs: DataFrame) -> DataFrame: ...


class RuleRank(Protocol):
    """Places of rules by name, the strongest first, by which a merge settles moves; ``policy.Policy`` is one."""

    def rank(self) -> dict[str, int]: ...


class TextIndex(Protocol):
    """Documents and postings that full-text search reads; ``operators.search.Index`` is one."""

    docs: DataFrame
    heads: DataFrame
    texts: DataFrame


class Embedder(Protocol):
    """Unit vectors of texts; ``sources.vectors.HttpEmbedder`` and ``OfflineEmbedder`` are two."""

    name: str

    def __call__(self, texts: list[str]) -> list[np.ndarray]: ...
