"""Embeddings of chunks, kept by content: a network or offline embedder, and a cache that knows what is still to do."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.chunks import chunks, embed
from kbspark.interfaces import Embedder
from kbspark.policy import Retrieval
from kbspark.sources.durable import release, written

#: Texts a request, seconds it may take, contents embedded between two writes.
BATCH, TIMEOUT, ROUND = 64, 120, 50_000
VECTORS = "blob string, seq int, vec array<float>"


class EmbeddingError(RuntimeError):
    pass


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _too_long(message: str) -> bool:
    m = message.lower()
    return "context" in m and any(x in m for x in ("exceed", "larger than", "too long"))


@dataclass(frozen=True)
class HttpEmbedder:
    """An endpoint that takes {model, input} at /embeddings; BATCH texts a request."""

    base_url: str
    model: str
    key_env: str = ""

    @property
    def name(self) -> str:
        return self.model

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        headers = {"Content-Type": "application/json"}
        if self.key_env and os.environ.get(self.key_env):
            headers["Authorization"] = f"Bearer {os.environ[self.key_env]}"
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/embeddings", json.dumps({"model": self.model, "input": texts}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                data = json.load(answer)["data"]
        except urllib.error.HTTPError as e:
            raise EmbeddingError(f"{e.code}: {e.read(4096).decode(errors='replace').strip()}") from e
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise EmbeddingError(str(e)) from e
        by_index = {d["index"]: d["embedding"] for d in data}
        if sorted(by_index) != list(range(len(texts))) or len(data) != len(texts):
            raise EmbeddingError(f"{len(data)} vectors, not one for each of {len(texts)} texts")
        return [unit(np.array(by_index[i], np.float32)) for i in range(len(texts))]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Unit vectors; a batch that the model finds too long is asked once more with its texts cut to half."""
        out = []
        for lo in range(0, len(texts), BATCH):
            batch = texts[lo : lo + BATCH]
            try:
                out += self._ask(batch)
            except EmbeddingError as e:
                if not _too_long(str(e)):
                    raise
                out += self._ask([t[: len(t) // 2] for t in batch])
        return out


@dataclass(frozen=True)
class OfflineEmbedder:
    """Hashed word counts: no network, same interface."""

    name: str = "hashed-words"

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [embed(t) for t in texts]


def embedder(settings: Retrieval):
    return HttpEmbedder(settings.base_url, settings.model, settings.api_key_env) if settings.base_url and settings.model else OfflineEmbedder()


def embedded(f: Callable[[list[str]], list[np.ndarray]], prefix: str = ""):
    """Column function chunks -> (unit vectors, error): f is asked BATCH texts at a time; what failed fails the rows that had a text in it."""

    @F.pandas_udf("vecs array<array<float>>, error string")
    def g(lists: pd.Series) -> pd.DataFrame:
        rows = [list(x) if x is not None else [] for x in lists]
        owner = [i for i, x in enumerate(rows) for _ in x]
        texts = [prefix + t for x in rows for t in x]
        vecs: list[list] = [[] for _ in rows]
        errors: list[str | None] = [None] * len(rows)
        for lo in range(0, len(texts), BATCH):
            own = owner[lo : lo + BATCH]
            try:
                for i, v in zip(own, f(texts[lo : lo + BATCH]), strict=True):
                    vecs[i].append(v.tolist())
            except EmbeddingError as e:
                for i in own:
                    errors[i] = str(e)
        return pd.DataFrame({"vecs": vecs, "error": errors})

    return g


class VectorCache:
    """Vectors by blob under path/<fingerprint>: other settings are another folder, so old vectors are never mixed in.

    What is pending is an anti-join, so draining may stop anywhere and goes on from there.  A blob without text is
    recorded with one row without a vector.  Each write has a folder of its own, so writers don't meet.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Retrieval, f: Embedder | None = None):
        self.spark, self.settings, self.f = spark, settings, f or embedder(settings)
        tuned = settings.tuning()
        self.size, self.overlap = tuned["chunk_size"], tuned["chunk_overlap"]
        facts = "|".join(map(str, (self.f.name, settings.doc_prefix, settings.query_prefix, self.size, self.overlap)))
        self.path = f"{path}/{hashlib.sha256(facts.encode()).hexdigest()[:16]}"

    def vectors(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], VECTORS)
        return self.spark.read.schema(f"{VECTORS}, batch string").parquet(self.path).drop("batch")

    def pending(self, texts: DataFrame) -> DataFrame:
        """blob, text of the distinct blobs of texts (blob, text) that aren't embedded yet."""
        return self._with_text(texts, self._todo(texts))

    def _todo(self, texts: DataFrame) -> DataFrame:
        return texts.select("blob").distinct().join(self.vectors().select("blob"), "blob", "left_anti")

    @staticmethod
    def _with_text(texts: DataFrame, todo: DataFrame) -> DataFrame:
        return texts.select("blob", "text").join(todo, "blob", "left_semi").dropDuplicates(["blob"])

    def drain(self, texts: DataFrame, most: int | None = None, round_: int = ROUND) -> int:
        """Embeds the pending blobs, the first most of them where most is given, in rounds that are each kept when done; their number.

        A blob's vectors are kept all or none.  Where requests failed, the round's other blobs are kept, then EmbeddingError
        is raised.
        """
        done = 0
        while most is None or done < most:
            # only keys are put in order
            todo = self._todo(texts).orderBy("blob").limit(min(round_, most - done) if most is not None else round_)
            got = self._with_text(texts, todo).select("blob", F.coalesce(chunks(self.size, self.overlap)("text"), F.array().cast("array<string>")).alias("c"))
            got = written(got.withColumn("e", embedded(self.f, self.settings.doc_prefix)("c")), "embedded")
            n, failed, error = got.agg(F.count(F.lit(1)), F.count("e.error"), F.max("e.error")).first()
            if n > failed:
                rows = got.where("e.error is null").select("blob", F.posexplode_outer("e.vecs").alias("seq", "vec"))
                rows.select("blob", F.coalesce("seq", F.lit(0)).alias("seq"), "vec").write.parquet(f"{self.path}/batch={uuid.uuid4().hex}")
            release(got)
            done += n - failed
            if failed:
                raise EmbeddingError(f"{failed} of {n} contents: {error}")
            if n < round_:
                break
        return done

    def query(self, text: str) -> list[float]:
        return self.f([self.settings.query_prefix + text])[0].tolist()

    def chunks_of(self, entries: DataFrame) -> DataFrame:
        """path, blob, vec of the embedded chunks of entries (path, blob)."""
        return entries.select("path", "blob").join(self.vectors().where("vec is not null").select("blob", "vec"), "blob")
