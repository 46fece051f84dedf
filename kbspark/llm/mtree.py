"""op 7: exact top-k by inner product with paged M-trees and best-first search.

Vectors become whole numbers floor(256 x).  With m the largest norm of a page set, the extra coordinate sqrt(m^2 - |v|^2)
turns the largest inner product into the smallest Euclidean distance, a metric, so an M-tree applies.  The vectors are
dealt by a hash of vec_id and row to shards of about ``SHARD`` rows (copies of one vector, and repeated rows, spread evenly); each shard is bulk-loaded into
one M-tree of paged nodes: routing entries hold an object, its covering radius and its distance to the parent, leaves hold the
distances of their vectors to the routing object.  A search keeps a queue of nodes by their least possible distance and stops
when that exceeds the k-th best; stored parent distances and the triangle inequality spare distance computations.  A shard's tree
goes to one task, and the queries come to it in blocks, one at a time, so a task holds one tree and one block; the k best that
each block finds in each shard are merged.  Queries are far smaller than trees, and vectors are sent once.  Scores are exact
integers; bounds are only used with a slack for rounding.

Defined cases: null vectors and those with null, NaN or infinite components take no part; only vectors of equal length are
compared; a row of the same vec_id as the query counts as its own; repeated vec_ids of other rows are candidates once per row;
ties go to the smaller vec_id; with fewer than k candidates all are given; an empty table gives an empty result.  Components of
which floor(256 x) leaves the range of a long, and scores that do, count as its least or greatest number.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
SHARD, LEAF, FAN, QUERIES = 8192, 256, 32, 256
#: Bounds must miss by this share of the distances at hand before they exclude anything.
SLACK, ROUGH = 1e-9, 1e-6
_LONG = 2**63 - 1


class MTree:
    """nodes: (routing objects, radii, distances to the own routing object, children) or leaves (rows, distances)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(norms.max(initial=0.0))
        self.points = np.concatenate([vectors, np.sqrt(np.maximum(self.top - norms, 0))[:, None]], axis=1).astype(np.float64)
        self.nodes: list[tuple] = []
        self.leaf, self.fan = leaf, fan
        self.pages: list[np.ndarray] = []
        self.filled = 0
        self.center = self.points.mean(axis=0) if len(ids) else np.zeros(vectors.shape[1] + 1)
        self.root = self._load(np.arange(len(ids)), self.center)
        # leaves are slices of one table in page order
        order = np.concatenate(self.pages) if self.pages else np.empty(0, np.int64)
        self.ids, self.points, self.pages = ids[order], self.points[order], []
        # doubles hold whole numbers up to 2^53; larger ones are kept as they are
        self.whole = vectors[order] if len(ids) and np.abs(vectors.astype(np.float64)).max() > 2.0**53 else None

    def _load(self, rows: np.ndarray, center: np.ndarray) -> int:
        """Number of the node over rows, whose routing object is center."""
        if len(rows) <= self.leaf:
            d = np.sqrt(((self.points[rows] - center) ** 2).sum(axis=1))
            order = np.argsort(d, kind="stable")
            self.nodes.append((True, self.filled, d[order]))
            self.pages.append(rows[order])
            self.filled += len(rows)
            return len(self.nodes) - 1
        k = min(self.fan, -(-len(rows) // self.leaf))
        picked, p = [rows[0]], self.points[rows]
        far = ((p - self.points[rows[0]]) ** 2).sum(axis=1)
        nearest = np.zeros(len(rows), np.int64)
        for j in range(1, k):
            i = int(far.argmax())
            picked.append(rows[i])
            d = ((p - p[i]) ** 2).sum(axis=1)
            nearest = np.where(d < far, j, nearest)
            far = np.minimum(far, d)
        if np.bincount(nearest, minlength=k).max() > 0.9 * len(rows):  # copies, or one cluster: pages of equal size
            nearest = np.arange(len(rows)) * k // len(rows)
        objects, radii, up, children = [], [], [], []
        for j in range(k):
            own = rows[nearest == j]
            if not len(own):
                continue
            obj = self.points[picked[j]]
            objects.append(obj)
            radii.append(np.sqrt(((self.points[own] - obj) ** 2).sum(axis=1).max()))
            up.append(np.sqrt(((obj - center) ** 2).sum()))
            children.append(self._load(own, obj))
        self.nodes.append((False, np.array(objects), np.array(radii), np.array(up), children))
        return len(self.nodes) - 1

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), best first, and the number of distances computed."""
        point = np.append(q.astype(np.float64), 0.0)
        base = float((point**2).sum()) + self.top
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        limit, computed = np.inf, 0
        start = np.sqrt(((point - self.center) ** 2).sum())
        # whole numbers stay exact in doubles while no sum can pass 2^52
        exact = self.whole is None and self.top * (base - self.top) < 2.0**104
        whole = point[:-1] if exact else q.astype(object)
        slack = SLACK if exact else ROUGH
        queue = [(0.0, self.root, start)]
        while queue:
            least, node, d0 = heapq.heappop(queue)
            if least > limit:
                break
            page = self.nodes[node]
            if page[0]:
                first, d = page[1], page[2]
                lo, hi = (np.searchsorted(d, d0 - limit), np.searchsorted(d, d0 + limit, side="right")) if limit < np.inf else (0, len(d))
                if lo >= hi:
                    continue
                computed += hi - lo
                if exact:
                    scores = self.points[first + lo : first + hi, :-1] @ whole
                else:
                    rows = (self.points[:, :-1] if self.whole is None else self.whole)[first + lo : first + hi]
                    scores = np.array([max(-_LONG, min(_LONG, x)) for x in rows.astype(np.int64).astype(object) @ whole], object)
                ids = self.ids[first + lo : first + hi]
                if len(best) == k:
                    near = scores >= best[0][0]
                    ids, scores = ids[near], scores[near]
                for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                    if i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    limit = np.sqrt(max(base - 2 * float(best[0][0]), 0.0)) + slack * (1 + np.sqrt(base))
            else:
                _, objects, radii, up, children = page
                ok = np.flatnonzero(np.abs(d0 - up) - radii <= limit)
                computed += len(ok)
                d = np.sqrt(((objects[ok] - point) ** 2).sum(axis=1))
                for i, x in zip(ok.tolist(), d.tolist(), strict=True):
                    low = x - radii[i]
                    if low <= limit:
                        heapq.heappush(queue, (max(low, least, 0.0), children[i], x))
        return [(int(s), -i) for s, i in sorted(best, reverse=True)], computed


def _tree(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("vec_id", kind="stable")
    tree = MTree(part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.int64))
    return pd.DataFrame({"dim": [part["dim"].iloc[0]], "shard": [part["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})


def _block(part: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(part["v"].to_numpy()).astype(np.int64)
    narrow = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)
    return pd.DataFrame({"dim": [part["dim"].iloc[0]], "qb": [part["qb"].iloc[0]], "block": [pickle.dumps((part["vec_id"].to_numpy(np.int64), v.astype(narrow)))]})


def _search(k: int):
    """Rows in the order of (dim, shard, qb): a shard's tree (qb -1), then the blocks of queries for it."""

    def run(batches):
        tree = None
        for batch in batches:
            for qb, data in zip(batch.column("qb").to_pylist(), batch.column("data"), strict=True):
                if qb < 0:
                    tree = pickle.loads(data.as_py())
                    continue
                ids, vectors = pickle.loads(data.as_py())
                rows = [(own, s, x) for own, q in zip(ids.tolist(), vectors.astype(np.int64), strict=True) for s, x in tree.search(own, q, k)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each row of vectors (vec_id, embedding) whose vec_id is divisible by every."""
    good = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    scaled = f"transform(embedding, x -> cast(greatest(least(floor({SCALE}D * cast(x as double)), {_LONG}L), -{_LONG}L) as bigint))"
    rows = vectors.select("vec_id", "embedding").where(good).selectExpr("vec_id", "size(embedding) as dim", f"{scaled} as v", "monotonically_increasing_id() as rid")
    n = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("int")).alias("q"))
    parts = n.selectExpr("dim as d", f"cast(ceil(n / {shard}) as int) as shards", f"cast(ceil(greatest(q, 1) / {QUERIES}) as int) as blocks")
    rows = rows.join(parts, F.col("dim") == F.col("d"))
    trees = rows.withColumn("shard", F.expr("cast(pmod(xxhash64(vec_id, rid), shards) as int)")).groupBy("dim", "shard").applyInPandas(_tree, "dim int, shard int, tree binary")
    trees = materialize(trees, "trees")
    queries = rows.where(F.col("vec_id") % every == 0).select("dim", "vec_id", "v", "blocks").dropDuplicates(["vec_id", "v"])
    blocks = queries.withColumn("qb", F.expr("cast(pmod(xxhash64(vec_id, v, 1), blocks) as int)")).groupBy("dim", "qb").applyInPandas(_block, "dim int, qb int, block binary")
    asked = blocks.join(parts.select(F.col("d").alias("dim"), "shards"), "dim").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
    both = trees.selectExpr("dim", "shard", "-1 as qb", "tree as data").unionByName(asked.selectExpr("dim", "shard", "qb", "block as data"))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "qb").select("qb", "data").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
