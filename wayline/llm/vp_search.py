"""Nearest neighbours by vantage-point trees, one for each shard.

A node splits its points by their distance to a vantage point at the median.
A query goes down the side it falls on; the other side is visited unless
factor * |distance to the vantage point - radius| exceeds the distance of the
k-th nearest point so far. Factor 1 is the triangle inequality and gives exact
results; larger factors leave out more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.blocks import meet, shards_for, vectors


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class VantageTree:
    """Distinct vectors with their ids; equal vectors are one point."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 128, seed: int = 1):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        self.first = np.append(np.flatnonzero(new), len(x))
        self.ids, self.x, self.leaf = ids, x[new], leaf
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self._build(np.arange(len(self.x)))

    def _build(self, points: np.ndarray) -> int:
        """Nodes are (points,) or (vantage point, radius, inside, outside); without recursion."""
        todo = [(points, -1, 0)]
        while todo:
            points, parent, side = todo.pop()
            here = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = here
            if len(points) > self.leaf:
                v = points[self.rng.integers(len(points))]
                rest = points[points != v]
                d = distances(self.x[rest], self.x[v])
                radius = np.median(d)
                near = d <= radius
                if not near.all():
                    self.nodes.append([np.array([v]), float(radius), -1, -1])
                    todo += [(rest[near], here, 2), (rest[~near], here, 3)]
                    continue
            self.nodes.append([points])
        return 0

    def search(self, q: np.ndarray, own: int, k: int, factor: float) -> list[tuple[float, int]]:
        """The k nearest (distance, id), ties to smaller ids, without the query's own id."""
        best: list[tuple[float, int]] = []
        bound = np.inf
        todo = [(0, 0.0)]
        while todo:
            at, least = todo.pop()
            if factor * least > bound:
                continue
            node = self.nodes[at]
            points = node[0]
            d = distances(self.x[points], q)
            for j in np.flatnonzero(d <= bound):
                a, b = self.first[points[j]], self.first[points[j] + 1]
                best += [(float(d[j]), int(i)) for i in self.ids[a:min(b, a + k + 1)] if i != own][:k]
            if len(best) >= k:
                best = sorted(best)[:k]
                bound = best[-1][0]
            if len(node) == 4:
                gap = d[0] - node[1]
                inside, outside = (node[2], max(0.0, gap)), (node[3], max(0.0, -gap))
                todo += [outside, inside] if gap <= 0 else [inside, outside]
        return sorted(best)[:k]


SCHEMA = "query_id long, vec_id long, score double"


def search(df: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, shard_rows: int = 4096, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`.

    query_id, rank from 1, vec_id, score: the Euclidean distance in double
    precision. Ties go to smaller ids. Null vectors, zero ones and those with
    null or non-finite components take no part; rows of one id count once, with
    the smallest vector. The number of shards grows with the rows, and each is
    searched by all queries, which stream past it in blocks.
    """
    data = vectors(df, id_col, vec_col, zero=False)
    shards = shards_for(data.count(), shard_rows)
    queries = data.where(F.col("vec_id") % every == 0).withColumn("extra", F.lit(None).cast("binary"))

    def serve(ids, x):
        tree = VantageTree(ids, x)

        def ask(query_ids, q, _):
            rows = [(int(i), n, d) for i, v in zip(query_ids, q) for d, n in tree.search(v, int(i), k, factor)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])
        return ask

    found = meet(data, queries, shards, serve, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
