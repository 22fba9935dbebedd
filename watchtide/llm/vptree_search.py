"""Nearest neighbours: a vantage-point tree per shard, pruned by the triangle inequality relaxed by a factor."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.llm.vectors import matrix, usable

K = 10
SHARD_ROWS = 16_384
QUERY_ROWS = 8_192  # queries searched together
LEAF_ROWS = 128
FACTOR = 1.0  # exact
STEP = 1 << 18  # coordinates compared at once
NOBODY = np.iinfo(np.int64).max


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of `x` to each row of `y`, from differences (no cancellation)."""
    out = np.empty((len(x), len(y)))
    rows = max(1, STEP // max(1, y.size))
    for at in range(0, len(x), rows):
        apart = x[at:at + rows, None, :] - y[None]
        out[at:at + rows] = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))
    return out


class VantageForest:
    """A tree over points; each node holds a vantage point and the radius that halves its points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, seed: int = 42):
        self.ids, self.points = ids, points
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, own: np.ndarray):
        if len(own) <= LEAF_ROWS:
            return own
        vantage = self.points[own[self.rng.integers(len(own))]]
        far = lengths(self.points[own], vantage[None])[:, 0]
        radius = float(np.median(far))
        inner = far <= radius
        if inner.all():  # copies of one point
            return own
        return vantage, radius, self._grow(own[inner]), self._grow(own[~inner])

    def search(self, own_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest points of each query but its own, nearest first, ties to smaller ids.

        All queries descend together, each first into the side it lies on. The other side can be left out where
        every point there is farther than the k-th found so far; with a factor above 1 it is left out where it
        is farther than that distance divided by the factor.
        """
        self.best_id = np.full((len(queries), k), NOBODY)
        self.best = np.full((len(queries), k), np.inf)
        self._descend(self.root, own_ids, queries, np.arange(len(queries)), factor)
        return self.best_id, self.best

    def _descend(self, node, own_ids, queries, some, factor):
        if not len(some):
            return
        if isinstance(node, np.ndarray):
            k = self.best.shape[1]
            for at in range(0, len(node), 4 * LEAF_ROWS):
                part = node[at:at + 4 * LEAF_ROWS]
                found = lengths(queries[some], self.points[part])
                found[own_ids[some, None] == self.ids[part][None]] = np.inf
                ids = np.concatenate([self.best_id[some], np.broadcast_to(self.ids[part], found.shape)], axis=1)
                ids = np.where(np.isinf(all_found := np.concatenate([self.best[some], found], axis=1)), NOBODY, ids)
                order = np.lexsort((ids, all_found), axis=1)[:, :k]
                self.best_id[some] = np.take_along_axis(ids, order, axis=1)
                self.best[some] = np.take_along_axis(all_found, order, axis=1)
            return
        vantage, radius, inside, outside = node
        far = lengths(queries[some], vantage[None])[:, 0]
        inner = far <= radius
        self._descend(inside, own_ids, queries, some[inner], factor)
        self._descend(outside, own_ids, queries, some[~inner], factor)
        # Rounding must not prune a tie, hence the small allowance.
        open_to = np.abs(far - radius) <= self.best[some, -1] / factor * (1 + 1e-9) + 1e-12
        self._descend(outside, own_ids, queries, some[inner & open_to], factor)
        self._descend(inside, own_ids, queries, some[~inner & open_to], factor)


def nearest(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, factor: float = FACTOR
) -> DataFrame:
    """(`query_id`, `rank`, `vec_id`, `score`): the k nearest rows of each query row but itself (fewer, if there are
    fewer), by Euclidean distance in double precision, nearest first, ties to the smaller id.

    Rows are dealt into shards by a hash of their id and queries into blocks; each shard plants a tree per block
    of queries, and the k best of every shard are merged. With `factor` 1 the answer is exact; above 1 fewer
    branches are searched. Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without an id, take no part; vectors of different lengths are never compared. Rows that
    repeat an id are candidates each, ask once (with the smallest of their vectors), and never answer their own id.
    Components beyond about 1e150, whose squares overflow, are out of range.
    """
    if factor < 1:
        raise ValueError("the factor is 1 (exact) or more")
    held = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    held = held.filter(usable("vector") & F.col("id").isNotNull())
    n, asks = held.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asks / QUERY_ROWS))
    place = F.xxhash64("id", F.lit("shard"))
    data = held.select(
        "id", "vector", F.lit(False).alias("asks"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    queries = held.filter("asks").groupBy("id").agg(F.min("vector").alias("vector")).select(
        "id", "vector", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"),
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _size, same in group.groupby(group["vector"].map(len)):
            own, ask = same[~same["asks"]].sort_values("id"), same[same["asks"]]
            if not len(own) or not len(ask):
                continue
            forest = VantageForest(own["id"].to_numpy(), matrix(own["vector"]))
            asked = ask["id"].to_numpy()
            ids, far = forest.search(asked, matrix(ask["vector"]), k, factor)
            found = ids != NOBODY
            out.append(pd.DataFrame({"query_id": np.repeat(asked, found.sum(axis=1)), "vec_id": ids[found], "score": far[found]}))
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return reduce(lambda a, b: pd.concat([a, b]), out, empty)

    found = data.union(queries).groupBy("shard", "block").applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
