"""Exact top-k by inner product of whole numbers: MaxScore over postings of components, shard by shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.llm.whole_vectors import by_length, floats, whole_rows

K = 5
SCALE = 256.0
SHARD_ROWS = 65_536  # candidates whose postings a task holds
FEW_ROWS = 2_048  # a table is dealt over all cores down to shards of this size
MOST = 1 << 26  # largest whole component either way: products of 1024 components stay below 2**62
HEADS = 32  # strongest rows of a term, either sign, that give the first threshold
STRONG_TERMS = 4
FOUND = "query_id bigint, vec_id bigint, score bigint"


class Postings:
    """The candidates of a shard by term. A term is a component, its postings the rows where that is not zero."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids = ids
        self.columns = np.ascontiguousarray(matrix.T)
        self.most, self.least = self.columns.max(axis=1, initial=0), self.columns.min(axis=1, initial=0)
        self.rows: list[np.ndarray | None] = []  # None: more than half of them, traversed as the whole column
        self.highest: list[np.ndarray] = []
        self.lowest: list[np.ndarray] = []
        heads = min(HEADS, len(ids))
        for column in self.columns:
            held = np.flatnonzero(column)
            self.rows.append(None if 2 * len(held) > len(ids) else held)
            self.highest.append(np.argpartition(column, len(ids) - heads)[len(ids) - heads:])
            self.lowest.append(np.argpartition(column, heads - 1)[:heads])

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates but those of `own_id`, best first, ties to smaller ids.

        A term's bound is the most it can add to a score (never below 0, what absence adds). The threshold is the
        k-th best score among rows at the heads of the strongest terms. The weakest terms whose bounds together
        stay below it are non-essential: a row that is in none of the other lists cannot reach the threshold.
        So the essential lists are traversed, and the rows found are probed in the other terms, strongest first,
        as long as what they have and what is left to gain reach the threshold. With a threshold of 0 or less
        every row is competitive, and every term essential.
        """
        terms = np.flatnonzero(query)
        bounds = np.maximum(np.maximum(query * self.most, query * self.least), 0)[terms]
        order = np.argsort(-bounds, kind="stable")  # strongest first
        terms, bounds = terms[order], bounds[order]
        least = self._threshold(own_id, query, terms, k)
        below = np.cumsum(bounds[::-1])[::-1]  # what terms i, i+1, ... can add
        essential = int(np.searchsorted(-below, -least, side="right")) if least > 0 else len(terms)
        scores, step = np.zeros((2, len(self.ids)), dtype=np.int64)
        met = np.full(len(self.ids), least <= 0)
        for t in terms[:essential]:
            rows = self.rows[t]
            if rows is None:
                scores += np.multiply(self.columns[t], query[t], out=step)
                met[:] = True  # the few rows without the term are probed like the others
            else:
                scores[rows] += query[t] * self.columns[t, rows]
                met[rows] = True
        left = int(below[essential]) if essential < len(terms) else 0
        rows = np.flatnonzero(met & (scores + left >= least) & (self.ids != own_id))
        scores = scores[rows]
        for t, bound in zip(terms[essential:], bounds[essential:]):
            scores += query[t] * self.columns[t, rows]
            left -= int(bound)
            stay = scores + left >= least
            if not stay.all():
                rows, scores = rows[stay], scores[stay]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]

    def _threshold(self, own_id: int, query: np.ndarray, terms: np.ndarray, k: int) -> int:
        """A score that k rows reach; the smallest possible one if too few rows are tried."""
        strong = terms[:STRONG_TERMS]
        if not len(strong):
            return 0  # every score is 0
        tried = np.unique(np.concatenate([self.highest[t] if query[t] > 0 else self.lowest[t] for t in strong]))
        tried = tried[self.ids[tried] != own_id]
        if len(tried) < k:
            return np.iinfo(np.int64).min // 2
        return int(np.partition(query @ self.columns[:, tried], -k)[-k])


def _search_shards(k: int, scale: float):
    """Over rows (shard, asks, id, vector) in the order of shards, candidates before queries.

    A shard's candidates are held as postings; its queries stream past them batch by batch.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for batch in batches:
            for part in _runs(batch):
                here, asks = part.column("shard")[0].as_py(), part.column("asks")[0].as_py()
                if here != shard:
                    shard, parts, index = here, [], None
                rows, lengths, values = whole_rows(part.column("vector"), scale, MOST)
                ids = part.column("id").to_numpy(zero_copy_only=False)[rows]
                if not asks:
                    parts.append((ids, lengths, values))
                    continue
                if index is None:
                    index, parts = _index(parts), []
                yield _answers(index, ids, by_length(lengths, values), k)

    return search


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of one shard and one kind."""
    kind = batch.column("shard").to_numpy(zero_copy_only=False) * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _index(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, Postings]:
    if not parts:
        return {}
    ids, lengths, values = (np.concatenate(p) for p in zip(*parts))
    return {length: Postings(ids[at], matrix) for length, (at, matrix) in by_length(lengths, values).items()}


def _answers(index: dict[int, Postings], ids: np.ndarray, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> pa.RecordBatch:
    columns: list[list[np.ndarray]] = [[], [], []]
    for length, (at, queries) in asked.items():
        for own_id, query in zip(ids[at], queries) if length in index else ():
            found, scores = index[length].search(own_id, query, k)
            for column, part in zip(columns, (np.full(len(found), own_id), found, scores)):
                column.append(part)
    made = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(made, names=["query_id", "vec_id", "score"])


def top_products(
    rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE
) -> DataFrame:
    """(`query_id`, `rank`, `vec_id`, `score`): the k rows with the highest inner product with each query row but
    itself (fewer, if there are fewer), in whole numbers floor(scale * x), ties to the smaller id. Exact.

    Candidates are dealt into shards by a hash of their id; each shard keeps its postings and every query passes
    by every shard once, so what moves is the rows once and the queries once per shard. Shards grow with the
    table up to a bounded size; the k best of each are merged. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; zero vectors do (their products are 0). Vectors of
    different lengths are never compared; empty ones score 0 with each other. Rows that repeat an id are
    candidates each, ask once (with the smallest of their vectors), and never answer their own id. Components
    beyond 2**26 / scale fail, as their products need not fit a long.
    """
    spark = rows.sparkSession
    held = rows.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), floats(rows, vector).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter("id IS NOT NULL AND vector IS NOT NULL")
    n = held.count()
    cores = spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / SHARD_ROWS), min(cores, math.ceil(n / FEW_ROWS)))
    data = held.select(F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    queries = held.filter(F.col("asks") & finite).groupBy("id").agg(F.min("vector").alias("vector")).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "vector"
    )
    dealt = data.union(queries).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(_search_shards(k, scale), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = K, every: int = 50, scale: float = SCALE) -> str:
    """The same in SQL, every pair scored."""
    return f"""
WITH whole AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank
    FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {every} = 0)
WHERE rank <= {k}"""
