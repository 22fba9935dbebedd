"""Chunking, vector and hybrid search over finding text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.operators.keyword_index import SCORE_DIGITS, keyword_search
from watchtide.operators.small_side import measured_bytes
from watchtide.operators.spread import spread
from watchtide.operators.topk import top_k_per
from watchtide.session import materialize

# Chunk size and overlap in tokens; usual rank-fusion constant.
CHUNK_TOKENS, OVERLAP_PERCENT = 300, 20
FUSION_K = 60
BLOCK_BYTES = 32 * 1024 * 1024
SCORE_ROWS = 1024  # rows per scoring step, at most
SCORE_CELLS = 1 << 22  # cells of any matrix of questions, words or rows
FOUND = "query_id long, chunk_id string, score double"


def chunk_fixed(
    documents: DataFrame, *, id_column: str = "doc_id", text: str = "text",
    max_tokens: int = CHUNK_TOKENS, overlap_percent: int = OVERLAP_PERCENT,
) -> DataFrame:
    """(doc_id, chunk_no, chunk, chunk_tokens): runs of whitespace tokens that overlap.

    The last chunk is the first one that reaches the end of the text.
    """
    step = max_tokens - max_tokens * overlap_percent // 100
    tokens = F.array_remove(F.split(F.col(text), r"\s+"), "")
    sized = spread(documents.select(id_column, text)).select(F.col(id_column), tokens.alias("_t")).withColumn("_n", F.size("_t"))
    last = F.greatest(F.ceil((F.col("_n") - max_tokens) / step), F.lit(0)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(F.col("_t"), i * step + 1, max_tokens), " ")
    )
    return (
        sized.filter(F.col("_n") > 0)
        .select(id_column, "_n", F.posexplode(pieces).alias("chunk_no", "chunk"))
        .withColumn("chunk_tokens", F.least(F.lit(max_tokens), F.col("_n") - F.col("chunk_no") * step))
        .drop("_n")
    )


def _blocks(questions: DataFrame, limit: int) -> Iterator[pd.DataFrame]:
    """The questions in driver-sized parts: at most about `limit` bytes, and SCORE_CELLS cells of questions x words
    (a word takes four bytes or more)."""
    questions = materialize(questions)
    size = max(measured_bytes(questions), 1)
    parts = max(-(-size // limit), math.ceil(math.sqrt(size * questions.count() / (4 * SCORE_CELLS))))
    for part in range(parts):
        block = questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toPandas()
        if len(block):
            yield block.sort_values("query_id", ignore_index=True)


def _best_per_question(
    query_ids: np.ndarray, k: int, scorer: Callable[[pa.RecordBatch], np.ndarray], floor: float
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores batches against a block of questions and keeps k rows per question and partition.

    No (question, chunk) pair leaves the task unless it is among the best k seen there.
    """
    step = _step(len(query_ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = np.empty((len(query_ids), 0))
        ids = np.empty((len(query_ids), 0), dtype=object)
        for batch in batches:
            for rows in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                fresh = np.round(scorer(rows), SCORE_DIGITS).T
                names = np.broadcast_to(rows.column("chunk_id").to_numpy(zero_copy_only=False), fresh.shape)
                scores, ids = _keep_best(np.hstack([scores, fresh]), np.hstack([ids, names]), k)
        q, at = np.nonzero(scores > floor)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[q], pa.int64()), pa.array(ids[q, at], pa.string()), pa.array(scores[q, at], pa.float64())],
            names=["query_id", "chunk_id", "score"],
        )

    return scan


def _step(width: int) -> int:
    """Rows per step, so that rows x width stays bounded."""
    return max(1, min(SCORE_ROWS, SCORE_CELLS // max(1, width)))


def _keep_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row: highest score, then smallest id."""
    if scores.shape[1] <= k:
        return scores, ids
    cut = np.partition(scores, -k, axis=1)[:, -k][:, None]
    at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    for q in np.flatnonzero((scores == cut).sum(axis=1) > 1):  # ties at the cut: let the id decide
        near = np.flatnonzero(scores[q] >= cut[q])
        at[q] = near[np.lexsort((ids[q, near].astype(str), -scores[q, near]))][:k]
    return np.take_along_axis(scores, at, axis=1), np.take_along_axis(ids, at, axis=1)


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc("chunk_id")]
    return top_k_per(found, ["query_id"], order, k, salt=F.col("chunk_id"))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _vectors(rows: pa.RecordBatch) -> np.ndarray:
    """Unit vectors of a batch. All embeddings have one length."""
    column = rows.column("embedding")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return unit_rows(flat.reshape(len(column), -1))


def vector_topk(
    chunks: DataFrame, questions: DataFrame, *, k: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The k chunks nearest to each question by cosine: (query_id, chunk_id, score, rank).

    chunks: chunk_id string, embedding; questions: query_id long, embedding. Each
    block of questions is one matrix product per batch of chunks.
    """
    found = None
    for block in _blocks(questions.select("query_id", "embedding"), block_bytes):
        matrix = unit_rows(np.array(block["embedding"].tolist(), dtype=float))

        def cosine(rows: pa.RecordBatch, matrix: np.ndarray = matrix) -> np.ndarray:
            return _vectors(rows) @ matrix.T

        scan = _best_per_question(block["query_id"].to_numpy(), k, cosine, -np.inf)
        part = chunks.select("chunk_id", "embedding").mapInArrow(scan, FOUND)
        found = part if found is None else found.unionByName(part)
    return _merge(_or_empty(found, chunks), k)


def _or_empty(found: DataFrame | None, chunks: DataFrame) -> DataFrame:
    return chunks.sparkSession.createDataFrame([], FOUND) if found is None else found


def hybrid_search(chunks: DataFrame, questions: DataFrame, *, k: int = 10, depth: int = 50) -> DataFrame:
    """Vector and keyword results fused by reciprocal rank: (query_id, chunk_id, score, rank).

    Each list is `depth` long, or k if that is more. Chunks without a vector are found by their words.
    """
    depth = max(depth, k)
    near = vector_topk(chunks.filter("embedding IS NOT NULL"), questions, k=depth)
    lists = [near, keyword_search(chunks, questions, k=depth)]
    votes = lists[0].unionByName(lists[1]).withColumn("_vote", 1.0 / (F.lit(float(FUSION_K)) + F.col("rank")))
    fused = votes.groupBy("query_id", "chunk_id").agg(F.round(F.sum("_vote"), 9).alias("score"))
    return top_k_per(fused, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, salt=F.col("chunk_id"))
