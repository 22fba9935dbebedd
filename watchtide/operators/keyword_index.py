"""Keyword search by BM25 over a table of postings that grows by appended loads.

A load cuts its chunks into segments. A row of the table holds a word's postings in one segment, below the folder
load=…/bucket=… of its load and of a hash of its word, sorted by word; bucket -1 holds one row per segment, about its
chunks. Postings are packed triples of int32 (chunk's number in the segment, count, words of the chunk), since most
words have one or two. Nothing stored depends on the rest of the table, so a load is added without touching others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.operators.small_side import BROADCAST_BYTES, measured_bytes
from watchtide.operators.spread import spread
from watchtide.operators.topk import top_k_per
from watchtide.session import materialize, scratch_path

# Usual BM25 constants; scores are told in millionths.
BM25_K1, BM25_B = 1.2, 0.75
SCORE_DIGITS = 6
MARGIN = 1e-5  # more than rounding can add to a score
BUCKETS = 16
SEGMENTS = -1  # the bucket of segment rows
SEGMENT_WORDS = 1 << 22  # of a segment, about; one longer chunk is a segment of its own
FEW_WORDS = 200  # so few are named in the scan itself
STORED = (
    "word string, segment bigint, holders int, postings binary, "
    "about struct<total: bigint, buckets: int, chunk_ids: array<string>>"
)
FOUND = "query_id bigint, segment bigint, ordinal int, score double"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; no stemming, no stop words."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _cut_segments(load: str, buckets: int, segment_words: int):
    """Postings of the batches of a task, a segment at a time. Chunks are numbered by their ids, so that the smaller
    number is the smaller id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(_coded(batch))
            size += len(held[-1][2])
            if size >= segment_words:
                yield _segment(held, f"{load}/{task}/{number}", buckets)
                held, size, number = [], 0, number + 1
        if held:
            yield _segment(held, f"{load}/{task}/{number}", buckets)

    return cut


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Ids, lengths and words of some chunks; each word is kept once, and a number of four bytes for its places."""
    told = batch.column("words")
    ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(told), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, lengths, pc.list_flatten(told).cast(pa.string()).dictionary_encode()


def _segment(held: list[tuple[np.ndarray, np.ndarray, pa.DictionaryArray]], name: str, buckets: int) -> pa.RecordBatch:
    """Takes `held` empty, and sorts its places (word, chunk) where they lie: a segment's arrays are what a task holds."""
    ids, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.argsort(ids, kind="stable")
    ordinal = np.empty(len(ids), dtype=np.int64)
    ordinal[order] = np.arange(len(ids))
    said = pa.chunked_array([h[2] for h in held], pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
    held.clear()
    dictionary, width = said.chunk(0).dictionary, max(1, len(ids))
    cells = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in said.chunks]).astype(np.int64)
    del said
    cells *= width
    cells += np.repeat(ordinal, lengths)
    cells.sort()
    new = np.ones(len(cells), bool)
    np.not_equal(cells[1:], cells[:-1], out=new[1:])
    first = np.flatnonzero(new)
    cells = cells[first]
    n = len(dictionary)
    starts = np.append(np.searchsorted(cells, np.arange(n) * width), [len(cells)] * 2)  # the segment's row has none
    packed = np.empty((len(cells), 3), "<i4")
    packed[:, 1] = np.diff(first, append=len(new))
    cells %= width
    packed[:, 0] = cells
    packed[:, 2] = lengths[order].astype(np.int32)[cells]
    postings = pa.Array.from_buffers(
        pa.binary(), n + 1, [None, pa.py_buffer((starts * packed.itemsize * 3).astype(np.int32)), pa.py_buffer(packed)]
    )
    about = {"total": int(lengths.sum()), "buckets": buckets, "chunk_ids": ids[order].tolist()}
    kind = pa.struct([("total", pa.int64()), ("buckets", pa.int32()), ("chunk_ids", pa.list_(pa.string()))])
    number = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([dictionary, pa.nulls(1, pa.string())]),
        pa.array(np.full(n + 1, number)), pa.array([*np.diff(starts[:-1]), len(ids)], pa.int32()), postings,
        pa.concat_arrays([pa.nulls(n, kind), pa.array([about], kind)]),
    ], names=["word", "segment", "holders", "postings", "about"])


def add_to_index(
    chunks: DataFrame, path: str, *, load: str, buckets: int = BUCKETS, segment_words: int = SEGMENT_WORDS
) -> None:
    """Adds chunks (chunk_id string, chunk) as one load; repeating a load replaces it.

    A chunk id is in one load, once; chunks without an id are left out. The text is read once and not shuffled, only
    the arrays of postings are, to put the words of a bucket together. All loads take the same number of buckets.
    """
    told = spread(chunks.select(F.col("chunk_id").cast("string"), "chunk")).filter("chunk_id IS NOT NULL").select(
        "chunk_id", words(F.col("chunk")).alias("words")
    )
    rows = told.mapInArrow(_cut_segments(load, buckets, segment_words), STORED)
    placed = rows.withColumn("bucket", F.when(F.col("word").isNull(), F.lit(SEGMENTS)).otherwise(_bucket(buckets)))
    (
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#word", "true")
        .partitionBy("bucket")
        .parquet(f"{path}/load={load}")
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")


def _of_words(rows: DataFrame, vocabulary: DataFrame, buckets: int) -> DataFrame:
    """Postings of the words in `vocabulary`. Few words are named to the scan, which then opens their buckets only
    and skips row groups by bounds and Bloom filters."""
    few = vocabulary.select("word", _bucket(buckets).alias("bucket")).limit(FEW_WORDS + 1).collect()
    rows = rows.filter(F.col("bucket") != SEGMENTS)
    if len(few) <= FEW_WORDS:
        return rows.filter(F.col("bucket").isin({r["bucket"] for r in few}) & F.col("word").isin([r["word"] for r in few]))
    return rows.join(F.broadcast(vocabulary) if measured_bytes(vocabulary) <= BROADCAST_BYTES else vocabulary, "word", "left_semi")


class Segment:
    """The postings of some words in one segment, as (ordinals, shares of a score before rarity)."""

    def __init__(self):
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def add(self, word: str, ordinals: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, mean_length: float) -> None:
        share = tfs * (BM25_K1 + 1) / (tfs + BM25_K1 * (1 - BM25_B + BM25_B * lengths / mean_length))
        self.lists[word] = ordinals, share
        self.size = max(self.size, int(ordinals[-1]) + 1)

    def search(self, asked: Sequence[str], idfs: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, scores) of the k best chunks, best first, ties to smaller ordinals.

        A word's bound is the most it can add to a score. The strongest words, until k chunks hold them, give a
        score that k chunks reach. The weakest words whose bounds together stay below it find no chunk by
        themselves: only the lists of the others are added up, and the chunks these find are looked up in the weak
        ones, strongest first, as long as they can still reach that score.
        """
        terms = [(idf * self.lists[w][1].max(), idf, *self.lists[w]) for w, idf in zip(asked, idfs) if w in self.lists]
        terms.sort(key=lambda t: -t[0])
        bounds = np.array([t[0] for t in terms])
        below = np.cumsum(bounds[::-1])[::-1]  # what a term and all weaker ones can add
        least = self._least(terms, k) - MARGIN
        essential = int(np.count_nonzero(below >= least))
        scores = self._sums(terms[:essential])
        left = below[essential] if essential < len(terms) else 0.0
        rows = np.flatnonzero((scores > 0) & (scores + left >= least))
        scores = scores[rows]
        for bound, idf, ordinals, share in terms[essential:]:
            at = np.minimum(np.searchsorted(ordinals, rows), len(ordinals) - 1)
            scores += np.where(ordinals[at] == rows, idf * share[at], 0.0)
            left -= bound
            stay = scores + left >= least
            rows, scores = rows[stay], scores[stay]
        scores = np.round(scores, SCORE_DIGITS)
        best = np.lexsort((rows, -scores))[:k]
        best = best[scores[best] > 0]
        return rows[best], scores[best]

    def _least(self, terms: list, k: int) -> float:
        held = np.cumsum([len(t[2]) for t in terms])
        strong = int(np.searchsorted(held, k)) + 1
        tried = self._sums(terms[:strong])
        tried = tried[tried > 0]
        return float(np.partition(tried, -k)[-k]) if len(tried) >= k else 0.0

    def _sums(self, terms: list) -> np.ndarray:
        sums = np.zeros(self.size)
        for _bound, idf, ordinals, share in terms:
            sums[ordinals] += idf * share
        return sums


def _search_segments(k: int, mean_length: float):
    """Over rows (segment, query_id, word, postings, asked, idfs) in the order of segments, postings before
    questions. One segment's postings are held at a time; the questions stream past them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, Segment()
        for batch in batches:
            found = [[], [], [], []]
            columns = [batch.column(c).to_pylist() for c in ("segment", "query_id", "word", "asked", "idfs")]
            for i, (segment, query, word, asked, idfs) in enumerate(zip(*columns)):
                if segment != held:
                    held, own = segment, Segment()
                if query is None:
                    triples = np.frombuffer(batch.column("postings")[i].as_buffer(), "<i4").reshape(-1, 3).T.copy()
                    own.add(word, *triples, mean_length)
                    continue
                at, scores = own.search(asked, idfs, k)
                for column, part in zip(found, ([query] * len(at), [segment] * len(at), at, scores)):
                    column.extend(part)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(found, kinds)], names=["query_id", "segment", "ordinal", "score"]
            )

    return search


def search_index(spark: SparkSession, path: str, questions: DataFrame, *, k: int = 10) -> DataFrame:
    """The k best chunks per question by BM25 over all loads: (query_id, chunk_id, score, rank). Exact.

    questions: query_id long, text. However many there are, the postings of their words are read twice (first only
    how many chunks hold a word) and moved once, to the task of their segment; a question passes by each segment.
    Questions without a known word, and chunks with a score that rounds to 0, give no row.
    """
    rows = spark.read.schema(STORED + ", load string, bucket int").parquet(path)
    cut = rows.filter(F.col("bucket") == SEGMENTS)
    segments, chunks, total, buckets, least = cut.agg(
        F.count(F.lit(1)), F.sum("holders"), F.sum("about.total"), F.max("about.buckets"), F.min("about.buckets")
    ).first()
    if buckets != least:
        raise ValueError("the loads of an index take the same number of buckets")
    if not total:
        return spark.createDataFrame([], "query_id bigint, chunk_id string, score double, rank int")
    said = questions.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    asked = materialize(said.filter("query_id IS NOT NULL").distinct())
    postings = _of_words(rows, asked.select("word").distinct(), buckets)
    holders = postings.groupBy("word").agg(F.sum("holders").alias("holders"))
    idf = F.log(1 + (F.lit(chunks) - F.col("holders") + 0.5) / (F.col("holders") + 0.5))
    told = asked.join(holders, "word").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("word", idf.alias("idf")))).alias("_t"))
    streamed = postings.select(
        "segment", F.lit(None).cast("bigint").alias("query_id"), "word", "postings",
        F.lit(None).cast("array<string>").alias("asked"), F.lit(None).cast("array<double>").alias("idfs"),
    ).unionByName(cut.select("segment").crossJoin(told).select(
        "segment", "query_id", F.col("_t.word").alias("asked"), F.col("_t.idf").alias("idfs"),
    ), allowMissingColumns=True)
    dealt = streamed.repartition(segments, "segment").sortWithinPartitions("segment", F.col("query_id").asc_nulls_first())
    found = dealt.mapInArrow(_search_segments(k, total / chunks), FOUND)
    # The k best scores with all their ties; then their ids, which decide between ties.
    best = top_k_per(found, ["query_id"], [F.desc("score")], k, salt=F.struct("segment", "ordinal"), ties=True)
    best = materialize(best.select("query_id", "segment", "ordinal", "score"))
    names = cut.select("segment", "about.chunk_ids").join(F.broadcast(best) if measured_bytes(best) <= BROADCAST_BYTES else best, "segment")
    named = names.select("query_id", F.element_at("chunk_ids", F.col("ordinal") + 1).alias("chunk_id"), "score")
    return top_k_per(named, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, salt=F.col("chunk_id"))


def keyword_search(chunks: DataFrame, questions: DataFrame, *, k: int = 10) -> DataFrame:
    """The k best chunks per question by BM25, without a standing index: (query_id, chunk_id, score, rank).

    chunks: chunk_id string, chunk; questions: query_id long, text. An index in the shared folder serves this search.
    """
    spark = chunks.sparkSession
    path = scratch_path(spark, "postings")
    add_to_index(chunks, path, load="once")
    return search_index(spark, path, questions, k=k)
