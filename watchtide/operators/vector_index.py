"""Approximate vector search: an inverted file of cells with residual product codes, and exact re-ranking.

Layout: <path>/rows holds (chunk_id, cell, code, embedding) sorted by cell; <path>/cells the centres and their rows,
<path>/books the codebooks, <path>/meta one row with the number of cells to probe. A search reads the codes of the
probed cells, 4 components a byte, and the vectors of its short list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.operators.retrieval import SCORE_DIGITS, unit_rows, vector_topk
from watchtide.operators.small_side import BROADCAST_BYTES, join_checked, measured_bytes
from watchtide.operators.topk import top_k_per
from watchtide.session import materialize

CELLS_PER_ROOT = 4  # cells are so many times the root of the rows
SAMPLE_PER_CELL = 32  # rows that centres are fitted on, about
MOST_CENTRE_BYTES = 256 << 20  # centres go to every task; this bounds the cells
PART = 4  # components per byte of a code
ENTRIES = 256
CODE_SAMPLE = 8_192  # rows that codebooks are fitted on, about
TRIED = 64  # rows asked to choose the number of probes, about
RECALL = 0.96  # wanted of the probed cells, over the rows tried
SHORT_LIST = 20  # candidates re-ranked exactly, per result asked for
HELD_FLOATS = 1 << 23  # decoded floats of a cell that a task holds
FEW_CELLS = 1_000
ROUNDS = 8  # of k-means
ROWS = "chunk_id string, cell int, code binary, embedding array<float>"


def _usable(vector: Column) -> Column:
    """False for null, empty and zero vectors and those with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each point, in steps of bounded size."""
    norms, out = (centres * centres).sum(axis=1), np.empty(len(points), dtype=np.int64)
    step = max(1, (1 << 22) // max(1, len(centres)))
    for at in range(0, len(points), step):
        out[at:at + step] = (norms - 2.0 * points[at:at + step] @ centres.T).argmin(axis=1)
    return out


def _fit(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most `k` groups of a bounded number of points (Lloyd's rounds)."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centres = points[rng.choice(len(points), k, replace=False)]
    for _round in range(ROUNDS):
        own = _nearest(points, centres)
        sizes = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=column, minlength=k) for column in points.T], axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Codebook:
    """Residual codes: each run of PART components by the nearest of at most ENTRIES entries."""

    books: tuple[np.ndarray, ...]

    @classmethod
    def fit(cls, residuals: np.ndarray, seed: int) -> Codebook:
        rng = np.random.default_rng(seed)
        return cls(tuple(_fit(residuals[:, at:at + PART], ENTRIES, rng) for at in range(0, residuals.shape[1], PART)))

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        codes = [_nearest(residuals[:, PART * p:PART * (p + 1)], book) for p, book in enumerate(self.books)]
        return np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)


def _sample(rows: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About `most` of the n rows, by a hash of their ids: the same in every run, and drawn without a sort."""
    share = min(1.0, most / max(1, n))
    return rows.filter(F.xxhash64("chunk_id", F.lit(salt)) <= F.lit(2**63 - 1 if share == 1 else int(-(2**63) + share * 2**64)))


def _fit_centres(rows: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    unit = _sample(rows, n, SAMPLE_PER_CELL * cells, "centres").select(
        array_to_vector(F.transform("embedding", lambda x: x.cast("double") / norm)).alias("_v")
    )
    model = KMeans(k=cells, seed=seed, featuresCol="_v", initMode="random", maxIter=ROUNDS).fit(materialize(unit))
    return np.array(model.clusterCenters())


def build_vector_index(chunks: DataFrame, path: str, *, cells: int | None = None, seed: int = 42) -> None:
    """Writes the index of chunks (chunk_id string, embedding).

    Cells grow with the root of the rows (`cells` sets their number). Centres and codebooks are fitted on samples of
    about bounded size, by hashes of ids; every row is assigned and coded. The number of cells to probe is the least that
    finds RECALL of the true neighbours of TRIED rows, searched exactly. Rows that have no usable vector (null,
    empty, zero, non-finite) or one of another length than the shortest usable, or no id, are not indexed.
    """
    spark = chunks.sparkSession
    usable = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    usable = usable.filter(F.col("chunk_id").isNotNull() & _usable(F.col("embedding")))
    dims = usable.agg(F.min(F.size("embedding"))).first()[0]
    if dims is None:
        spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(0, 0)], "probes int, short_list int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return
    usable = usable.filter(F.size("embedding") == dims)
    n = usable.count()
    most = max(1, MOST_CENTRE_BYTES // (8 * dims))
    cells = max(1, min(n, most, cells or round(CELLS_PER_ROOT * math.sqrt(n))))
    centres = _fit_centres(usable, n, cells, seed)
    tried = unit_rows(np.array([r["embedding"] for r in _sample(usable, n, CODE_SAMPLE, "codes").collect()], dtype=np.float64).reshape(-1, dims))
    book = Codebook.fit(tried - centres[_nearest(tried, centres)], seed)
    shared = spark.sparkContext.broadcast((centres, book))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, book = shared.value
        for batch in batches:
            vectors = _unit(batch.column("embedding"))
            own = _nearest(vectors, centres) if len(vectors) else np.zeros(0, np.int64)
            codes = book.encode(vectors - centres[own]) if len(vectors) else np.zeros((0, len(book.books)), np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column("chunk_id"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                batch.column("embedding"),
            ], names=["chunk_id", "cell", "code", "embedding"])

    coded = usable.mapInArrow(code, ROWS)
    coded.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    sizes = dict(rows.groupBy("cell").count().collect())  # one row per cell
    told = [(i, sizes.get(i, 0), [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(told, "cell int, n bigint, centre array<double>").write.mode("overwrite").parquet(f"{path}/cells")
    entries = [(p, [[float(x) for x in e] for e in b]) for p, b in enumerate(book.books)]
    spark.createDataFrame(entries, "part int, entries array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
    probes = _needed_probes(usable, rows, n, centres)
    spark.createDataFrame([(probes, SHORT_LIST)], "probes int, short_list int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def _needed_probes(usable: DataFrame, rows: DataFrame, n: int, centres: np.ndarray, k: int = 10) -> int:
    """The least number of nearest cells that hold RECALL of the k nearest neighbours of TRIED rows."""
    tried = _sample(usable, n, TRIED, "tried").collect()
    if not tried:
        return len(centres)
    asked = usable.sparkSession.createDataFrame(
        [(i, r["embedding"], r["chunk_id"]) for i, r in enumerate(tried)], "query_id bigint, embedding array<float>, own string"
    )
    exact = vector_topk(usable, asked.select("query_id", "embedding"), k=k + 1).select("query_id", "chunk_id")
    placed = rows.select("chunk_id", "cell").join(F.broadcast(exact), "chunk_id").collect()  # TRIED x (k + 1) rows
    vectors = unit_rows(np.array([r["embedding"] for r in tried], dtype=np.float64))
    place = np.argsort(np.argsort(((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1, kind="stable"), axis=1)
    needed = sorted(int(place[r["query_id"], r["cell"]]) for r in placed if r["chunk_id"] != tried[r["query_id"]]["chunk_id"])
    return needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)))] + 1 if needed else 1


@dataclass(frozen=True)
class VectorIndex:
    """What a search must hold of an index: centres with their numbers of rows, codebooks, and how far to look."""

    path: str
    centres: np.ndarray
    sizes: np.ndarray
    book: Codebook
    probes: int
    short_list: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex | None:
        """The index at `path`; None if it has no rows."""
        probes, short_list = spark.read.parquet(f"{path}/meta").first()
        if not probes:
            return None
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        books = spark.read.parquet(f"{path}/books").orderBy("part").collect()
        return cls(
            path, np.array([c["centre"] for c in cells]), np.array([c["n"] for c in cells]),
            Codebook(tuple(np.array(b["entries"]) for b in books)), probes, short_list,
        )

    @property
    def slices(self) -> np.ndarray:
        """How many tasks share a cell, so that none holds more than HELD_FLOATS; copies may fill one cell."""
        return np.maximum(1, -(-self.sizes * self.centres.shape[1] // HELD_FLOATS)).astype(np.int64)


def _probed(asked: DataFrame, index: VectorIndex, probes: int, first_rows: int | None = None) -> DataFrame:
    """(cell, slice, query_id, least, embedding): each question in each slice of its nearest cells; with `first_rows`
    only of those, nearest first, that it takes to hold so many rows."""
    shared = asked.sparkSession.sparkContext.broadcast((index.centres, index.slices, index.sizes))
    probes = max(1, min(probes, len(index.centres)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, slices, sizes = shared.value
        norms = (centres * centres).sum(axis=1)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                away = norms - 2.0 * _unit(part.column("embedding")) @ centres.T
                near = np.argpartition(away, probes - 1, axis=1)[:, :probes]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, axis=1), axis=1), axis=1)
                before = np.cumsum(sizes[near], axis=1) - sizes[near]
                question, at = np.nonzero(before < (np.inf if first_rows is None else first_rows))
                cell = near[question, at]
                copies = slices[cell]
                number = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                taken = part.take(pa.array(np.repeat(question, copies)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(cell, copies), pa.int32()), pa.array(number, pa.int32()),
                    *(taken.column(c) for c in ("query_id", "least", "embedding")),
                ], names=["cell", "slice", "query_id", "least", "embedding"])

    told = asked.select("query_id", "least", "embedding")
    return told.mapInArrow(probe, "cell int, slice int, query_id bigint, least double, embedding array<float>")


def _scan_cells(short: int, shared):
    """Over rows (cell, slice, chunk_id, code, query_id, least, embedding) in the order of cells, codes before questions:
    the best `short` rows of a cell's slice for each question, but none below its `least`. A slice's codes are held; its
    questions stream past them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, book = shared.value
        here, ids, codes, decoded = None, [], [], None
        for batch in batches:
            kind = pc.is_valid(batch.column("query_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.stack([batch.column(c).to_numpy() for c in ("cell", "slice")] + [kind], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a):
                own = (part.column("cell")[0].as_py(), part.column("slice")[0].as_py())
                if own != here:
                    here, ids, codes, decoded = own, [], [], None
                if part.column("query_id").null_count:
                    ids.append(part.column("chunk_id").to_numpy(zero_copy_only=False))
                    codes.append(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1))
                    continue
                if decoded is None and ids:
                    ids, decoded = [np.concatenate(ids)], centres[own[0]] + book.decode(np.concatenate(codes))
                if decoded is None:  # nothing in this slice
                    continue
                scores = _unit(part.column("embedding")) @ decoded.T
                kept = min(short, scores.shape[1])
                at = np.argpartition(-scores, kept - 1, axis=1)[:, :kept]
                best = np.take_along_axis(scores, at, axis=1)
                least = pc.fill_null(part.column("least"), -np.inf).to_numpy(zero_copy_only=False)
                question, place = np.nonzero(best >= least[:, None])
                yield pa.RecordBatch.from_arrays([
                    pa.array(part.column("query_id").to_numpy()[question], pa.int64()),
                    pa.array(np.full(len(question), own[0]), pa.int32()), pa.array(ids[0][at[question, place]], pa.string()),
                    pa.array(best[question, place], pa.float64()),
                ], names=["query_id", "cell", "chunk_id", "near"])

    return scan


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.round((_unit(a) * _unit(b)).sum(axis=1), SCORE_DIGITS) if len(a) else [], pa.float64())


def vector_topk_approx(
    spark: SparkSession, path: str, questions: DataFrame, *, k: int = 10, probes: int | None = None, short_list: int | None = None,
) -> DataFrame:
    """About the k chunks nearest to each question by cosine: (query_id, chunk_id, score, rank); scores are exact.

    questions: query_id long, embedding. Each question looks into its nearest cells (`probes`; by default as many as
    the index found necessary), ranks their rows by codes, and re-ranks `short_list` x k of them by their vectors.
    All questions share one reading of the codes. A cell of many rows, such as copies, is shared by several tasks.
    Questions without a usable vector of the index's length get no answer.
    """
    index = VectorIndex.load(spark, path)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, chunk_id string, score double, rank int")
    rows, asked = spark.read.schema(ROWS).parquet(f"{path}/rows"), _asked(questions, index)
    probes, short = probes or index.probes, k * (short_list or index.short_list)
    order = [F.desc("near"), F.asc("chunk_id")]

    def listed_from(probed: DataFrame) -> DataFrame:
        return top_k_per(_near_rows(rows, probed, index, short), ["query_id"], order, short, salt=F.col("chunk_id"))

    # The nearest cells give each question a score that its list reaches, so that few rows leave the other cells.
    opening = listed_from(_probed(asked, index, probes, first_rows=2 * short))
    least = materialize(opening.filter(F.col("rank") == short).select("query_id", F.col("near").alias("least")))
    bounded = join_checked(asked.drop("least"), least, ["query_id"], "left")
    best = materialize(listed_from(_probed(bounded, index, probes)).select("query_id", "cell", "chunk_id"))
    listed = _of_cells(rows, best).select("cell", "chunk_id", F.col("embedding").alias("_own"))
    listed = listed.join(F.broadcast(best) if measured_bytes(best) <= BROADCAST_BYTES else best, ["cell", "chunk_id"])
    scored = join_checked(listed, asked, ["query_id"], "inner").select("query_id", "chunk_id", _cosine("_own", "embedding").alias("score"))
    return top_k_per(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, salt=F.col("chunk_id"))


def _near_rows(rows: DataFrame, probed: DataFrame, index: VectorIndex, short: int) -> DataFrame:
    """(query_id, cell, chunk_id, near): rows of the probed cells with their scores by codes, the best of each cell."""
    slice_of = F.lit(0)
    if index.slices.max() > 1:
        slice_of = F.pmod(F.xxhash64("chunk_id"), F.element_at(F.lit(index.slices.tolist()), F.col("cell") + 1)).cast("int")
    codes = _of_cells(rows, probed).select("cell", slice_of.alias("slice"), "chunk_id", "code")
    streamed = codes.unionByName(probed, allowMissingColumns=True)
    dealt = streamed.repartition("cell", "slice").sortWithinPartitions("cell", "slice", F.col("query_id").asc_nulls_first())
    shared = rows.sparkSession.sparkContext.broadcast((index.centres, index.book))
    return dealt.mapInArrow(_scan_cells(short, shared), "query_id bigint, cell int, chunk_id string, near double")


def _asked(questions: DataFrame, index: VectorIndex) -> DataFrame:
    told = questions.select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    told = told.filter(F.col("query_id").isNotNull() & (F.size("embedding") == index.centres.shape[1]) & _usable(F.col("embedding")))
    return materialize(told.withColumn("least", F.lit(None).cast("double")))


def _of_cells(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of the cells in `named`; few cells are named to the scan, which skips the row groups of others."""
    cells = named.select("cell").distinct()
    few = [r["cell"] for r in cells.limit(FEW_CELLS + 1).collect()]
    return rows.filter(F.col("cell").isin(few)) if len(few) <= FEW_CELLS else rows.join(F.broadcast(cells), "cell", "left_semi")


def rows_read(spark: SparkSession, path: str, questions: DataFrame, *, probes: int | None = None) -> DataFrame:
    """(query_id, share_read): the share of all codes that a question looks at."""
    index = VectorIndex.load(spark, path)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, share_read double")
    cells = spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.sizes)], "cell int, _n bigint")
    looked = _probed(_asked(questions, index), index, probes or index.probes).filter("slice = 0").join(F.broadcast(cells), "cell")
    return looked.groupBy("query_id").agg((F.sum("_n") / F.lit(int(index.sizes.sum()))).alias("share_read"))


def recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found, per question."""
    hit = approx.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        (F.count("_hit") / F.count(F.lit(1))).alias("recall")
    )
