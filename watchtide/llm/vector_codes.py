"""Vector compression: product codes over whole numbers, with exact distances from limb-split matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.whole_vectors import by_length, floats, whole_rows
from watchtide.operators.small_side import join_checked
from watchtide.session import scratch_path

SCALE = 4096.0
PARTS = 8  # of a vector
ENTRIES = 16  # of a codebook
ROUNDS = 6
MANTISSA = 53  # bits below which a float64 holds every integer
MOST = 1 << 26  # largest whole component either way: squared distances of 256 components stay below 2**63
STEP = 1 << 15  # vectors assigned at once


def _limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs, lowest first: x = sum of limb[i] * 2**(bits * i). The last limb carries the sign."""
    out = []
    while len(x) and np.abs(x).max() >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of `x` with the rows of `y`, both int64, exact while they fit into int64.

    Limbs are as wide as lets a float64 matrix product of two of them stay below 2**53, so BLAS adds them without
    rounding; the products are shifted and added in int64.
    """
    bits = (MANTISSA - 1 - max(1, x.shape[1]).bit_length()) // 2
    total = np.zeros((len(x), len(y)), dtype=np.int64)
    for i, a in enumerate(_limbs(x, bits)):
        for j, b in enumerate(_limbs(y, bits)):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each point, ties to the lower index."""
    apart = exact_products(points, entries)
    apart *= -2
    apart += (entries * entries).sum(axis=1)
    first = apart.argmin(axis=1)
    return first, apart[np.arange(len(points)), first] + (points * points).sum(axis=1)


@dataclass(frozen=True)
class Codebooks:
    """parts x entries x width whole numbers; `entries` may be fewer than asked for where rows are few."""

    books: np.ndarray

    @property
    def dims(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors): the entry of each part of each vector, and its squared distances summed over parts."""
        cut = vectors.reshape(len(vectors), len(self.books), -1)
        codes, errors = np.empty(cut.shape[:2], dtype=np.int64), np.zeros(len(vectors), dtype=np.int64)
        for p, book in enumerate(self.books):
            codes[:, p], apart = nearest_entries(np.ascontiguousarray(cut[:, p]), book)
            errors += apart
        return codes, errors

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _kept(rows: DataFrame, vector: str, columns: list[str]) -> DataFrame:
    return rows.select(*columns, floats(rows, vector).alias("vector"))


def first_codebooks(rows: DataFrame, id_col: str, vector: str, parts: int, entries: int, scale: float) -> Codebooks | None:
    """The parts of the `entries` smallest ids whose vectors can be cut; None if there is no such row.

    The length of the smallest such id's vector is the length that is coded.
    """
    held = _kept(rows, vector, [F.col(f"`{id_col}`").alias("id")]).filter(
        F.col("id").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0)
        & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    )
    first = held.orderBy("id", "vector").select(F.size("vector")).first()
    if first is None:
        return None
    smallest = held.filter(F.size("vector") == first[0]).orderBy("id", "vector").limit(entries).collect()
    whole = np.floor(scale * np.array([r["vector"] for r in smallest], dtype=np.float64))
    if np.abs(whole).max() > MOST:
        raise ValueError(f"a component times {scale} is beyond {MOST}")
    return Codebooks(whole.astype(np.int64).reshape(len(smallest), parts, -1).transpose(1, 0, 2).copy())


def _batches(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(part of a batch, its usable rows, those of `dims` components, their matrix) in bounded steps."""
    for batch in batches:
        for part in (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP)):
            rows, lengths, values = whole_rows(part.column("vector"), scale, MOST)
            at, vectors = by_length(lengths, values).get(dims, (np.zeros(0, np.int64), np.zeros((0, max(0, dims)), np.int64)))
            yield part, rows, rows[at], vectors


def next_codebooks(rows: DataFrame, vector: str, now: Codebooks, scale: float) -> Codebooks:
    """Each entry replaced by the floored mean of the parts nearest to it; entries nearest to none stay.

    A task sends one row per entry it used, with the sums of that entry's parts, so what is shuffled and what
    the driver gets depends on the codebooks' size only.
    """
    parts, entries, width = now.books.shape

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for _part, _usable, _rows, vectors in _batches(batches, now.dims, scale):
            codes, _errors = now.assign(vectors)
            for p in range(parts):
                own = vectors[:, p * width:(p + 1) * width]
                order = codes[:, p].argsort(kind="stable")
                met, starts, sizes = np.unique(codes[order, p], return_index=True, return_counts=True)
                if len(met):
                    sums[p * entries + met] += np.add.reduceat(own[order], starts, axis=0)
                    counts[p * entries + met] += sizes
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int64()), pa.array(counts[met], pa.int64()), pa.array(list(sums[met]), pa.list_(pa.int64()))],
            names=["place", "n", "sums"],
        )

    told = _kept(rows, vector, []).mapInArrow(tally, "place bigint, n bigint, sums array<bigint>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    books = now.books.reshape(parts * entries, width).copy()
    for place, n, *sums in told.groupBy("place").agg(F.sum("n"), *wide).collect():  # parts x entries rows
        books[place] = [int(s) // n for s in sums]
    return Codebooks(books.reshape(now.books.shape))


def _coder(books: Codebooks | None, scale: float, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, finite, rows, vectors in _batches(batches, books.dims if books else -1, scale):
            text, error = np.full((2, part.num_rows), None, dtype=object)
            if len(rows):
                codes, errors = books.assign(vectors)
                text[rows] = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                error[rows] = errors.tolist()
            kept = pa.array(finite)
            made = [pa.array(text, pa.string()).take(kept), pa.array(error, pa.int64()).take(kept)]
            yield pa.RecordBatch.from_arrays([part.column(n).take(kept) for n in names] + made, names=[*names, "code", "error"])

    return code


def compress(
    rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """((`vec_id`, `code`, `error`, `label_error`, `codebooks_sha256`), codebooks) of vectors cut into equal parts.

    Components are floor(scale * x). Codebooks start from the smallest ids (equal ids: the smaller vector first)
    and take `rounds` rounds of exact means. All rows shape them. Rows whose vector is null or holds null or
    non-finite components are left out. A vector of another length than that coded (that of the smallest id
    whose vector can be cut into the parts), and a table without any such vector, give null code and error, and
    take no part in the means. Rows without an id are coded like any other and never start a codebook; rows that
    repeat an id are rows of their own. `label_error` sums the errors of equal labels, null labels together (null
    if none of them is coded). Components beyond 2**26 / scale, which leave no room for exact distances, fail.
    Other columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    held = rows.select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")
    )
    books = first_codebooks(held, "vec_id", "vector", parts, entries, scale)
    for _round in range(rounds if books else 0):
        books = next_codebooks(held, "vector", books, scale)
    coder = _coder(books, scale, ["vec_id", "label"])
    kind = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error bigint"
    path = scratch_path(spark, "codes")
    _kept(held, "vector", ["vec_id", "label"]).mapInArrow(coder, schema).write.parquet(path)
    coded = spark.read.parquet(path).withColumn("_label", F.struct("label"))  # as structs, null labels are equal
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    found = join_checked(coded, sums, ["_label"], "left").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    )
    return found, books


def decompress(codes: DataFrame, books: Codebooks, *, scale: float = SCALE, code: str = "code") -> DataFrame:
    """`codes` with `vector`: the entries that a code names, divided by the scale; null where the code is null."""
    flat = F.lit([[(v / scale) for v in entry] for book in books.books.tolist() for entry in book])
    entries = books.books.shape[1]
    at = [F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int") + 1 + p * entries for p in range(len(books.books))]
    return codes.withColumn("vector", F.when(F.col(code).isNotNull(), F.concat(*(F.element_at(flat, a) for a in at))))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> str:
    """The same in SQL: every round as two steps, distances to all entries and floored means."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cut AS MATERIALIZED (SELECT n, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x
    FROM kept, range({parts}) r(p))""",
        f"b0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM cut WHERE n <= {entries})"]
    nearest = """SELECT n, p, min(struct_pack(d := d, e := e)) AS best FROM (SELECT n, cut.p, e,
    list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut JOIN b{} b ON cut.p = b.p) GROUP BY ALL"""
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        steps.append(f"""m{i} AS (SELECT p, e, list(c ORDER BY pos) AS c FROM (SELECT p, e, pos,
    (total - ((total % size) + size) % size) // size AS c FROM (SELECT a.p, a.best.e AS e, pos, sum(x[pos])::BIGINT AS total, count(*) AS size
    FROM a{i} a JOIN cut USING (n, p), unnest(range(1, len(x) + 1)) u(pos) GROUP BY ALL)) GROUP BY ALL)""")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e))")
    steps.append(f"a{rounds} AS ({nearest.format(rounds)})")
    steps.append(f"""coded AS (SELECT n, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
    FROM a{rounds} GROUP BY n)""")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), digest"""
