"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, checked pairs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.components import connected_components
from watchtide.llm.pair_blocks import pair_cells, star_links
from watchtide.llm.vectors import matrix, usable
from watchtide.session import materialize

SIMILARITY = 0.9
TABLES = 6  # at least; as many as MISSED needs
MISSED = 1e-4  # share of the pairs at the wanted similarity that meet in no bucket
TRIAL_PAIRS = 4000  # simulated to find the number of tables; fewer where vectors are long
PROBES = 2  # buckets of a vector per table, its own included
BUCKET_ROWS = 512  # wanted on average; more hashes are joined into a key as the input grows
BLOCK_ROWS = 1024
SEED = 42


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform over the rows of `x` (a power of two wide)."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            x = x.reshape(n, -1, 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
            h *= 2
        x = x.reshape(n, d) / math.sqrt(d)
    return x


def bucket_keys(x: np.ndarray, tables: int, parts: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Keys (rows, tables, probes) of unit rows, own bucket first.

    A hash is the largest coordinate after a rotation, with its sign; a key joins `parts` hashes. Probes replace
    the hash that is least certain (smallest gap to its second-largest coordinate) by its second choice, then the
    next one.
    """
    n, d = x.shape
    wide = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    rng = np.random.default_rng(seed)
    keys = np.zeros((n, tables, probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = [], [], []
        for _part in range(parts):
            turned = rotate(padded, rng.choice([-1.0, 1.0], size=(3, wide)))
            size = np.abs(turned)
            first = size.argmax(axis=1)
            top = size[rows, first]
            size[rows, first] = -1
            other = size.argmax(axis=1)
            code = lambda at: 2 * at + (turned[rows, at] < 0)  # noqa: B023, E731
            best.append(code(first)), second.append(code(other)), gap.append(top - size[rows, other])
        best, second, gap = np.array(best), np.array(second), np.array(gap)
        doubtful = np.argsort(gap, axis=0, kind="stable")
        for p in range(probes):
            chosen = best.copy()
            if p:
                part = doubtful[(p - 1) % parts]
                chosen[part, rows] = second[part, rows]
            key = np.full(n, t, np.int64)
            for c in chosen:
                key = key * (2 * wide) + c
            keys[:, t, p] = key
    return keys


def hashes_per_key(n: int, wide: int) -> int:
    """Hashes joined into a key, so that buckets of n rows hold about BUCKET_ROWS."""
    return max(1, min(int(50 // math.log2(2 * wide)), round(math.log(max(2, n / BUCKET_ROWS)) / math.log(2 * wide))))


@lru_cache(maxsize=64)
def tables_needed(d: int, similarity: float, parts: int, probes: int) -> int:
    """Tables after which at most MISSED of the pairs with this cosine have met nowhere, by simulation of the keys."""
    rng = np.random.default_rng(SEED)
    x, other = rng.normal(size=(2, max(500, min(TRIAL_PAIRS, (1 << 20) // d)), d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(other, axis=1, keepdims=True)
    y = similarity * x + math.sqrt(max(0.0, 1 - similarity**2)) * other / np.maximum(size, 1e-12)
    a, b = (bucket_keys(v / np.linalg.norm(v, axis=1, keepdims=True), 4, parts, probes) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean()
    return 1 if met >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log(1 - max(met, 1e-3)))


def _compare(similarity: float):
    """Links of a cell's rows: per row the vectors it is linked to that no earlier shared bucket counts, and as few
    links as connect what is linked here."""

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        x = matrix(cell["vector"])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        keys, own = np.array(cell["keys"].tolist(), np.int64), int(cell["key"].iloc[0])
        copies, ids = cell["copies"].to_numpy(), cell["vec_id"].to_numpy()
        block, a, b = cell["block"].to_numpy(), cell["cell_a"].iloc[0], cell["cell_b"].iloc[0]
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        links = np.zeros(len(cell), np.int64)
        ends_i, ends_j = [], []
        for at in range(0, len(left), 256):
            some = left[at:at + 256]
            i, j = np.nonzero(x[some] @ x[right].T >= similarity)
            i, j = some[i], right[j]
            keep = i < j if a == b else i != j
            i, j = i[keep], j[keep]
            ends_i.append(i), ends_j.append(j)
            first = np.ones(len(i), bool)  # is this the first bucket the two share?
            for p in range(keys.shape[1]):
                for q in range(keys.shape[1]):
                    first &= ~((keys[i, p] == keys[j, q]) & (keys[i, p] < own))
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
        i, j = star_links(len(cell), np.concatenate(ends_i or [[]]).astype(int), np.concatenate(ends_j or [[]]).astype(int))
        linked = np.flatnonzero(links)
        return pd.DataFrame({
            "a": np.concatenate([ids[linked], ids[i]]), "b": np.concatenate([ids[linked], ids[j]]),
            "links": np.concatenate([links[linked], np.zeros(len(i), np.int64)]),
        })

    return compare


def similar_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY,
    tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """(`vec_id`, `n_links`, `component_id`, `kept`) of every row: how many other vectors it is linked to by a cosine
    of at least `similarity` (double precision), the smallest id it is connected to, and whether that is its own.

    Pairs meet in buckets and are then checked; vectors of different lengths never link. Null, empty and zero
    vectors and vectors with null or non-finite components have no links and are their own component. Equal
    vectors are compared once and counted each; repeated rows link as copies do. A row without an id has a null
    component and counts as a link of others. A full bucket is compared in blocks, in as many tasks as needed;
    tasks give counts and connecting links, never all pairs. Larger inputs join more hashes into a key, and get as
    many tables more (`tables` is the least) as keep the share of missed pairs at `similarity` at about MISSED,
    by simulation for the number of dimensions; the tests measure it.
    """
    held = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).withColumn("ok", usable("vector"))
    groups = held.filter("ok").groupBy("vector").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    groups = materialize(groups.withColumn("vec_id", F.xxhash64("vector")))  # 64 bits name a distinct vector
    counted = groups.agg(F.count("*"), F.max(F.size("vector"))).first()
    n, d = counted[0], counted[1] or 2
    wide = max(2, 1 << (d - 1).bit_length())
    parts = hashes_per_key(n, wide)
    tables = max(tables, tables_needed(d, similarity, parts, probes))

    def deal(batches):
        for batch in batches:
            sizes = batch["vector"].map(len)
            for _size, same in batch.groupby(sizes):
                x = matrix(same["vector"])
                keys = bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, parts, probes).reshape(len(same), -1)
                times = keys.shape[1]
                yield pd.DataFrame({
                    "vec_id": np.repeat(same["vec_id"].to_numpy(), times), "vector": np.repeat(same["vector"].to_numpy(), times),
                    "copies": np.repeat(same["copies"].to_numpy(), times), "size": _size,
                    "keys": [k for k in keys for _ in range(times)], "key": keys.ravel(),
                })

    dealt = groups.select("vec_id", "vector", "copies").mapInPandas(
        deal, "vec_id bigint, vector array<double>, copies bigint, size int, keys array<bigint>, key bigint"
    )
    dealt = dealt.dropDuplicates(["vec_id", "key"]) if probes > 2 * parts else dealt
    cells = pair_cells(dealt, ["size", "key"], F.col("vec_id"), BLOCK_ROWS)
    found = materialize(
        cells.groupBy("size", "key", "cell_a", "cell_b").applyInPandas(_compare(similarity), "a bigint, b bigint, links bigint")
    )
    counts = found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("links").alias("links"))
    parts_of = connected_components(found.filter("a != b"), "a", "b").withColumnRenamed("node", "vec_id")
    named = groups.join(counts, "vec_id", "left").join(parts_of, "vec_id", "left")
    named = named.withColumn("component", F.coalesce("component", "vec_id"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # Dealt anew, so that the join deals both of its sides itself and a large component can be split.
    named = named.join(least.repartition("component_id"), "component").select(
        "vec_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = held.withColumn("vec_id", F.when(F.col("ok"), F.xxhash64("vector"))).join(named, "vec_id", "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
