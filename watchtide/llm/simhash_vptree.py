"""SimHash fingerprints of word shingles with near-duplicates among them by vantage-point trees, and texts with
similar sets of shingles, which these and minima propose."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.llm.components import connected_components
from watchtide.llm.pair_blocks import pair_cells, star_links
from watchtide.llm.texts import with_text_columns
from watchtide.operators.small_side import join_checked
from watchtide.session import materialize

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
LEAF_ROWS = 2048
SAMPLE = 65_536  # fingerprints the tree is planted from; a leaf that still fills up is compared in blocks
MOST_LEAVES = 8_192
BRUTE_ROWS = 96
CHUNK = 1 << 16  # shingles whose bits are counted at once

# Similarity of shingles: keys of so many minima each, and blocks of so many sets.
BAND_ROWS = 4
MISSED = 1e-4
SET_ROWS = 1024
SHINGLES_AT_ONCE = 4096


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, words64: int = 1) -> np.ndarray:
    """SimHash of a text in `words64` 64-bit words, as uint64.

    Words are runs without ASCII white space after lower-casing A-Z; a bit is set if it is set in over half of
    the hashes of all k-word shingles, repeats included (fewer words: one shingle of them all; none: zero).
    The first word takes XXH64 with seed 42 itself, later words a mix of it.
    """
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return np.zeros(words64, np.uint64)
    joined = b" ".join(tokens)
    starts = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, out=starts[1:])
    n = max(1, len(tokens) - k + 1)
    ends = (starts[k:] if len(tokens) >= k else starts[-1:]) - 1
    ones = np.zeros((words64, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(starts[at:min(at + CHUNK, n)].tolist(), ends[at:at + CHUNK].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
        for w in range(words64):
            bits = np.unpackbits((mix(h, w) if w else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[w] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def mix(h: np.ndarray, w: int) -> np.ndarray:
    """Another 64 bits from a hash (the finalizer of splitmix64)."""
    z = h + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def hex64(column: Column) -> Column:
    """16 lowercase hex digits of a 64-bit integer."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# --- the tree ---------------------------------------------------------------------------------------------------

class VantageTree:
    """Splits fingerprints by their Hamming distance to vantage points; leaves are shards."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = SEED):
        self.nodes: list[tuple] = []  # (point, radius, inner, outer), or (None, leaf number)
        self.leaves = 0
        self._grow(sample, leaves, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, leaves: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if leaves > 1 and len(points) > 1:
            vantage = points[rng.integers(len(points))]
            far = np.bitwise_count(points ^ vantage)
            radius = int(np.median(far))
            inner = far <= radius
            if inner.any() and not inner.all():
                inside = self._grow(points[inner], leaves // 2, rng)
                outside = self._grow(points[~inner], leaves - leaves // 2, rng)
                self.nodes[at] = (int(vantage), radius, inside, outside)
                return at
        self.nodes[at] = (None, self.leaves)
        self.leaves += 1
        return at

    def route(self, points: np.ndarray, reach: int) -> list[list[int]]:
        """For each point its home leaf, then the leaves it visits as a guest.

        A link across a boundary is found on the inner side: a point outside visits inside if it is within
        `reach` of the boundary. From there on a guest enters every side that the triangle inequality leaves
        open.
        """
        out: list[list[int]] = [[] for _ in points]
        stack = [(0, np.arange(len(points)), np.zeros(0, np.int64))]
        guests_of: list[tuple[np.ndarray, int]] = []
        while stack:
            at, home, guests = stack.pop()
            node = self.nodes[at]
            if node[0] is None:
                for i in home:
                    out[i].append(node[1])
                guests_of.append((guests, node[1]))
                continue
            vantage, radius, inside, outside = node
            vantage = np.uint64(vantage)
            far, far_guests = np.bitwise_count(points[home] ^ vantage).astype(int), np.bitwise_count(points[guests] ^ vantage).astype(int)
            visit = np.concatenate([home[(far > radius) & (far <= radius + reach)], guests[far_guests <= radius + reach]])
            if (far <= radius).any() or len(visit):
                stack.append((inside, home[far <= radius], visit))
            if (far > radius).any() or (far_guests > radius - reach).any():
                stack.append((outside, home[far > radius], guests[far_guests > radius - reach]))
        for guests, leaf in guests_of:
            for i in guests:
                out[i].append(leaf)
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of `a` against each row of `b` (rows of uint64 words)."""
    total = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
    for w in range(1, a.shape[1]):
        total += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return total


def close_pairs(points: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of `left` x `right` rows within `reach` differing bits: a vantage-point tree over `left`
    searched by all of `right` together, branches pruned by the triangle inequality."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(left, right)]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        inner = np.ones(len(own), bool)
        if len(own) > BRUTE_ROWS and len(ask) > BRUTE_ROWS // 4:
            vantage = points[own[len(own) // 2]][None]
            far, far_ask = distances(points[own], vantage)[:, 0], distances(points[ask], vantage)[:, 0]
            radius = int(np.median(far))
            inner = far <= radius
        if not inner.all():
            stack.append((own[inner], ask[far_ask <= radius + reach]))
            stack.append((own[~inner], ask[far_ask > radius - reach]))
            continue
        step = max(1, (1 << 20) // len(ask))
        for at in range(0, len(own), step):
            i, j = np.nonzero(distances(points[own[at:at + step]], points[ask]) <= reach)
            found.append((own[at:at + step][i], ask[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found))
    keep = i != j
    return i[keep], j[keep]


def _link_cell(reach: int):
    """Compares a cell's rows; gives as few links as connect what is linked there."""

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        points = np.frombuffer(b"".join(cell["bits"]), np.uint64).reshape(len(cell), -1)
        block, a, b = cell["block"].to_numpy(), cell["cell_a"].iloc[0], cell["cell_b"].iloc[0]
        i, j = close_pairs(points, np.flatnonzero(block == a), np.flatnonzero(block == b), reach)
        i, j = star_links(len(cell), i, j)
        ids = cell["print_id"].to_numpy()
        return pd.DataFrame({"a": ids[i], "b": ids[j]})

    return link


def linked_prints(sharded: DataFrame, shard: list[str], reach: int) -> DataFrame:
    """Links (`a`, `b`) among rows (shard columns, `print_id`, `bits`) that share a shard and differ in at most
    `reach` bits; fewer than there are pairs, but connecting the same rows."""
    cells = pair_cells(sharded, shard, F.col("print_id"), LEAF_ROWS)
    return cells.groupBy(*shard, "cell_a", "cell_b").applyInPandas(_link_cell(reach), "a bigint, b bigint")


# --- narrow reach: exact, by the tree ---------------------------------------------------------------------------

def fingerprint_table(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(`doc_id`, `print_id`): the 64-bit fingerprint of every row, as a signed integer."""

    def run(texts: list[str | None]) -> dict:
        return {"print_id": [int(fingerprint(t, k)[0].view(np.int64)) for t in texts]}

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text"))
    return with_text_columns(narrow, "_text", run, "print_id: bigint").drop("_text")


def block_masks(blocks: int) -> list[np.uint64]:
    """The 64 bits in runs of about equal length."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    return [np.uint64((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]


def exact_links(prints: DataFrame, reach: int, blocks: int | None = None) -> DataFrame:
    """Links among distinct `print_id` that differ in at most `reach` bits, none missed.

    Each of `blocks` runs of bits has a tree of its own that deals fingerprints into shards by their distances on
    these bits. Of two linked fingerprints some block differs in at most reach // blocks bits, so only shards
    within that distance of a boundary overlap there; by default blocks are so many that this is 0, and every
    fingerprint lies in one shard per block. (One block overlaps within the whole reach: exact too, but with
    copies that multiply by about 1.5 on each level.) Within a shard all bits count.
    """
    blocks = blocks or reach + 1
    n = prints.count()
    leaves = min(MOST_LEAVES, max(1, math.ceil(n / (LEAF_ROWS // 2))))
    part = min(1.0, SAMPLE / max(n, 1))
    drawn = prints.filter(F.pmod(F.xxhash64("print_id", F.lit("vantage")), F.lit(1 << 30)) < int(part * (1 << 30)))
    sample = np.array([r[0] for r in drawn.limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [(mask, VantageTree(sample & mask, leaves)) for mask in block_masks(blocks)]

    def route(batches):
        for batch in batches:
            points = batch["print_id"].to_numpy().view(np.uint64)
            for b, (mask, tree) in enumerate(trees):
                shards = tree.route(points & mask, reach // blocks)
                times = [len(s) for s in shards]
                yield pd.DataFrame({
                    "print_id": np.repeat(batch["print_id"].to_numpy(), times),
                    "shard": np.array([b * MOST_LEAVES + leaf for s in shards for leaf in s], np.int32),
                    "bits": [p for p, n in zip(map(np.uint64.tobytes, points), times) for _ in range(n)],
                })

    sharded = prints.mapInPandas(route, "print_id bigint, shard int, bits binary")
    return linked_prints(sharded, ["shard"], reach)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(`doc_id`, `fingerprint`, `component_id`) of every row of `docs`.

    Fingerprints link at `max_bits` or fewer differing bits; a component is named by the smallest id reachable.
    Null and empty texts and texts without a word have fingerprint zero and link like any other. Equal
    fingerprints are one node, so groups of copies cost one row. Repeated rows stay; a row without an id takes
    part, gives null as its id, and never names a component while the component has an id. Trees are planted from
    at most about SAMPLE fingerprints; every fingerprint is then routed through them.
    """
    prints = materialize(fingerprint_table(docs, id_col, text, k))
    nodes = materialize(prints.groupBy("print_id").agg(F.min("doc_id").alias("first_id")))
    links = exact_links(nodes.select("print_id"), max_bits)
    return _named(prints, nodes, links).select("doc_id", hex64(F.col("print_id")).alias("fingerprint"), "component_id")


def _named(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`prints` with `component`, a node that names all nodes linked to theirs, and `component_id`, their smallest id."""
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "print_id")
    nodes = nodes.join(parts, "print_id", "left").withColumn("component", F.coalesce("component", "print_id"))
    least = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # Dealt anew, so that the join deals both of its sides itself and a large component can be split.
    names = materialize(nodes.join(least.repartition("component_id"), "component").select("print_id", "component", "component_id"))
    return prints.join(names, "print_id")


# --- similarity of shingles: fingerprints and keys of minima propose, the shingles decide ------------------------

def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles of a text, ascending; words and short texts as in `fingerprint`."""
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    starts = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, out=starts[1:])
    n = max(1, len(tokens) - k + 1)
    spans = zip(starts[:n].tolist(), (starts[min(k, len(tokens)):] - 1).tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def set_print(shingles: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed integer: no shingle counts twice, so no repeated line decides it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = np.ascontiguousarray(shingles[at:at + CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


def close_prints(nodes: DataFrame) -> DataFrame:
    """(`print_id`, `row_key`, `shard`): any two `nodes` whose fingerprints (`simhash`) differ in at most MAX_BITS
    share a shard. By the vantage-point trees, exact; a shard is named by the fingerprint its others are tied to."""
    prints = materialize(nodes.select(F.col("simhash").alias("print_id")).distinct())
    tied = exact_links(prints, MAX_BITS).distinct()
    own = prints.select(F.col("print_id").alias("simhash"), F.col("print_id").alias("shard"))
    dealt = own.union(tied.select("a", "b")).join(nodes.select("simhash", "print_id", "row_key"), "simhash")
    dealt = materialize(dealt.select("print_id", "row_key", "shard"))
    return dealt.join(dealt.groupBy("shard").count().filter("count > 1").select("shard"), "shard")


def band_count(similarity: float) -> int:
    """Bands of BAND_ROWS minima such that a pair of this similarity shares none with probability MISSED at most."""
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - min(similarity, 0.999) ** BAND_ROWS)))


@lru_cache(maxsize=2)
def _orders(bands: int) -> np.ndarray:
    turns = np.random.default_rng(SEED).integers(0, 1 << 63, (2, bands * BAND_ROWS, 1), dtype=np.uint64)
    turns[1] = 2 * turns[1] + np.uint64(1)
    return turns


def band_keys(shingles: np.ndarray, bands: int) -> np.ndarray:
    """One key per band: BAND_ROWS minima of the shingles under orders of their own, and the band's number.

    Two texts agree in a minimum with a probability that is their Jaccard similarity, whatever their length.
    """
    turns = _orders(bands)
    least = np.full(bands * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        order = (shingles[at:at + SHINGLES_AT_ONCE] ^ turns[0]) * turns[1]
        np.minimum(least, order.min(axis=1), out=least)
    rows = least.reshape(bands, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def tied_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of sets at a Jaccard similarity of `similarity` or more connect.

    Each set is compared with all that nothing reached yet; what it reaches is compared next.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(size)])
    whole, owner = flat, np.repeat(np.arange(n), size)
    free, held = np.ones(n, bool), n
    mark = np.zeros(len(names), bool)
    ends_i, ends_j = [], []
    for root in range(n):
        todo = [root] if free[root] else []
        free[root] = False
        while todo and free.any():
            p = todo.pop()
            if 2 * np.count_nonzero(free) < held:
                still = free[owner]
                flat, owner, held = flat[still], owner[still], np.count_nonzero(free)
            own = whole[bounds[p]:bounds[p + 1]]
            mark[own] = True
            shared = np.bincount(owner[mark[flat]], minlength=n)
            mark[own] = False
            either = np.maximum(size + size[p] - shared, 1)
            near = np.flatnonzero(free & (shared / either >= similarity))
            free[near] = False
            ends_i.append(near), ends_j.append(np.full(len(near), p))
            todo += near.tolist()
    return tuple(np.concatenate(x or [np.zeros(0, np.int64)]) for x in (ends_i, ends_j))


def _link_sets(similarity: float):
    """Links within each of several shards, by the shingles."""

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        ids, sets = cell["print_id"].to_numpy(), cell["shingles"].to_numpy()
        ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in cell.groupby("shard").indices.values():
            if len(rows) > 1:
                i, j = star_links(len(rows), *tied_sets([sets[r] for r in rows], similarity))
                ends_a.append(ids[rows[i]]), ends_b.append(ids[rows[j]])
        return pd.DataFrame({"a": np.concatenate(ends_a), "b": np.concatenate(ends_b)})

    return link


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(`doc_id`, `row_key`, `component`, `component_id`) where texts link at a Jaccard similarity of their distinct k-word shingles
    of at least `similarity`.

    Nodes are distinct sets of shingles. Two proposals say which of them to compare, and every link is then decided
    by the shingles themselves. First the SimHash fingerprints of the sets, by the vantage-point trees: sets with
    fingerprints at most MAX_BITS apart share a shard. What links there connects needs no more comparing. A
    similarity of 0.8 is some ten bits of 64 away, so the rest is proposed by minima of the shingles (a pair at
    exactly `similarity` is missed with probability MISSED, more similar ones less often), of which only shards that
    the fingerprints left apart are compared.
    Shards with the same rows are compared once, and shingles are only held for texts that share a shard. Full
    shards are compared in blocks: first each block in itself, then pairs of blocks of the shards that are not
    connected yet (of minima: these propose whatever fingerprints do). A task holds the shingles of about two blocks.
    Nulls, empty texts, repeated rows and missing ids are treated as in `simhash_components`; `row_key` is the
    xxhash64 of id and text, and `component` tells apart groups that share their smallest id.
    """
    bands = band_count(similarity)

    def keys_of(texts: list[str | None]) -> dict:
        sets = [shingle_set(t, k) for t in texts]
        names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        return {"print_id": names, "simhash": [set_print(x) for x in sets], "keys": [band_keys(x, bands) for x in sets]}

    def sets_of(texts: list[str | None]) -> dict:
        return {"shingles": [shingle_set(t, k).view(np.int64) for t in texts]}

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text).alias("row_key"), F.col(text).alias("_text"))
    prints = materialize(with_text_columns(narrow, "_text", keys_of, "print_id: bigint, simhash: bigint, keys: array<bigint>").drop("_text"))
    nodes = prints.groupBy("print_id").agg(F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"), F.first("simhash").alias("simhash"), F.first("keys").alias("keys"))
    nodes = materialize(nodes)
    sharded = nodes.select("print_id", "row_key", F.explode("keys").alias("shard"))
    shards = sharded.groupBy("shard").agg(
        F.count("*").alias("n"), F.sum(F.col("print_id").cast("decimal(28,0)")).alias("rows"),
        F.sum(F.xxhash64("print_id").cast("decimal(28,0)")).alias("mixed"),
    ).filter("n > 1")
    shards = shards.groupBy("n", "rows", "mixed").agg(F.min("shard").alias("shard")).select("shard")
    met = materialize(sharded.join(shards, "shard"))
    close = materialize(close_prints(nodes))
    wanted = met.select("row_key").union(close.select("row_key")).distinct()
    held = narrow.select("row_key", "_text").join(wanted, "row_key", "left_semi").dropDuplicates(["row_key"])
    held = materialize(with_text_columns(held, "_text", sets_of, "shingles: array<bigint>").drop("_text"))

    def cells_of(rows: DataFrame) -> DataFrame:
        groups = max(1, math.ceil(rows.count() / SET_ROWS))
        return pair_cells(rows, ["shard"], F.col("print_id"), SET_ROWS).withColumn("_group", F.pmod("shard", F.lit(groups)))

    def compared(some: DataFrame) -> DataFrame:
        full = some.join(held, "row_key").select("_group", "cell_a", "cell_b", "shard", "print_id", "shingles")
        return full.groupBy("_group", "cell_a", "cell_b").applyInPandas(_link_sets(similarity), "a bigint, b bigint").distinct()

    def apart(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """The rows of shards that hold more than one of `parts` (`print_id`, `component`)."""
        named = rows.join(parts, "print_id", "left").withColumn("component", F.coalesce("component", "print_id"))
        shards = named.groupBy("shard").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        return join_checked(rows, shards.select("shard"), ["shard"], "inner")

    links = materialize(compared(cells_of(close).filter("cell_a = cell_b")))
    tied = links.groupBy(F.col("a").alias("print_id")).agg(F.min("b").alias("component"))  # one step, not all of them
    cells = cells_of(materialize(apart(met, tied)))
    links = materialize(links.union(compared(cells.filter("cell_a = cell_b"))))
    between = materialize(cells.filter("cell_a < cell_b"))
    if not between.isEmpty():
        parts = connected_components(links, "a", "b").withColumnRenamed("node", "print_id")
        links = links.union(compared(apart(between, parts)))
    return _named(prints, nodes.select("print_id", "first_id"), links).select("doc_id", "row_key", "component", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of similar texts, columns as they are: that with the smallest id.

    Where ids repeat, or none of the group has one, the smallest hash of id and text decides, so that one row stays
    whatever the ids are; a row without an id stays only if no row of its group has one. Rows equal in id and text
    are one row. Texts without a word are copies of each other.
    """
    groups = similar_components(docs, id_col, text, k, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    firsts = groups.groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.row_key").alias("__row_key"))
    keyed = docs.withColumn("__row_key", F.xxhash64(id_col, text))
    return keyed.join(firsts, "__row_key", "left_semi").dropDuplicates(["__row_key"]).drop("__row_key")
