"""SimHash, vector near-duplicates, components and pair cells against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from watchtide.llm import cross_polytope, pair_blocks, simhash_vptree
from watchtide.llm.components import connected_components
from watchtide.llm.cross_polytope import similar_vectors
from watchtide.llm.simhash_vptree import VantageTree, close_pairs, exact_links, one_of_each, simhash_components


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components_of(ids, links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_components(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_simhash_of_the_table(texts_session):
    check_simhash(texts_session.read.parquet(f"{SMALL}/documents.parquet"))


def test_simhash_edge_cases(documents):
    long = " ".join(str(i * i % 9973) for i in range(100_000))
    texts = [None, "", " \n", "One two", "one TWO", "É a b", "é a b", "a b c d", "a b c d", long, long + " end", "x\x85y z\x1cq r"]
    docs = documents([(i + 5, t) for i, t in enumerate(texts)])
    check_simhash(docs)
    twice = simhash_components(docs.union(docs).union(documents([(None, "a b c d")]))).collect()
    assert len(twice) == 2 * len(texts) + 1
    assert {r["component_id"] for r in twice if r["fingerprint"] == f"{plain_fingerprint('a b c d'):016x}"} == {12}
    assert simhash_components(documents([])).collect() == []


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_tree_shards_miss_no_pair(texts_session, monkeypatch, blocks):
    monkeypatch.setattr(simhash_vptree, "LEAF_ROWS", 32)  # deep trees, full shards
    rng = random.Random(blocks)
    centres = [rng.getrandbits(64) for _ in range(60)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(12)})
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    found = exact_links(texts_session.createDataFrame(signed, "print_id bigint"), 2, blocks).collect()
    ids = [s[0] for s in signed]
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = components_of(ids, near)
    assert all(r["a"] != r["b"] and want[r["a"]] == want[r["b"]] for r in found)  # a shard's links connect what is linked there; none leaves a component
    assert components_of(ids, [(r["a"], r["b"]) for r in found]) == want


def test_tree_search_finds_all_close_pairs():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    points[1500:] = points[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    i, j = close_pairs(points[:, None], np.arange(3000), np.arange(3000), 2)
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 2)
    assert {*zip(i.tolist(), j.tolist())} == {(x, y) for x, y in zip(a.tolist(), b.tolist()) if x != y}
    homes = VantageTree(points, 16).route(points, 0)
    assert {len(h) for h in homes} == {1}


def changed(text, share, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_one_of_each_group(documents):
    rng = random.Random(3)
    originals = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(originals)]
    rows += [(100 + i, changed(t, 0.012, rng)) for i, t in enumerate(originals)]  # similarity about 0.89
    rows += [(200 + i, t) for i, t in enumerate(originals)]
    rows += [(0, originals[0]), (None, originals[1]), (None, "alone without id"), (300, None), (301, ""), (302, " ")]
    docs = documents(rows).withColumn("row_key", F.lit(1)).withColumn("bits", F.lit("x"))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) if r["doc_id"] is not None else (False, -1) for r in kept.collect()) == [
        (False, -1), *((True, i) for i in range(40)), (True, 300)
    ]


def test_one_row_stays_whatever_the_ids(documents):
    """Near copies that share an id, have none, or whose groups share their smallest id."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(4)]
    rows = [(5, texts[0]), (5, texts[0] + " one"), (6, texts[0] + " two")]
    rows += [(None, texts[1]), (None, texts[1] + " more"), (5, texts[2]), (9, texts[2] + " end"), (5, texts[3]), (5, texts[3])]
    kept = one_of_each(documents(rows)).collect()
    groups = [[i for i, t in enumerate(texts) if r["text"].startswith(t)][0] for r in kept]
    assert sorted(zip(groups, (r["doc_id"] for r in kept))) == [(0, 5), (1, None), (2, 5), (3, 5)]


def test_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, i) for i in range(1001, 1300)]
    links = chain + hub + hub + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    want = components_of({x for e in links for x in e if None not in e}, [e for e in links if None not in e])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def test_cells_hold_each_pair_once(spark):
    rows = spark.range(100).select((F.col("id") % 7 == 0).cast("int").alias("key"), "id")
    cells = pair_blocks.pair_cells(rows, ["key"], F.col("id"), 10).collect()
    met = {}
    for c in cells:
        met.setdefault((c["key"], c["cell_a"], c["cell_b"]), []).append((c["id"], c["block"]))
    assert max(map(len, met.values())) < 60
    pairs = [
        (x, y) for (_k, a, b), own in met.items() for x, p in own for y, q in own
        if x < y and {p, q} == {a, b} and (a == b) == (p == q)
    ]
    assert sorted(pairs) == sorted((x, y) for x in range(100) for y in range(x + 1, 100) if (x % 7 == 0) == (y % 7 == 0))


def brute_vectors(rows, least):
    good = {}
    for n, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[n] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    part = components_of(range(len(rows)), links)
    smallest = {}
    for n, (i, _v) in enumerate(rows):
        smallest[part[n]] = min(smallest.get(part[n], i), i)
    degree = [sum(n in e for e in links) for n in range(len(rows))]
    return [(i, degree[n], smallest[part[n]], i == smallest[part[n]]) for n, (i, _v) in enumerate(rows)]


@pytest.mark.parametrize("block_rows", [20, 1024])
def test_vectors_against_brute_force(texts_session, monkeypatch, block_rows):
    monkeypatch.setattr(cross_polytope, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    near = (centres[rng.integers(0, 30, 150)] + 0.08 * rng.normal(size=(150, 24))).astype(np.float32)
    loose = (centres[0] + 0.3 * rng.normal(size=(80, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([near, loose, centres.astype(np.float32)]))]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, [3 * x for x in rows[0][1]])]
    rows += [(910, None), (911, []), (912, [0.0] * 24), (913, [1.0, None]), (914, [float("nan"), 1.0]), (915, [float("inf"), 1.0]), (916, [1.0, 2.0])]
    rows += [(917, [2.0, 4.0])]
    table = texts_session.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("copies", F.lit(1))
    got = sorted(tuple(r) for r in similar_vectors(table).select("vec_id", "n_links", "component_id", "kept").collect())
    want = sorted(brute_vectors(rows, 0.9))
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= all_links and found >= 0.99 * all_links
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)
    assert [g for g in got if g[0] >= 900] == [w for w in want if w[0] >= 900]
    assert similar_vectors(table.limit(0)).collect() == []


def test_vectors_of_the_table(texts_session):
    table = texts_session.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = sorted(tuple(r) for r in similar_vectors(table).collect())
    assert got == sorted(brute_vectors(rows, 0.9))


def shingles_of(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


@pytest.mark.parametrize("block_rows", [8, 1024])
def test_groups_of_similar_texts_against_brute_force(documents, monkeypatch, block_rows):
    monkeypatch.setattr(simhash_vptree, "SET_ROWS", block_rows)
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = fresh(12)
    texts = [" ".join([line] * 20 + [fresh(60)]) for _ in range(12)]  # one line that repeats, own words otherwise
    for n in (5, 8, 10, 11, 12, 13, 14, 30):  # short texts, the last word changed
        for _ in range(6):
            base = fresh(n)
            texts += [base, base.rsplit(" ", 1)[0] + " other"]
    for n in (104, 204, 404):  # a tail cut or replaced, similarity 0.75 to 0.85
        for share in (0.77, 0.785, 0.795, 0.8, 0.805, 0.82):
            base, own = fresh(n).split(), round((n - 4) * (1 - share) / (1 + share))
            texts += [" ".join(base), " ".join(base[:n - own]) + " " + fresh(own), " ".join(base[:4 + round(share * (n - 4))])]
    core = fresh(120)
    texts += [core + " " + fresh(3) for _ in range(40)]  # a large group
    sets = [shingles_of(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = components_of(range(len(texts)), links)
    got = {r["doc_id"]: r["component_id"] for r in simhash_vptree.similar_components(documents(list(enumerate(texts)))).collect()}
    assert got == want
    assert 60 < len(set(want.values())) < len(texts) - 50


def test_close_fingerprints_are_proposed_by_the_trees(documents, monkeypatch):
    """Near copies are linked without any minima, by SimHash and its trees; shards so connected are not compared again."""
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    bases = [fresh(2000) for _ in range(6)]
    texts = bases + [b + " end" for b in bases] + [fresh(300) for _ in range(6)]
    sets = [simhash_vptree.shingle_set(t, 5) for t in texts]
    prints = [simhash_vptree.set_print(x) for x in sets]
    for shingles, found in zip(sets, prints):
        ones = [sum(int(h) >> bit & 1 for h in shingles) for bit in range(64)]
        assert [found >> bit & 1 for bit in range(64)] == [int(2 * n > len(shingles)) for n in ones]
    assert simhash_vptree.set_print(np.zeros(0, np.uint64)) == 0
    close = [i for i in range(6) if bin((prints[i] ^ prints[i + 6]) & (1 << 64) - 1).count("1") <= simhash_vptree.MAX_BITS]
    assert len(close) >= 4

    # Keys that no two sets share: the minima propose nothing.
    monkeypatch.setattr(simhash_vptree, "band_keys", lambda x, bands: np.array([xxhash.xxh64_intdigest(x.tobytes(), 9)], np.uint64).view(np.int64))
    got = {r["doc_id"]: r["component_id"] for r in simhash_vptree.similar_components(documents(list(enumerate(texts)))).collect()}
    assert {i for i in range(6) if got[i + 6] == i} == set(close)
    assert all(got[i] == i for i in (*range(6), *range(12, 18)))


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_vectors_are_found_whatever_the_size_of_keys(texts_session, monkeypatch, parts):
    monkeypatch.setattr(cross_polytope, "hashes_per_key", lambda n, wide: parts)
    rng = np.random.default_rng(parts)
    x, other = rng.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    y = 0.9005 * x + np.sqrt(1 - 0.9005**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    tables = max(cross_polytope.TABLES, cross_polytope.tables_needed(64, 0.9, parts, cross_polytope.PROBES))
    a, b = (cross_polytope.bucket_keys(v, tables, parts, cross_polytope.PROBES).reshape(len(v), -1) for v in (x, y))
    assert np.mean([bool({*p} & {*q}) for p, q in zip(a.tolist(), b.tolist())]) >= 0.998
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x[:100], y[:100]]))]
    table = texts_session.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = similar_vectors(table).filter("n_links = 1 AND component_id = pmod(vec_id, 100)").count()
    assert found >= 196
