"""Top-k by inner product and vector codes against brute force in whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tests.conftest import SMALL
from watchtide.llm import maxscore_search, vector_codes
from watchtide.llm.maxscore_search import Postings, top_products
from watchtide.llm.vector_codes import compress, decompress, exact_products

ODD = [
    (2000, None), (2010, []), (2011, []), (2020, [0.0] * 8), (2030, [None] * 8), (2040, [float("nan")] * 8), (None, [1.0] * 8),
    (2050, [1.0, 2.0]), (2051, [1.0, -3.0]), (2060, [float("-inf")] + [2.0] * 7), (3, [9.0] * 8), (3, [-9.0] * 8), (30, [5.0] * 8),
]


def whole(rows, scale):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * x) for x in v]) for i, v in kept]


def brute_products(rows, asks, k=5):
    held = [(i, v) for i, v in whole(rows, 256.0) if i is not None]
    firsts = {}
    for i, v in held:
        if asks(i):
            firsts[i] = min(firsts.get(i, v), v)
    out = []
    for q, x in firsts.items():
        near = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in held if i != q and len(y) == len(x))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near, start=1)]
    return sorted(out)


def products(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_products_of_the_table(texts_session):
    table = texts_session.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert products(top_products(table, F.col("vec_id") % 50 == 0)) == brute_products(rows, lambda q: q % 50 == 0)


@pytest.mark.parametrize("kind", ["dense", "sparse", "negative"])
def test_products_of_odd_tables(texts_session, monkeypatch, kind):
    monkeypatch.setattr(maxscore_search, "SHARD_ROWS", 120)
    monkeypatch.setattr(maxscore_search, "HEADS", 3)
    rng = np.random.default_rng(4)
    points = rng.integers(-2, 3, size=(700, 8)) / 2.0  # many ties and copies
    if kind == "sparse":
        points = points * (rng.random(points.shape) < 0.25)
    if kind == "negative":
        points = -np.abs(points) - 0.25
        points[::10] *= -1  # all scores of queries are negative
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + ODD
    table = texts_session.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"score": F.lit("clash"), "id": F.lit(1)})
    assert products(top_products(table, F.col("vec_id") % 10 == 0)) == brute_products(rows, lambda q: q % 10 == 0)
    assert top_products(table.limit(0), F.lit(True)).collect() == []
    two = texts_session.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id bigint, embedding array<float>")
    assert products(top_products(two, F.col("vec_id") % 50 == 0)) == [(50, 1, 51, 256 * 512)]


def test_search_leaves_rows_out():
    """Rows in non-essential terms only are never scored, and the answer stays that of all products."""
    rng = np.random.default_rng(5)
    matrix = (rng.integers(0, 40, size=(3000, 60)) * (rng.random((3000, 60)) < 0.05)).astype(np.int64)
    index = Postings(np.arange(3000), matrix)
    query = np.zeros(60, dtype=np.int64)
    query[:3], query[3:] = 50, 1
    ids, scores = index.search(-1, query, 5)
    every = matrix @ query
    assert scores.tolist() == sorted(every.tolist(), reverse=True)[:5] and every[ids].tolist() == scores.tolist()
    least = index._threshold(-1, query, np.argsort(-query * matrix.max(axis=0)), 5)
    assert 57 * 40 > least > 0  # so weak terms are non-essential


def test_too_large_components_fail(texts_session):
    table = texts_session.createDataFrame([(50, [1e30]), (51, [2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(PythonException, match="beyond"):
        top_products(table, F.lit(True)).collect()


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, v) for (i, label, _), (_, v) in zip([r for r in rows if whole([(r[0], r[2])], 1.0)], whole([(r[0], r[2]) for r in rows], 4096.0))]
    can = sorted((i, v) for i, _, v in kept if i is not None and v and len(v) % parts == 0)
    if not can:
        return [(i, None, None, None, None) for i, _, _ in kept]
    dims = len(can[0][1])
    width = dims // parts
    cut = {n: [v[p * width:(p + 1) * width] for p in range(parts)] for n, (_, _, v) in enumerate(kept) if len(v) == dims}
    start = [v for _, v in can if len(v) == dims][:entries]
    books = [[list(v[p * width:(p + 1) * width]) for v in start] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for pieces in cut.values():
                own[nearest(pieces[p], book)[1]].append(pieces[p])
            books[p] = [[sum(c) // len(members) for c in zip(*members)] if members else e for members, e in zip(own, book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = {n: [nearest(x, b) for x, b in zip(pieces, books)] for n, pieces in cut.items()}
    errors = {n: sum(d for d, _ in c) for n, c in coded.items()}
    sums = {}
    for n, (_, label, _) in enumerate(kept):
        if n in errors:
            sums[label] = sums.get(label, 0) + errors[n]
    return [
        (i, "".join(f"{j:02x}" for _, j in coded[n]) if n in coded else None, errors.get(n), sums.get(label), digest)
        for n, (i, label, _) in enumerate(kept)
    ]


def codes(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_codes_of_the_table(texts_session):
    table = texts_session.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]
    got, books = compress(table)
    assert codes(got) == sorted(map(repr, brute_codes(rows)))
    near = decompress(got, books).join(table, "vec_id")
    apart = F.aggregate(F.zip_with("vector", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    assert all(abs(r[0] - r[1]) < 0.01 for r in near.select(apart, F.col("error") / 4096.0**2).collect())


def test_codes_of_odd_tables(texts_session):
    rng = np.random.default_rng(6)
    points = rng.integers(-3, 4, size=(300, 16)) / 4.0 + rng.integers(0, 2, size=(300, 1)) * 4000.0
    rows = [(int(i) + 2, [None, 1, 2][i % 3], v.tolist()) for i, v in enumerate(points)]
    rows += [(i, 7, v) for i, v in ODD] + [(1, 1, [0.5] * 15), (400, None, [-16000.0] * 16), (400, None, [-16000.0] * 16)]
    schema = "vec_id bigint, label int, embedding array<double>"
    table = texts_session.createDataFrame(rows, schema).withColumns({"code": F.lit("clash"), "error": F.lit(1)})
    want = sorted(map(repr, brute_codes(rows)))
    assert codes(compress(table)[0]) == want
    assert codes(compress(table.repartition(7))[0]) == want
    few = texts_session.createDataFrame(rows[:5], schema)
    assert codes(compress(few)[0]) == sorted(map(repr, brute_codes(rows[:5])))
    none = texts_session.createDataFrame([(1, 1, [1.0, 2.0]), (2, None, None)], schema)
    assert compress(none)[1] is None and codes(compress(none)[0]) == ["(1, None, None, None, None)"]
    assert compress(table.limit(0))[0].collect() == []


@pytest.mark.parametrize("size", [10, 1 << 20, 1 << 26])
def test_limb_products_are_exact(size):
    rng = np.random.default_rng(7)
    for dims in (1, 3, 8, 200):
        x, y = (rng.integers(-size, size + 1, size=(20, dims)) for _ in range(2))
        x[0], y[0] = size, -size
        want = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in y] for r in x]
        assert exact_products(x, y).tolist() == want
