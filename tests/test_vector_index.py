"""The inverted-file vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchtide.operators import vector_index
from watchtide.operators.retrieval import vector_topk
from watchtide.operators.vector_index import Codebook, VectorIndex, build_vector_index, recall, rows_read, vector_topk_approx

CHUNKS, QUESTIONS = "chunk_id string, embedding array<float>", "query_id long, embedding array<float>"


def clustered(n, dims=16, groups=30, seed=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.4
    return points.astype(np.float32)


def frame(spark, points):
    return spark.createDataFrame([(f"c{i:05d}", v.tolist()) for i, v in enumerate(points)], CHUNKS)


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return got


def test_recall_and_share_read(spark, tmp_path):
    """Ordinary rows ask; their own row does not count. More rows, a smaller share of codes read."""
    shares = []
    for n in (400, 6400):
        path, chunks = str(tmp_path / str(n)), frame(spark, clustered(n)).repartition(3)
        build_vector_index(chunks, path)
        asked = chunks.filter(F.crc32("chunk_id") % (n // 100) == 0)
        questions = asked.select(F.substring("chunk_id", 2, 5).cast("long").alias("query_id"), "embedding")
        own = F.col("chunk_id") == F.concat(F.lit("c"), F.lpad(F.col("query_id").cast("string"), 5, "0"))
        near, exact = (x.filter(~own) for x in (vector_topk_approx(spark, path, questions, k=11), vector_topk(chunks, questions, k=11)))
        assert recall(exact, near).agg(F.avg("recall")).first()[0] >= 0.9
        shares.append(rows_read(spark, path, questions).agg(F.avg("share_read")).first()[0])
    assert shares[1] < shares[0] < 1


def test_all_cells_and_a_long_list_are_exact(spark, tmp_path):
    chunks = frame(spark, clustered(500, dims=10, seed=4)).union(frame(spark, clustered(3, dims=10, seed=4)))  # equal rows, ids repeat
    chunks = chunks.withColumn("chunk_id", F.concat("chunk_id", F.monotonically_increasing_id().cast("string")))
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(7, dims=10, seed=5))], QUESTIONS)
    build_vector_index(chunks, str(tmp_path), cells=8)
    exact = found(vector_topk(chunks, questions, k=5))
    assert found(vector_topk_approx(spark, str(tmp_path), questions, k=5, probes=8, short_list=120)) == exact
    some = found(vector_topk_approx(spark, str(tmp_path), questions, k=5, probes=2))
    assert all(len(v) == 5 and [s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in some.values())


def test_a_hot_cell_is_shared_by_tasks(spark, tmp_path, monkeypatch):
    points = clustered(300)
    points[:200] = points[0]  # copies fill one cell
    chunks = frame(spark, points)
    monkeypatch.setattr(vector_index, "HELD_FLOATS", 16 * 40)
    build_vector_index(chunks, str(tmp_path), cells=6)
    index = VectorIndex.load(spark, str(tmp_path))
    assert index.slices.max() >= 5 and index.sizes.sum() == 300
    questions = spark.createDataFrame([(1, points[0].tolist()), (2, points[250].tolist())], QUESTIONS)
    got = found(vector_topk_approx(spark, str(tmp_path), questions, k=9, probes=6))
    assert [i for i, _ in got[1]] == [f"c{i:05d}" for i in range(9)] and got[2][0] == ("c00250", 1.0)


def test_odd_rows(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0]), ("d", None), ("e", []), ("f", [1.0, None]), ("g", [float("nan"), 1.0]),
            ("h", [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    chunks = spark.createDataFrame(rows, CHUNKS).withColumn("cell", F.lit("clash"))
    build_vector_index(chunks, str(tmp_path / "few"))
    questions = spark.createDataFrame([(1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (None, [1.0, 1.0])], QUESTIONS)
    got = found(vector_topk_approx(spark, str(tmp_path / "few"), questions, probes=9))
    assert got == {1: [("a", pytest.approx(0.894427)), ("b", pytest.approx(0.447214))]}
    build_vector_index(chunks.limit(0), str(tmp_path / "none"))
    assert vector_topk_approx(spark, str(tmp_path / "none"), questions).collect() == []
    assert rows_read(spark, str(tmp_path / "none"), questions).collect() == []
    assert vector_topk_approx(spark, str(tmp_path / "few"), questions.limit(0)).collect() == []


def test_codes_come_back_near():
    points = clustered(2000).astype(float)
    book = Codebook.fit(points, seed=1)
    codes = book.encode(points)
    assert codes.shape == (2000, 4) and codes.dtype == np.uint8
    assert np.mean((book.decode(codes) - points) ** 2) < 0.15 * np.mean(points**2)
    assert np.allclose(Codebook.fit(points[:50], seed=1).decode(Codebook.fit(points[:50], seed=1).encode(points[:50])), points[:50])
