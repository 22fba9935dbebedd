"""Keyword search over an index of several loads and segments against brute force."""

import math
import random
import re
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchtide.operators import keyword_index
from watchtide.operators.keyword_index import Segment, add_to_index, keyword_search, search_index
from watchtide.operators.spread import spread

CHUNKS, QUESTIONS = "chunk_id string, chunk string", "query_id long, text string"


def brute(chunks, questions, k):
    said = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in chunks}
    n, mean = len(said), sum(sum(c.values()) for c in said.values()) / len(said)
    out = {}
    for q, text in questions:
        scores = {}
        for word in set(re.findall(r"[^\W_]+", text.lower())):
            holders = [i for i, c in said.items() if word in c]
            idf = math.log(1 + (n - len(holders) + 0.5) / (len(holders) + 0.5))
            for i in holders:
                tf, length = said[i][word], sum(said[i].values())
                scores[i] = scores.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
        best = sorted((-round(s, 6), i) for i, s in scores.items() if round(s, 6) > 0)[:k]
        if best:
            out[q] = [(i, -s) for s, i in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def texts(n, seed):
    """Common words nearly everywhere, rare ones in a few, and copies that tie."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        said = ["the"] * rng.randrange(1, 4) + rng.choices(["red", "Blue", "hen", "fox"], k=rng.randrange(6))
        said += [f"w{rng.randrange(200)}" for _ in range(rng.randrange(10))] + (["Ärger_x"] if i % 17 == 0 else [])
        rng.shuffle(said)
        rows.append((f"c{i:04d}", " ".join(said)))
    return rows + [(f"copy{i}", "the same old text") for i in range(30)] + [("empty", ""), ("marks", "?! ...")]


QUESTION_TEXTS = [
    (1, "the red hen"), (2, "THE the THE"), (3, "w7 the"), (4, "ärger x the fox"), (5, "old text, the same"), (6, "none such"), (7, ""),
    (8, "the blue w1 w2 w3 w4 w5 w6 w8 w9"), (9, None),
]


@pytest.mark.parametrize("few", [200, 0])
@pytest.mark.parametrize("k", [1, 10, 40])
def test_loads_and_segments(spark, tmp_path, monkeypatch, few, k):
    monkeypatch.setattr(keyword_index, "FEW_WORDS", few)
    chunks = texts(400, seed=k)
    df = spark.createDataFrame(chunks + [(None, "the red hen")], CHUNKS)
    questions = spark.createDataFrame(QUESTION_TEXTS, QUESTIONS)
    path = str(tmp_path / "index")
    first = F.crc32("chunk_id") % 3 == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # several segments in a task
    try:
        add_to_index(df.filter(first), path, load="a", segment_words=300)
        add_to_index(df.limit(5), path, load="b")  # to be replaced as a whole
        add_to_index(df.filter(~first), path, load="b", segment_words=300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.read.parquet(path).filter("bucket = -1").count() > 8
    want = brute(chunks, [(q, t or "") for q, t in QUESTION_TEXTS], k)
    same(found(search_index(spark, path, questions, k=k)), want)
    same(found(keyword_search(df, questions, k=k)), want)


def test_edge_tables(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "red")], CHUNKS)
    questions = spark.createDataFrame([(1, "red"), (None, "red"), (2, "red red blue")], QUESTIONS)
    assert found(keyword_search(chunks.limit(0), questions)) == {}
    assert found(keyword_search(chunks, questions.limit(0))) == {}
    assert found(keyword_search(spark.createDataFrame([("a", "?"), ("b", None)], CHUNKS), questions)) == {}
    assert set(found(keyword_search(chunks, questions.withColumn("word", F.lit(3))))) == {1, 2}


def test_few_words_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    add_to_index(spark.createDataFrame(texts(100, 1), CHUNKS), path, load="a")
    stored = spark.read.schema(keyword_index.STORED + ", load string, bucket int").parquet(path)
    rows = keyword_index._of_words(stored, spark.createDataFrame([("hen",)], "word string"), keyword_index.BUCKETS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,hen)" in plan.replace(" ", "") and "PartitionFilters:[isnotnull(bucket" in plan.replace(" ", "")
    assert {r["word"] for r in rows.collect()} == {"hen"}
    add_to_index(spark.createDataFrame(texts(10, 1), CHUNKS), path, load="b", buckets=3)
    with pytest.raises(ValueError, match="buckets"):
        search_index(spark, path, spark.createDataFrame([(1, "hen")], QUESTIONS))


def test_weak_words_are_not_added_up(monkeypatch):
    """A word in every chunk is looked up for the chunks that the rare words found, and nothing else."""
    own, n = Segment(), 5000
    own.add("the", np.arange(n), np.ones(n), np.full(n, 10.0), 10.0)
    own.add("rare", np.arange(0, n, 100), np.ones(50), np.full(50, 10.0), 10.0)
    added = []
    sums = Segment._sums
    monkeypatch.setattr(Segment, "_sums", lambda self, terms: added.extend(len(t[2]) for t in terms) or sums(self, terms))
    at, scores = own.search(["the", "rare"], [0.001, 5.0], 10)
    assert at.tolist() == list(range(0, 1000, 100)) and scores == pytest.approx([5.001] * 10)
    assert max(added) == 50
    at, _scores = own.search(["the", "rare"], [0.001, 5.0], 60)  # more than the rare word holds
    assert at.tolist() == list(range(0, n, 100)) + [i for i in range(20) if i % 100][:10]


def test_spread(spark):
    small = spark.range(100).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(1 << 40)
    assert spread(large) is large


def test_a_task_holds_one_segment_at_a_time(monkeypatch):
    """Rows of several segments in one task: each is let go before the next, whatever segments meet there."""
    alive, most = weakref.WeakSet(), []

    class Counted(keyword_index.Segment):
        def __init__(self):
            super().__init__()
            alive.add(self)

        def search(self, asked, idfs, k):
            most.append(sum(bool(s.lists) for s in alive))
            return super().search(asked, idfs, k)

    monkeypatch.setattr(keyword_index, "Segment", Counted)
    posting = np.array([0, 1, 4, 1, 2, 4], "<i4").tobytes()
    rows = [r for s in (3, 5, 9) for r in ((s, None, "a", posting, None, None), (s, 1, None, None, ["a"], [1.0]))]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.float64())))],
        names=["segment", "query_id", "word", "postings", "asked", "idfs"],
    )
    found = [b.to_pydict() for b in keyword_index._search_segments(5, 4.0)(iter([batch.slice(0, 3), batch.slice(3)]))]
    assert [s for f in found for s in f["segment"]] == [3, 3, 5, 5, 9, 9]
    assert [o for f in found for o in f["ordinal"]] == [1, 0] * 3
    assert most == [1, 1, 1]
