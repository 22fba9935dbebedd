"""Importance resampling, its selection and its ranks against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from watchtide.llm import importance_resampling as ir

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(rows, target, buckets=ir.BUCKETS, longest=1, least=20, percent=10):
    def words(text):
        return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    def feats(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in feats(x)), Counter(b for x in target for b in feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        own = feats(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(words(x)) >= least])
    can = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(can[:len(can) * percent // 100], start=1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_table_equals_brute_force(texts_session):
    docs, target = (texts_session.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    got = ir.resample(docs, target)
    assert found(got) == want and sum(r[4] is not None for r in want) > 10
    drawn = ir.drawn_documents(docs, got)
    assert drawn.columns == docs.columns
    assert {r["doc_id"] for r in drawn.collect()} == {r[0] for r in want if r[4]}


def test_odd_rows(texts_session, documents, monkeypatch):
    monkeypatch.setattr(ir, "PIECE", 64)
    rng = random.Random(1)
    vocabulary = ["Ärger", "ärger", "A1", "b2", "日本", "the", "THE", "x_y", "\x00z", "a b"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " .,"), (None, "no id " * 30), (503, "word " * 5000), (504, "x" * 3000)]
    docs = documents(rows).withColumns({"weight": F.lit("clash"), "rank": F.lit(1), "bucket": F.lit(2)})
    target = texts_session.createDataFrame([(1, "the A1 日本"), (2, None)], "item_id bigint, text string")
    texts = [r["text"] for r in target.collect()]
    assert found(ir.resample(docs, target)) == brute(rows, texts)
    assert found(ir.resample(docs, target, longest=3, buckets=500, percent=50)) == brute(rows, texts, buckets=500, longest=3, percent=50)
    assert found(ir.resample(docs, target.limit(0), percent=100)) == brute(rows, [], percent=100)
    assert ir.resample(docs.limit(0), target).collect() == []
    few = documents([(1, "a b"), (2, "c " * 30)])
    assert [r["rank"] for r in ir.resample(few, target).collect()] == [None, None]


def test_copies_are_drawn_one_by_one(texts_session, documents):
    copy = (7, "same words again and again " * 5)
    rows = [copy] * 60 + [(7, "other words in this one " * 5)] * 30 + [(i, f"text {i} " * 15) for i in range(100, 130)]
    target = texts_session.createDataFrame([(1, "again")], "item_id bigint, text string")
    got = ir.resample(documents(rows), target, percent=50)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, 61)) and got.count() == len(rows)
    assert [g[:4] for g in found(got)] == [w[:4] for w in brute(rows, ["again"], percent=50)]


@pytest.mark.parametrize("spread", [1, 5, 10_000])
def test_selection_finds_every_place(texts_session, spread):
    rng = random.Random(spread)
    values = [(rng.randrange(spread), rng.randrange(3)) for _ in range(400)]
    rows = texts_session.createDataFrame(values, "a int, b bigint").repartition(5)
    order = sorted(values)
    for k in (1, 2, 57, 200, 399, 400):
        assert tuple(ir.kth_key(rows, k, ["a", "b"])) == order[k - 1]
    ranks = ir.ranked(rows, ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(ranks, key=lambda r: r["rank"])] == order
    assert sorted(r["rank"] for r in ranks) == list(range(1, 401))
