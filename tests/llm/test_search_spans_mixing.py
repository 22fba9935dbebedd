"""Neighbour search, sentence spans and source mixing against brute force and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from watchtide.llm import sentence_spans, source_mixing, vptree_search
from watchtide.llm.sentence_spans import remove_repeats, sentences
from watchtide.llm.source_mixing import Marginal, mix_sources, raked
from watchtide.llm.vptree_search import nearest


def brute_nearest(rows, asks, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if asks(q):
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(near, start=1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_search_of_the_table(texts_session):
    table = texts_session.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    same(found(nearest(table, F.col("vec_id") % 100 == 0)), brute_nearest(rows, lambda q: q % 100 == 0))


def test_search_edge_cases(texts_session, monkeypatch):
    monkeypatch.setattr(vptree_search, "SHARD_ROWS", 300)
    monkeypatch.setattr(vptree_search, "QUERY_ROWS", 7)
    monkeypatch.setattr(vptree_search, "LEAF_ROWS", 8)
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, size=(900, 6)).astype(float)  # many ties and copies
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    rows += [(1000, None), (1010, []), (1020, [0.0] * 6), (1030, [None, 1.0]), (1040, [float("nan")]), (None, [1.0] * 6)]
    rows += [(1050, [1.0, 2.0]), (1051, [1.0, 3.0]), (1060, [float("inf"), 2.0])]
    table = texts_session.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    want = brute_nearest(rows, lambda q: q % 30 == 0)
    exact = found(nearest(table, F.col("vec_id") % 30 == 0))
    same(exact, want)
    assert [g[0] for g in exact if g[0] == 1050] == [1050]  # all candidates, if fewer
    loose = found(nearest(table, F.col("vec_id") % 30 == 0, factor=1.5))
    assert len(loose) == len(want)
    assert len({(g[0], g[2]) for g in loose} & {(w[0], w[2]) for w in want}) >= 0.5 * len(want)
    assert nearest(table.limit(0), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        nearest(table, F.lit(True), factor=0.5)


# --- spans ----------------------------------------------------------------------------------------------------

PASSAGE = "One two three four five. Six seven eight nine! Ten eleven twelve thirteen? " + "Fourteen and so on " * 5 + "end."


def cleaned(df, **options):
    return {r["doc_id"]: (r["text"], r["n_sentences"], r["n_removed"]) for r in remove_repeats(df, **options).collect()}


def test_repeated_passages_go(documents):
    rows = [
        (1, "Start here. " + PASSAGE + " End of one."), (2, "Other words before " + PASSAGE + "\nEnd of two."), (3, PASSAGE),
        (4, "All alone. Nothing shared. Here."), (5, None), (6, ""), (7, PASSAGE + "\n" + PASSAGE), (8, " \n "), (9, "Short. Short. Short. Short."),
    ]
    docs = documents(rows).withColumn("n_removed", F.lit("clash")).withColumn("covered", F.lit(1))
    got = cleaned(docs)
    assert got[1] == (rows[0][1], 6, 0) and got[4][0] == rows[3][1] and got[9][0] == rows[8][1]
    assert got[2][0] == "Other words before One two three four five. End of two."
    assert got[3] == ("", 4, 4) and got[5] == (None, 0, 0) and got[6] == ("", 0, 0) and got[7][0] == "" and got[8][2] == 0
    assert "covered" in remove_repeats(docs).columns


def test_rows_alike_and_rows_without_id(documents):
    got = remove_repeats(documents([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, PASSAGE), (1, PASSAGE)]
    assert remove_repeats(documents([])).collect() == []


def brute_spans(rows):
    """Distinct rows in order of id, hash and place; whatever a later run of two sentences and twelve words covers goes."""
    keys = sorted({(i is None, i or 0, key, text) for i, text, key in rows if text})
    seen, out = set(), {}
    for _none, _id, key, text in keys:
        parts = [s.strip(" \t\r\n") for s in sentences(text)]
        gone = set()
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                if sum(p.count(" ") + 1 for p in parts[a:b]) >= 12:
                    run = tuple(parts[a:b])
                    if run in seen:
                        gone |= set(range(a, b))
                    seen.add(run)
                    break
        out[key] = "".join(s for i, s in enumerate(sentences(text)) if i not in gone)
    return out


def test_one_run_stays_where_ids_repeat_or_are_null(documents):
    rng = np.random.default_rng(9)
    stock = [f"Sentence number {i} has some seven words." for i in range(12)]
    rows = [(None, PASSAGE + "\nFirst own line of this one."), (None, PASSAGE + "\nOther line at the end here.")]
    rows += [(1, PASSAGE + " One more."), (1, PASSAGE + " And another.")]
    for i in range(60):
        at = rng.integers(0, 8)
        rows.append(([None, 2, 3, 4][i % 4], " ".join([*stock[at:at + rng.integers(2, 5)], f"Own words of {i}."])))
    docs = documents(rows + rows[:5])
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    want = brute_spans([tuple(r) for r in keyed.collect()])
    got = remove_repeats(docs.withColumn("key", F.xxhash64("doc_id", "text"))).collect()
    assert len(got) == len(rows) + 5 and all(r["text"] == want[r["key"]] for r in got)
    assert len({r["key"] for r in got if PASSAGE[:40] in r["text"]}) == 1  # of the four rows with it


def test_sentences_join_to_the_text():
    for text in ["a. b", "\n\nx", ".. a", "a! ! b", "no end", "3.14 is pi. Yes", " ", "", "a.\r\n b?  c"]:
        assert "".join(sentences(text)) == text


def test_spans_equal_sql(texts_session):
    table = texts_session.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(duck.execute(sentence_spans.ORACLE).fetchall())
    assert sorted((r["doc_id"], r["n_sentences"], r["n_removed"], r["text"]) for r in remove_repeats(table).collect()) == want


# --- mixing ---------------------------------------------------------------------------------------------------

def test_raking_meets_its_targets(texts_session):
    rng = np.random.default_rng(3)
    cells = [(a, b, int(rng.integers(1, 1000))) for a in "xyz" for b in "pq"]
    df = texts_session.createDataFrame(cells, "source string, lang string, tokens bigint")
    marginals = (Marginal("source", 0.5), Marginal("lang", 0.0))
    got = raked(df, marginals, rounds=30).collect()
    total = sum(c[2] for c in cells)
    for m, at in ((marginals[0], "source"), (marginals[1], "lang")):
        values = {r[at] for r in got}
        raised = {v: (sum(r["tokens"] for r in got if r[at] == v) / total) ** m.power for v in values}
        for v in values:
            assert sum(r["weight"] for r in got if r[at] == v) == pytest.approx(raised[v] / sum(raised.values()), abs=1e-6)


def test_samples_follow_the_weights(texts_session, documents):
    rows = [(i, "a b c d e", "en", "big" if i % 4 else "small") for i in range(4000)]
    out = mix_sources(documents(rows), marginals=(Marginal("source", 0.0),), budget=0.3)
    sizes = {r[0]: r[1] for r in out.filter("sampled").groupBy("source").count().collect()}
    assert sizes["big"] == pytest.approx(600, abs=80) and sizes["small"] == pytest.approx(600, abs=60)
    full = mix_sources(documents(rows), marginals=(Marginal("source", 0.0),), budget=0.8)
    assert {r["source"]: r["p"] for r in full.select("source", "p").distinct().collect()} == pytest.approx({"small": 1.0, "big": 2200 / 3000})


def test_mixing_edge_cases(documents):
    rows = [(1, None, None, None), (2, "", "en", None), (3, "a b", None, "s"), (3, "a b", None, "s"), (None, "a", "en", "s"), (4, "x " * 100_000, "en", "s")]
    docs = documents(rows).withColumn("p", F.lit("clash")).withColumn("extra", F.lit(1))
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["p"] <= 1 for r in got)
    assert [r["tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert len({r["sampled"] for r in got if r["doc_id"] == 3}) == 1
    assert mix_sources(documents([])).collect() == []


def test_mixing_equals_sql_with_nulls(documents):
    rows = [(i, f"w {i} " * (i % 7), [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4]) for i in range(200)]
    docs = documents(rows)
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas().astype(object).where(lambda x: x.notna(), None).astype({"doc_id": "int64"}))
    want = duck.execute(source_mixing.oracle()).fetchall()
    got = mix_sources(docs).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6), F.round("p", 6), "sampled"
    ).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
