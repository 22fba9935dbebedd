"""Learnt operators: exact parts against brute force, held-out accuracy, folds and edge cases."""

import itertools
import math
import random
import time
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from watchtide.llm import labelled, language_id, pairwise_quality, toxic_segments
from watchtide.llm.labelled import draw, held_out
from watchtide.llm.language_id import Lattice, identify_languages, language_query, learn_languages
from watchtide.llm.pairwise_quality import QualityModel, features, learn_quality, quality_query, score_quality
from watchtide.llm.toxic_segments import ToxicityModel, learn_toxicity, score_toxicity, segments, toxic_passages, without_toxic

ODD = [None, "", " \n\t", "12 34 !!", "a", "x" * 5000, "é" * 70, "word " * 50_000, "日本語 テスト", "\x00\x85"]


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in [0, 1, 7, -3, 10**15, None]], "doc_id bigint")
    got = [r[0] for r in rows.select(held_out("doc_id", 3, 1)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False for i in [0, 1, 7, -3, 10**15, None]]


def test_draw_is_bounded(spark):
    rows = spark.range(5000).withColumn("g", (F.col("id") % 10 == 0).cast("int"))
    sizes = {r[0]: r[1] for r in draw(rows, "id", "g", 200, "s").groupBy("g").count().collect()}
    assert all(120 < n < 280 for n in sizes.values()) and len(sizes) == 2
    with pytest.raises(ValueError, match="more than 3"):
        draw(rows, "id", "id", 5, "s", most_groups=3)


# --- languages ------------------------------------------------------------------------------------------------

def all_segmentations(word, table, p):
    total = 0.0
    w = "▁" + word
    for cuts in itertools.product([0, 1], repeat=len(w) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
        product = 1.0
        for a, b in zip(edges, edges[1:]):
            piece = table.get(w[a:b])
            if piece is None:
                product *= p[len(table)] if b - a == 1 and w[a] not in table else 0.0
            else:
                product *= p[piece]
        total += product
    return total


def test_forward_sums_all_segmentations():
    table = language_id.vocabulary(language_id.VOCABULARY)
    rng = np.random.default_rng(2)
    p = rng.random((len(table) + 1, 2))
    words = ["in", "there", "übung", "q𐍈z", "nation"]
    got = Lattice(words, language_id.VOCABULARY).likelihood(p)
    for word, row in zip(words, got):
        assert row == pytest.approx([all_segmentations(word, table, p[:, k]) for k in (0, 1)])


def test_expected_uses_are_the_derivative():
    table = language_id.vocabulary(language_id.VOCABULARY)
    p = np.random.default_rng(3).random((len(table) + 1, 1))
    lattice = Lattice(["there"], language_id.VOCABULARY)
    uses = lattice.expected(p, np.array([[3.0]]))
    piece = table["the"]
    up = p.copy()
    up[piece] *= 1 + 1e-6
    slope = (math.log(lattice.likelihood(up)[0, 0]) - math.log(lattice.likelihood(p)[0, 0])) / 1e-6
    assert uses[piece, 0] == pytest.approx(3 * slope, rel=1e-3)


def rare_pieces(languages, seed=5):
    """Probabilities of which most are as small as those of pieces a language has not shown in 1e8."""
    rng = np.random.default_rng(seed)
    p = rng.random((len(language_id.vocabulary(language_id.VOCABULARY)) + 1, languages))
    p[rng.random(len(p)) < 0.9] = 1e-10
    return p / p.sum(axis=0)


def long_sum(word, table, p):
    """The logarithm of the sum over all segmentations, in numbers whose exponents have no limit that matters."""
    w, longest = "▁" + word, max(map(len, table))
    exact = [Decimal(1)] + [Decimal(0)] * len(w)
    for end in range(1, len(w) + 1):
        for start in range(max(0, end - longest), end):
            piece = table.get(w[start:end], len(table) if end - start == 1 else None)
            if piece is not None:
                exact[end] += exact[start] * Decimal(float(p[piece]))
    return float(exact[-1].ln())


def test_whole_runs_of_letters_are_marginalised():
    table = language_id.vocabulary(language_id.VOCABULARY)
    p = rare_pieces(2)
    words = ["there", "q" * 40, "überdiestraße" * 4, "日本語"]
    got = language_id.log_likelihoods(words, p, language_id.VOCABULARY)
    assert np.isfinite(got).all()
    for word, row in zip(words, got):
        assert row == pytest.approx([long_sum(word, table, p[:, k]) for k in (0, 1)], rel=1e-9)


def test_sums_by_logarithms_and_by_windows_are_those_by_products(monkeypatch):
    p = np.random.default_rng(7).random((len(language_id.vocabulary(language_id.VOCABULARY)) + 1, 2))
    words = ["thereandbackagain" * 4, "in", "qzx" * 20]
    plain = np.log(Lattice(words, language_id.VOCABULARY).likelihood(p))
    assert Lattice(words, language_id.VOCABULARY).likelihood(np.log(p), logs=True) == pytest.approx(plain)
    monkeypatch.setattr(language_id, "room", lambda p: 20)
    assert language_id.log_likelihoods(words, p, language_id.VOCABULARY) == pytest.approx(plain)


def test_expected_uses_of_words_too_unlikely_for_products():
    p = rare_pieces(2)
    words, counts = ["q" * 60, "there"], np.array([[2.0, 1.0], [3.0, 0.0]])
    got = language_id.expected_uses(words, p, counts, language_id.VOCABULARY)
    assert np.isfinite(got).all()
    sizes = np.array([len(x.removeprefix("▁")) + x.startswith("▁") for x in language_id.vocabulary(language_id.VOCABULARY)] + [1])
    assert sizes @ got == pytest.approx([2 * 61 + 3 * 6, 61])  # each letter of each use lies in one piece
    both = sum(Lattice([w], language_id.VOCABULARY).expected(np.log(p), c[None], logs=True) for w, c in zip(words, counts))
    assert got == pytest.approx(both, rel=1e-9, abs=1e-12)


def test_predictions_are_the_posterior_over_all_segmentations():
    table = language_id.vocabulary(language_id.VOCABULARY)
    p = np.random.default_rng(8).random((len(table) + 1, 3))
    models = language_id.PieceModels(["a", "b", "c"], p / p.sum(axis=0), language_id.VOCABULARY)
    texts = ["In there, in nation!", None, "übung 12 in", "..", "a"]
    names, scores = models.predict(texts, language_id.WordMemo(models.log_likelihood))
    for text, name, score in zip(texts, names, scores):
        words = language_id.words_of(text or "")
        if not words:
            assert (name, score) == ("und", 0.0)
            continue
        each = [math.prod(all_segmentations(w, table, models.probability[:, k]) for w in words) for k in range(3)]
        assert name == "abc"[each.index(max(each))] and score == pytest.approx(max(each) / sum(each))


def test_many_languages_and_a_text_without_spaces(texts_session, documents):
    rows = [(n, f"wort{'abcdefghij'[n % 10]} {chr(97 + n // 10 % 26) * 3} and so on", f"l{n // 2:03d}", "s") for n in range(600)]
    models = learn_languages(documents([*rows, (601, "the" * 3000, "l000", "s")]))
    assert len(models.languages) == 300 and np.isfinite(models.probability).all()
    got = identify_languages(documents([(1, "the" * 20_000), (2, "wortb and so on")]), models).collect()
    assert got[0]["lang_pred"] == "l000" and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_held_out_documents(texts_session):
    docs = texts_session.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_language_edge_cases(texts_session, documents):
    table = texts_session.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    table = table.union(documents([(10**6, "nothing", None, None), (10**6 + 1, None, "en", "s"), (None, "the of and", "en", "s")]))
    models = learn_languages(table)
    assert models.languages == ["de", "en", "es", "fr"]
    rows = documents([(i, t) for i, t in enumerate(ODD)]).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in identify_languages(rows, models).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(len(ODD))] == [True, True, True, True, *[False] * 5, True]
    assert got[0]["score"] == 0.0
    nothing = learn_languages(table.limit(0))
    assert {r["lang_pred"] for r in identify_languages(rows, nothing).collect()} == {"und"}


# --- toxicity -------------------------------------------------------------------------------------------------

def maximal_segments(scores):
    """By definition: split at the best stretch, then look left and right of it (shortest, leftmost on ties)."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = -best[2], -best[2] - best[1]
    left, right = maximal_segments(scores[:a]), maximal_segments(scores[b:])
    return left + [(a, b, best[0])] + [(b + x, b + y, s) for x, y, s in right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    for _case in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(14))]
        got = segments(np.array(scores, float))
        want = maximal_segments(scores)
        assert [(a, b) for a, b, _s in got] == [(a, b) for a, b, _s in want]
        assert [s for *_x, s in got] == pytest.approx([s for *_x, s in want])


def test_toxicity_of_held_out_documents(texts_session):
    folder = "/root/testdata/sf0.1"
    docs, labels = (texts_session.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = learn_toxicity(docs, labels)
    held = docs.join(labels.filter(held_out("doc_id", 5, 0)), "doc_id")
    rows = score_toxicity(held, model).select("score", "predicted", "toxic").collect()
    clean, toxic = ([r for r in rows if r["toxic"] == k] for k in (0, 1))
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_edge_cases(texts_session, documents):
    model = ToxicityModel({"scum": 6.0, "idio*": 5.0}, 1.2, 1e-4, 8.0)
    texts = [*ODD, "scum idiot scum and scum", "the scum " + "of a " * 3000]
    rows = documents([(i, t) for i, t in enumerate(texts)]).withColumn("predicted", F.lit("clash"))
    got = {r["doc_id"]: r for r in score_toxicity(rows.union(rows), model).collect()}
    assert [got[i]["score"] for i in range(len(ODD))] == [0.0] * len(ODD)
    assert got[len(ODD)]["predicted"] == 1 and got[len(ODD) + 1]["predicted"] == 0
    spans = {r["doc_id"]: r for r in toxic_passages(rows, model).collect()}
    assert (spans[len(ODD)]["starts"], spans[len(ODD)]["ends"]) == ([0], [5]) and spans[0]["starts"] == []
    kept = without_toxic(rows.withColumn("keep", F.lit(1)), model)
    assert kept.columns == [*rows.columns, "keep"] and {r["doc_id"] for r in kept.collect()} == {*range(len(texts))} - {len(ODD)}
    labels = texts_session.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert learn_toxicity(rows, labels).weights == {}
    assert score_toxicity(rows.limit(0), model).collect() == []
    assert {r["score"] for r in score_toxicity(rows, learn_toxicity(rows, labels.limit(0))).collect()} == {0.0}


def test_labels_that_may_not_teach_do_not(texts_session, documents):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 0][:400]
    docs = documents([(i, "plain words here " + ("badword" if i % 2 else "goodword")) for i in ids])
    labels = texts_session.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id bigint, quality int, toxic int")
    assert learn_toxicity(docs, labels).weights == {}


# --- quality --------------------------------------------------------------------------------------------------

def test_quality_of_held_out_documents(texts_session):
    folder = "/root/testdata/sf0.1"
    docs, labels = (texts_session.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_query(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def plain_logistic(d, y, ridge):
    """Newton's steps on the mean logistic loss of d @ w with a ridge of `ridge` / 2."""
    w = np.zeros(d.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ w))
        slope = d.T @ (p - y) / len(y) + ridge * w
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(y) + ridge * np.eye(len(w)), slope)
    return w


def test_quality_weights_and_threshold_are_those_of_a_plain_fit(texts_session, monkeypatch):
    docs, labels = (texts_session.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    seen = {}
    fit = pairwise_quality.LogisticRegression.fit
    monkeypatch.setattr(pairwise_quality.LogisticRegression, "fit", lambda self, df: seen.setdefault("pairs", df) and fit(self, df))
    model = learn_quality(docs, labels)
    pairs = seen["pairs"].collect()
    d, y = np.array([r["features"].toArray() for r in pairs]), np.array([r["label"] for r in pairs])

    learn = labels.filter(~held_out("doc_id", 4, 2))
    rows = docs.join(learn, "doc_id").filter("quality IN (0, 1)").select("text", "quality").collect()
    x, label = np.array([features(r["text"]) for r in rows]), np.array([r["quality"] for r in rows])
    assert len(rows) < pairwise_quality.PER_LABEL  # so the sample holds them all
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx([s or 1.0 for s in x.std(axis=0)])
    standard = (x - np.array(model.mean)) / np.array(model.scale)
    possible = {tuple(np.round(h - l, 6) + 0.0) for h in standard[label == 1] for l in standard[label == 0]}
    better = np.where(y[:, None] == 1, d, -d)  # a preferred text less one that is not
    assert len(d) > 100 and {tuple(np.round(r, 6) + 0.0) for r in better} <= possible

    want = plain_logistic(d, y, pairwise_quality.RIDGE)
    found = np.array(model.weights)
    assert found @ want / np.linalg.norm(found) / np.linalg.norm(want) > 0.999
    loss = lambda w: np.logaddexp(0, -np.where(y == 1, 1, -1) * (d @ w)).mean() + pairwise_quality.RIDGE / 2 * w @ w
    assert loss(found) <= loss(want) * 1.001 + 1e-6

    strengths = np.array([pairwise_quality.strength(r, model) for r in x.tolist()])
    below = (strengths < model.threshold).mean()
    assert below == pytest.approx((label == 0).mean(), abs=1.5 / len(label))


def test_quality_learns_from_every_labelled_document(texts_session, documents):
    """Beyond 4,000 documents of a label, too: means, and a threshold with as many above it as have label 1."""
    texts = [("word " * (i % 40 + 1)).strip() + ("." if i % 3 else " |") for i in range(12_000)]
    docs = documents([*enumerate(texts), (1, texts[1])])  # an id with two rows is one document
    labels = texts_session.createDataFrame([(i, int(i % 3 > 0)) for i in range(len(texts))], "doc_id bigint, quality int")
    model = learn_quality(docs, labels)
    learn = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.array([features(texts[i]) for i in learn])
    assert sum(i % 3 > 0 for i in learn) > 4000
    assert model.mean == pytest.approx(x.mean(axis=0), rel=1e-12) and model.scale == pytest.approx([s or 1.0 for s in x.std(axis=0)])
    strengths = np.sort([pairwise_quality.strength(r, model) for r in x.tolist()])
    low = sum(i % 3 == 0 for i in learn)
    assert model.threshold == pytest.approx((strengths[low - 1] + strengths[low]) / 2)


def test_quality_edge_cases(texts_session, documents):
    rows = documents([(i, t) for i, t in enumerate(ODD)]).withColumn("features", F.lit("clash"))
    labels = texts_session.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = learn_quality(rows, labels)
    got = {r["doc_id"]: r for r in score_quality(rows, model).collect()}
    assert [got[i]["predicted"] for i in range(len(ODD))] == [0, 0, 0, *[1] * 7]
    assert score_quality(rows.limit(0), model).collect() == []
    assert all(len(features(t)) == len(pairwise_quality.NAMES) and all(map(math.isfinite, features(t))) for t in ODD)
    sure = QualityModel([0.0] * 16, [1.0] * 16, [1e9] + [0.0] * 15, 0.0)
    assert pairwise_quality.score_of(features("a b"), sure) == 1.0
    assert toxic_segments.score_of(0.0, 1.0) == 0.0


# --- samples and scans ----------------------------------------------------------------------------------------

def test_a_sample_holds_one_row_of_an_id(texts_session, documents):
    docs = documents([(3, f"text {i % 50:02d}") for i in range(3000)] + [(4, None), (None, "no id"), (5, "other")])
    labels = texts_session.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, 2)], "doc_id bigint, toxic int")
    got = labelled.labelled_sample(docs, labels, "toxic", "doc_id", "text", F.lit(True), 100, "s")
    assert got.columns == ["id", "text", "label"]
    assert sorted(map(tuple, got.collect())) == [(3, "text 00", 1), (4, "", 0)]


def plain_segments(scores):
    """By definition: the best stretch, then the best of what lies on either side of it."""
    def best_of(a, b):
        sums = [(sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        top = max(sums, default=(0,))
        if top[0] <= 0:
            return []
        i, j = top[3], top[4]
        return best_of(a, i) + [(i, j, top[0])] + best_of(j, b)

    return best_of(0, len(scores))


def test_segments_equal_their_definition():
    rng = np.random.default_rng(11)
    for n in (1, 5, 20, 40):
        for _ in range(15):
            scores = rng.normal(-0.2, 1.0, n)
            got = toxic_segments.segments(scores)
            want = plain_segments(scores.tolist())
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_the_scan_grows_in_proportion():
    """Steps down and up leave many candidates open, where a search through all of them grows with the square."""
    def seconds(n):
        scores = np.where(np.arange(n) % 2, 1.0, -1.5)
        scores[n // 2:] = np.where(np.arange(n - n // 2) % 2, 1.0, -0.75)
        start = time.perf_counter()
        assert toxic_segments.segments(scores)
        return time.perf_counter() - start

    seconds(1000)
    small = min(seconds(20_000) for _ in range(3))
    assert min(seconds(200_000) for _ in range(2)) < 30 * small
