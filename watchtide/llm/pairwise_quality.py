"""Quality: Bradley-Terry scores learnt from preference pairs, and a threshold at a quantile of the scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.labelled import held_out, labelled_rows
from watchtide.llm.texts import with_text_columns
from watchtide.operators.quantiles import order_statistic
from watchtide.session import materialize

PER_LABEL = math.inf  # labelled documents learnt from, per label: all
PAIRS = 8  # preference pairs per preferred document
PASS = 0.7  # score at the threshold
RIDGE = 1e-3
NAMES = (
    "log_words", "letters", "upper", "digits", "marks", "stops", "odd_marks", "bars", "word_length", "distinct",
    "most_frequent", "marked_words", "upper_words", "repeated_next", "line_repeats", "sentence_length",
)
WINDOW = 1000  # words; repetition is measured within windows, so that it does not depend on length
ODD = re.compile(r"[^\w\s.,'’\"()!?;:\-]")
SENTENCE = re.compile(r"[.!?]+(?=\s|$)")
RATES = (0.002, 0.02)  # what a share is measured against, on a logarithmic scale


@dataclass(frozen=True)
class QualityModel:
    """Weights of standardised features, and the score at the threshold."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float


def features(text: str | None) -> list[float]:
    """What a text looks like, in NAMES order; zeros for a text without a word."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(text)
    rate = lambda count, of: math.log1p(count / max(1, of) / RATES[0])
    kinds = Counter(text)
    letters = sum(c for ch, c in kinds.items() if ch.isalpha())
    upper = sum(c for ch, c in kinds.items() if ch.isupper())
    digits = sum(c for ch, c in kinds.items() if ch.isdigit())
    space = sum(c for ch, c in kinds.items() if ch.isspace())
    odd = sum(c for ch, c in kinds.items() if ODD.match(ch))
    distinct = top = 0.0
    for at in range(0, n, WINDOW):
        seen = Counter(words[at:at + WINDOW])
        held = min(WINDOW, n - at)
        distinct += len(seen) / math.sqrt(held) * held / n  # distinct words grow about as the root of the length
        top += max(seen.values()) * held / n / held
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n), letters / size, rate(upper, size), rate(digits, size), rate(size - letters - digits - space, size),
        rate(kinds["."] + kinds["!"] + kinds["?"], n), rate(odd, size), rate(kinds["|"], n), letters / n, distinct, top,
        rate(sum(not w[-1].isalnum() and w[-1] not in ".," for w in words), n),
        rate(sum(w.isupper() and len(w) > 1 for w in words), n),
        rate(sum(a == b for a, b in zip(words, words[1:])), n),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / (1 + len(SENTENCE.findall(text)))),
    ]


def measured(df: DataFrame, text: str) -> DataFrame:
    return with_text_columns(df, text, lambda texts: {"features": [features(t) for t in texts]}, "features: array<double>")


def learn_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text: str = "text"
) -> QualityModel:
    """Weights from preference pairs of all labelled documents that may be learnt from.

    Each document of label 1 is preferred to PAIRS documents of label 0, dealt by slots of their hash order; the
    logistic loss is that of the feature difference, without an intercept. The threshold lies between the two
    scores that part as many documents from the top as have label 1. An id with several rows takes its smallest
    features. Without documents of both labels all texts with a word score PASS.
    """
    known = labelled_rows(docs, labels, "quality", id_col, text, ~held_out(id_col, folds, held))
    found = measured(known, "text").groupBy("id", "label").agg(F.min("features").alias("features"))
    held_rows = materialize(found)
    counts = {r[0]: r[1] for r in held_rows.groupBy("label").count().collect()}
    width = len(NAMES)
    if len(counts) < 2:
        return QualityModel([0.0] * width, [1.0] * width, [0.0] * width, 0.0)
    stats = held_rows.select(*[
        f(F.col("features")[k]).alias(f"{f.__name__}{k}") for k in range(width) for f in (F.avg, F.stddev_pop)
    ]).first()
    mean, scale = [stats[2 * k] for k in range(width)], [stats[2 * k + 1] or 1.0 for k in range(width)]
    standard = F.transform("features", lambda x, i: (x - _at(mean, i)) / _at(scale, i))
    # Slots: about as many as there are documents of label 0; a preferred document meets PAIRS slots.
    slots = max(1, counts[0])
    rows = held_rows.select("label", standard.alias("x"), F.xxhash64("id").alias("h"))
    low = rows.filter("label = 0").select(F.pmod("h", F.lit(slots)).alias("slot"), F.col("x").alias("low"))
    high = rows.filter("label = 1").select("h", F.col("x").alias("high"), F.explode(F.sequence(F.lit(1), F.lit(PAIRS))).alias("turn"))
    high = high.withColumn("slot", F.pmod(F.xxhash64("h", "turn"), F.lit(slots)))
    apart = F.zip_with("high", "low", lambda a, b: a - b)
    signed = high.join(low, "slot").select(apart.alias("d"), F.pmod(F.xxhash64("h", "turn", F.lit("sign")), F.lit(2)).alias("flip"))
    # Not written: the fit itself holds its rows, packed, in memory or on disk.
    pairs = signed.select(
        F.when(F.col("flip") == 1, F.transform("d", lambda x: -x)).otherwise(F.col("d")).alias("d"), (1.0 - F.col("flip")).alias("label")
    )
    fit = LogisticRegression(fitIntercept=False, standardization=False, regParam=RIDGE, maxIter=60)
    weights = [float(w) for w in fit.fit(pairs.select(array_to_vector("d").alias("features"), "label")).coefficients]
    scores = materialize(rows.select(F.aggregate(
        F.zip_with("x", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x
    ).alias("score")))
    around = [order_statistic(scores, "score", rank) for rank in (counts[0] - 1, counts[0])]
    return QualityModel(mean, scale, weights, sum(around) / 2)


def _at(values: list[float], i):
    return F.array(*map(F.lit, values))[i]


def strength(x: list[float], model: QualityModel) -> float:
    """Bradley-Terry strength: the log-odds of being preferred to a text of strength 0."""
    return sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale))


def score_of(x: list[float], model: QualityModel) -> float:
    """PASS at the threshold, above it for stronger texts: a logistic curve in the strength."""
    odds = strength(x, model) - model.threshold + math.log(PASS / (1 - PASS))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """`df` with `score` (0 to 1) and `predicted` (1 from PASS on) of whole texts.

    Null and empty texts and texts of white space score 0: nothing to learn from is no quality. Every row stays,
    repeated rows included; columns named like the results are replaced.
    """

    def run(texts: list[str | None]) -> dict:
        scores = [score_of(features(t), model) if t and not t.isspace() else 0.0 for t in texts]
        return {"score": scores, "predicted": [int(s >= PASS) for s in scores]}

    return with_text_columns(df, text, run, "score: double, predicted: int")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its quality, learnt from labels that are not held out."""
    model = learn_quality(docs, labels)
    found = score_quality(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
