"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.llm.labelled import held_out, labelled_sample
from watchtide.llm.texts import per_text, with_text_columns
from watchtide.session import materialize

PER_LABEL = 4000  # labelled documents learnt from, per label
PRIOR = 0.02  # Dirichlet prior: this share of a feature's count in both classes together
LEAST_Z = 4.0
LEAST_WEIGHT = 1.5  # log-odds of a feature's share of all tokens
FEATURES = 20_000  # at most
STEMS = (4, 5, 6, 7)  # a word also counts as its first letters
FILLER = -0.1  # score of a token that says nothing
SIGNIFICANT = 0.05  # expected number of chance segments in a text, below which a segment counts
WORD = regex.compile(r"\p{L}+")
CHUNK_WORDS = 200_000


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of features, the decay and size constants of chance segments, and the evidence at score 0.5."""

    weights: dict[str, float]
    decay: float
    size: float
    turn: float


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass.

    Each is the best of every stretch that holds it and no other; they do not overlap. The scan keeps candidate
    segments with the sums before and after them, and for each the nearest earlier candidate with a lower sum before
    it. A new one looks back along that chain to the first candidate with a lower sum before than its own; it takes
    that in while the sum after that is lower too. Candidates passed over or taken in are not met again, so the scan
    is linear.
    """
    total = np.cumsum(scores)
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, nearest lower
    for at in np.flatnonzero(scores > 0).tolist():
        after = float(total[at])
        before, start = after - float(scores[at]), at
        place = len(found) - 1
        while place >= 0 and found[place][0] >= before:
            place = found[place][4]
        while place >= 0 and found[place][1] < after:
            before, _after, start, _end, lower = found[place]
            del found[place:]
            place = lower
        found.append((before, after, start, at + 1, place))
    return [(start, end, after - before) for before, after, start, end, _lower in found]


def passages(text: str, model: ToxicityModel) -> tuple[list[tuple[int, int, float]], int]:
    """Significant segments (first token, token after the last, evidence) of a text, and its number of tokens.

    The evidence is minus the logarithm of the number of segments as good that chance would put into the text.
    """
    spread = lambda w: (w, *(w[:n] + "*" for n in STEMS if len(w) >= n))
    known, get = {}, model.weights.get
    words = WORD.findall(text.lower())
    for w in set(words):
        best = max((get(f, 0.0) for f in spread(w)), default=0.0)
        if best > 0:
            known[w] = best
    if not known:
        return [], len(words)
    scores = np.fromiter((known.get(w, FILLER) for w in words), np.float64, len(words))
    chance = math.log(model.size * len(words))
    found = [(a, b, model.decay * s - chance) for a, b, s in segments(scores)]
    return [f for f in found if f[2] > -math.log(SIGNIFICANT)], len(words)


def evidence(text: str, model: ToxicityModel) -> float:
    """Evidence of all significant segments of a text together: r of them count as one of their summed score,
    with the price of having chosen them in any order (log r!)."""
    found, _n = passages(text, model)
    best = total = 0.0
    for r, (_a, _b, e) in enumerate(sorted(found, key=lambda f: -f[2]), start=1):
        total += e
        best = max(best, total - math.lgamma(r + 1))
    return best


def score_of(weight: float, turn: float) -> float:
    """Evidence as a score: 0 without any, 0.5 at `turn`, towards 1 beyond."""
    return weight / (weight + turn)


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text: str = "text"
) -> ToxicityModel:
    """Features that toxic documents use more, from about PER_LABEL documents of each label.

    A feature is a word in lower case or its first 4 to 7 letters. Counts of a class are smoothed by a Dirichlet
    prior in proportion to the feature's count in both. A feature is kept if the log-odds of documents that hold
    it are LEAST_Z standard errors above zero (so a burst in one document proves nothing), and weighs the log-odds
    of its share of all tokens, LEAST_WEIGHT at least. Without documents of both labels nothing is learnt and every score is 0.
    """
    sample = labelled_sample(docs, labels, "toxic", id_col, text, ~held_out(id_col, folds, held), PER_LABEL, "toxic")
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    nothing = ToxicityModel({}, 1.0, 1.0, 1.0)
    if len(n) < 2:
        return nothing
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counted = sample.select("id", "label", words.alias("word")).groupBy("id", "label", "word").count()
    stems = [F.when(F.length("word") >= k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    held = counted.select("id", "label", "count", F.explode(F.array_compact(F.array("word", *stems))).alias("feature"))
    held = held.groupBy("id", "label", "feature").agg(F.sum("count").alias("uses"))
    seen = held.groupBy("feature").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"),
        F.sum(F.col("label") * F.col("uses")).alias("bad_uses"), F.sum((1 - F.col("label")) * F.col("uses")).alias("good_uses"),
    ).filter("bad > 1")
    size = {r[0]: r[1] for r in counted.groupBy("label").agg(F.sum("count")).collect()}
    odds, error = _log_odds("bad", "good", n[1], n[0])
    by_use, _error = _log_odds("bad_uses", "good_uses", size.get(1, 1), size.get(0, 1))
    ranked = seen.select("feature", (odds / error).alias("z"), by_use.alias("weight")).filter(
        (F.col("z") > LEAST_Z) & (F.col("weight") > LEAST_WEIGHT)
    ).orderBy(F.desc("z"), "feature").limit(FEATURES)
    weights = {r["feature"]: r["weight"] for r in ranked.collect()}
    return _calibrate(sample, weights) if weights else nothing


def _log_odds(bad: str, good: str, all_bad: int, all_good: int) -> tuple[Column, Column]:
    """Log-odds ratio of two counts under the prior, and its standard error."""
    prior = PRIOR * (F.col(bad) + F.col(good))
    y1, y0 = F.col(bad) + prior, F.col(good) + prior
    odds = F.log(y1 / (F.lit(all_bad * (1 + PRIOR)) + 1 - y1)) - F.log(y0 / (F.lit(all_good * (1 + PRIOR)) + 1 - y0))
    return odds, F.sqrt(1 / y1 + 1 / y0)


def _calibrate(sample: DataFrame, weights: dict[str, float]) -> ToxicityModel:
    """Extreme-value constants from the clean documents, and the evidence that separates the labels best.

    The decay solves E[exp(decay * score)] = 1 over tokens of clean documents, counting one chance token more
    than was seen so that it always exists; the size constant is the share of tokens that can begin a segment.
    """
    held = materialize(with_text_columns(sample, "text", lambda texts: _tallies(texts, weights), "tokens: bigint, hits: bigint, worth: double"))
    clean = held.filter("label = 0").agg(F.sum("tokens"), F.sum("hits"), F.sum("worth")).first()
    tokens, hits, worth = (float(x or 0) for x in clean)
    typical = float(np.mean(list(weights.values())))
    share = min(0.2, (hits + 1) / (tokens + 2))
    gain = (worth + typical) / (hits + 1)
    low, high = 1e-6, 50.0
    for _step in range(80):  # share * e^(decay gain) + (1 - share) * e^(decay filler) = 1
        mid = (low + high) / 2
        if share * math.exp(min(700.0, mid * gain)) + (1 - share) * math.exp(mid * FILLER) < 1:
            low = mid
        else:
            high = mid
    first = ToxicityModel(weights, low, max(share, 1e-6), 1.0)
    weighed = with_text_columns(held.select("label", "text"), "text", lambda texts: {"weight": [evidence(t or "", first) for t in texts]}, "weight: double")
    rows = weighed.select("label", "weight").collect()  # at most about 2 x PER_LABEL numbers
    label, weight = (np.array([r[k] for r in rows], float) for k in (0, 1))
    cuts = np.unique(weight)
    turns = np.r_[(cuts[:-1] + cuts[1:]) / 2, -math.log(SIGNIFICANT)]
    turns = turns[turns > 0]
    wrong = [np.mean(weight[label == 1] < t) + np.mean(weight[label == 0] >= t) for t in turns]
    return ToxicityModel(weights, low, max(share, 1e-6), float(turns[int(np.argmin(wrong))]))


def _tallies(texts: list[str | None], weights: dict[str, float]) -> dict:
    out = {"tokens": [], "hits": [], "worth": []}
    for text in texts:
        words = WORD.findall((text or "").lower())
        best = [max(weights.get(f, 0.0) for f in (w, *(w[:n] + "*" for n in STEMS if len(w) >= n))) for w in words]
        out["tokens"].append(len(words))
        out["hits"].append(sum(b > 0 for b in best))
        out["worth"].append(float(sum(best)))
    return out


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """`df` with `score` (0 to 1) and `predicted` (1 from `threshold` on) of whole texts.

    Null texts, empty texts and texts without a letter score 0. Every row stays, repeated rows included; columns
    named like the results are replaced.
    """

    def run(texts: list[str | None]) -> dict:
        scores = [score_of(evidence(t, model), model.turn) if t else 0.0 for t in texts]
        return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return with_text_columns(df, text, run, "score: double, predicted: int")


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `threshold`, columns as they are; null and empty texts stay."""

    def run(texts: list[str | None]) -> dict:
        return {"keep": [not t or score_of(evidence(t, model), model.turn) < threshold for t in texts]}

    return docs.withColumn("__toxicity", per_text(F.col(text), run, "keep: boolean")).filter("__toxicity.keep").drop("__toxicity")


def toxic_passages(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """`df` with arrays `starts`, `ends` (token positions) and `weights` of its significant passages, in order."""

    def run(texts: list[str | None]) -> dict:
        found = [sorted(passages(t, model)[0]) if t else [] for t in texts]
        return {name: [[f[k] for f in own] for own in found] for k, name in enumerate(("starts", "ends", "weights"))}

    return with_text_columns(df, text, run, "starts: array<bigint>, ends: array<bigint>, weights: array<double>")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its toxicity, learnt from labels that are not held out."""
    model = learn_toxicity(docs, labels)
    found = score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
