"""Language identification: unigram piece models, one per language, with all segmentations of a word summed."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.labelled import draw, held_out
from watchtide.llm.ragged_merges import PairTable
from watchtide.llm.texts import LATIN, LATIN_TEXT, WordMemo, runs, with_text_columns
from watchtide.session import materialize

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
PER_LANGUAGE = 2000  # documents learnt from, per language
MODEL_NUMBERS = 1 << 25  # pieces x languages, 256 MB in doubles; the vocabulary of 23,948 pieces allows 1,401 languages
ROUNDS = 3  # of expectation maximisation
PRIOR = 0.01  # pseudo-count of a piece
WORD = regex.compile(r"\p{L}+")
LATIN_WORD = re.compile(rf"[{LATIN}]+")
LESSON = 4096  # letters; learning takes longer runs in parts, scoring never does
LETTERS = 200_000  # in one lattice of at most eight languages; fewer where there are more
TINY = 1e-200  # sums of products below it are done again with logarithms
CHUNK_CHARS = 1_000_000
COLUMNS = 16  # languages summed at once over the words of texts
UNKNOWN = "und"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Letter pieces by number, word starts marked by U+2581."""
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (lib.id_to_piece(i).lower() for i in range(lib.vocab_size()))
    letters = dict.fromkeys(p for p in pieces if WORD.fullmatch(p.removeprefix("▁")) or p == "▁")
    return {p: n for n, p in enumerate(letters)}


@lru_cache(maxsize=2)
def beginnings(path: str) -> tuple[PairTable, np.ndarray]:
    """From one beginning of a piece by one letter more to the next (0: the empty one), and the piece that each
    beginning is (-1: none)."""
    table = vocabulary(path)
    states = {"": 0}
    for piece in table:
        for n in range(1, len(piece) + 1):
            states.setdefault(piece[:n], len(states))
    steps = [(states[s[:-1]], ord(s[-1]), n) for s, n in states.items() if s]
    left, right, result = np.array(steps, np.int64).T
    return PairTable(left, right, np.zeros(len(steps), np.int64), result, 0x110000), np.array([table.get(s, -1) for s in states])


def log_sums(terms: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exp(terms) of the rows from each place of `cut` to the next."""
    top = np.maximum.reduceat(terms, cut, axis=0)
    sizes = np.diff(np.r_[cut, len(terms)])
    return top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, sizes, axis=0)), cut, axis=0))


class Lattice:
    """All segmentations of a batch of words into pieces; a character that is no piece is an unknown piece.

    Sums of plain products are exact enough until they near the smallest double. `logs` takes logarithms of the
    probabilities instead and gives logarithms of the sums, for words of any length.
    """

    def __init__(self, words: list[str], path: str, mark: str = "▁"):
        step, piece_of = beginnings(path)
        marked = [mark + w for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(marked)), sizes)
        letter_ends = np.cumsum(sizes)
        # A word of n letters has n + 1 nodes; letter i of all lies between nodes i + owner and i + owner + 1.
        self.starts, self.ends = letter_ends - sizes + np.arange(len(marked)), letter_ends + np.arange(len(marked))
        self.nodes = int(sizes.sum()) + len(marked)
        self.depth = np.arange(self.nodes) - np.repeat(self.starts, sizes + 1)
        at, state, n = np.arange(len(letters)), np.zeros(len(letters), np.int64), 0
        first, last, piece = [], [], []
        while len(at):  # all places read one letter more, while that begins a piece
            alive, state = step.find(state, letters[at + n])
            n += 1
            if n == 1:
                single = piece_of[state]
                odd = at[(alive != 0) | (single < 0)]
                first.append(odd + owner[odd]), last.append(odd + owner[odd] + 1), piece.append(np.full(len(odd), len(vocabulary(path))))
            at, state = at[alive == 0], state[alive == 0]
            whole = piece_of[state] >= 0
            begin = at[whole] + owner[at[whole]]
            first.append(begin), last.append(begin + n), piece.append(piece_of[state[whole]])
            more = at + n < letter_ends[owner[at]]
            at, state = at[more], state[more]
        self.first, self.last, self.piece = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (first, last, piece))
        order = np.argsort(self.first, kind="stable")
        self.first, self.last, self.piece = self.first[order], self.last[order], self.piece[order]

    def _sweep(self, p, at, to, value: np.ndarray, back: bool, logs: bool) -> np.ndarray:
        """Adds up piece probabilities from the word's one end, whose nodes `value` has, layer by layer."""
        layer = self.depth[to] if not back else -self.depth[to]
        order = np.lexsort((to, layer))
        bounds = np.flatnonzero(np.diff(layer[order])) + 1
        for part in np.split(order, bounds):
            if len(part):
                target = to[part]
                cut = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
                if logs:
                    value[target[cut]] = log_sums(value[at[part]] + p[self.piece[part]], cut)
                else:
                    value[target[cut]] = np.add.reduceat(value[at[part]] * p[self.piece[part]], cut, axis=0)
        return value

    def _nodes(self, p: np.ndarray, init: np.ndarray, logs: bool) -> np.ndarray:
        value = np.full((self.nodes, p.shape[1]), -np.inf if logs else 0.0)
        value[init] = 0.0 if logs else 1.0
        return value

    def forward(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        return self._sweep(p, self.first, self.last, self._nodes(p, self.starts, logs), back=False, logs=logs)

    def likelihood(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        """Probability of each word in each language, all segmentations summed."""
        return self.forward(p, logs)[self.ends]

    def go_on(self, known: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Logarithms of the forward sums of a single word of which those of the first nodes are `known`."""
        new = self.last >= len(known)
        self.first, self.last, self.piece = self.first[new], self.last[new], self.piece[new]
        value = np.full((self.nodes, log_p.shape[1]), -np.inf)
        value[:len(known)] = known
        return self._sweep(log_p, self.first, self.last, value, back=False, logs=True)

    def expected(self, p: np.ndarray, counts: np.ndarray, logs: bool = False) -> np.ndarray:
        """Expected uses of each piece in each language, for words seen `counts` times."""
        ahead = self.forward(p, logs)
        behind = self._sweep(p, self.last, self.first, self._nodes(p, self.ends, logs), back=True, logs=logs)
        owner = np.searchsorted(self.starts, self.first, side="right") - 1
        if logs:
            share = np.exp(ahead[self.first] + p[self.piece] + behind[self.last] - ahead[self.ends][owner])
            use = share * counts[owner]
        else:
            weight = counts / ahead[self.ends]
            use = ahead[self.first] * p[self.piece] * behind[self.last] * weight[owner]
        total = np.zeros_like(p)
        order = np.argsort(self.piece, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(self.piece[order]) != 0])
        if len(order):
            total[self.piece[order][cut]] = np.add.reduceat(use[order], cut, axis=0)
        return total


def room(p: np.ndarray) -> int:
    """Letters of one lattice, such that its numbers stay within some ten MB."""
    return max(1024, LETTERS * 8 // max(8, p.shape[1]))


def log_likelihoods(words: list[str], p: np.ndarray, path: str) -> np.ndarray:
    """Logarithm of the probability of each word in each language, all segmentations of the whole word summed."""
    found = np.empty((len(words), p.shape[1]))
    log_p = np.log(p)
    for part in runs(map(len, words), room(p)):
        some = words[part]
        if len(some[0]) > room(p):  # alone in its part
            found[part] = _long_word(some[0], log_p, path)
            continue
        plain = Lattice(some, path).likelihood(p)
        tiny = np.flatnonzero((plain < TINY).any(axis=1))
        logs = np.log(np.maximum(plain, TINY))
        if len(tiny):
            logs[tiny] = Lattice([some[n] for n in tiny], path).likelihood(log_p, logs=True)
        found[part] = logs
    return found


def _long_word(word: str, log_p: np.ndarray, path: str) -> np.ndarray:
    """One word in windows: a forward sum needs only those of as many nodes before it as the longest piece has letters."""
    reach, size, marked = max(map(len, vocabulary(path))), room(log_p), "▁" + word
    known = np.zeros((1, log_p.shape[1]))
    for at in range(0, len(marked), size):
        lead = len(known) - 1
        known = Lattice([marked[at - lead:at + size]], path, mark="").go_on(known, log_p)[-reach - 1:]
    return known[-1]


def expected_uses(words: list[str], p: np.ndarray, counts: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece in each language, for words of a bounded length seen `counts` times."""
    total, log_p = np.zeros_like(p), np.log(p)
    for part in runs(map(len, words), room(p) // 4):
        some, seen = words[part], counts[part]
        lattice = Lattice(some, path)
        tiny = (lattice.likelihood(p) < TINY).any(axis=1)
        if not tiny.any():
            total += lattice.expected(p, seen)
            continue
        for logs in (False, True):
            at = np.flatnonzero(tiny == logs)
            if len(at):
                total += Lattice([some[n] for n in at], path).expected(log_p if logs else p, seen[at], logs)
    return total


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, whole whatever their length."""
    return (LATIN_WORD if LATIN_TEXT.fullmatch(text) else WORD).findall(text.lower())


class PieceModels:
    """Languages and the probability of each piece in each of them."""

    def __init__(self, languages: list[str], probability: np.ndarray, path: str):
        self.languages, self.probability, self.path = languages, probability, path
        self.key = uuid.uuid4().hex

    def log_likelihood(self, words: list[str]) -> list[tuple[float, ...]]:
        return [tuple(row) for row in log_likelihoods(words, self.probability, self.path).tolist()]

    def predict(self, texts: list[str | None], memo: WordMemo) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for part in runs((len(t or "") for t in texts), CHUNK_CHARS):
            split = [words_of(t) if t else [] for t in texts[part]]
            distinct = list(set().union(*split))
            if not distinct or not self.languages:
                continue
            known = memo.of(set(distinct))
            value = np.array([known[w] for w in distinct])
            place = dict(zip(distinct, range(len(distinct))))
            at = np.fromiter((place[w] for words in split for w in words), np.int64)
            spoken = [n for n, words in enumerate(split) if words]
            starts = np.cumsum([0, *(len(split[n]) for n in spoken[:-1])])
            blocks = (value[:, n:n + COLUMNS] for n in range(0, len(self.languages), COLUMNS))
            total = np.concatenate([np.add.reduceat(block[at], starts, axis=0) for block in blocks], axis=1)
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for n, b, s in zip(spoken, best.tolist(), score.tolist()):
                names[part.start + n], scores[part.start + n] = self.languages[b], s
        return names, scores


_memos: dict[str, WordMemo] = {}


def _memo(models: PieceModels) -> WordMemo:
    """The worker's memo of these models; that of earlier models is forgotten."""
    if models.key not in _memos:
        _memos.clear()
        _memos[models.key] = WordMemo(models.log_likelihood, room=20_000_000 // max(4, len(models.languages)))
    return _memos[models.key]


def learn_languages(
    docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", text: str = "text", path: str = VOCABULARY
) -> PieceModels:
    """One piece model per language from about PER_LANGUAGE documents of each, by expectation maximisation.

    Rows with a null text or language teach nothing. Runs of more than LESSON letters teach in parts of that
    length. Each round's sums over the sample are a Spark job; only pieces x languages numbers reach the driver.
    A model holds at most MODEL_NUMBERS of them (1,401 languages with the default vocabulary); more languages are
    an error, since no worker could hold their models.
    """
    size = len(vocabulary(path)) + 1
    known = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    drawn = draw(known.filter("lang IS NOT NULL AND text IS NOT NULL"), "id", "lang", PER_LANGUAGE, "language", MODEL_NUMBERS // size)
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{LESSON}}}"), F.lit(0)))
    tally = drawn.select("lang", word.alias("word")).groupBy("lang", "word").count()
    languages = sorted(r[0] for r in drawn.select("lang").distinct().collect())
    probability = np.full((size, max(1, len(languages))), 1.0 / size)
    if not languages:
        return PieceModels([], probability, path)
    # a word has at most one entry of each language
    words = materialize(tally.groupBy("word").agg(F.collect_list("lang").alias("langs"), F.collect_list("count").alias("counts")))
    column = {v: n for n, v in enumerate(languages)}
    for _round in range(ROUNDS):
        p = probability

        def expect(batches, p=p):
            total = np.zeros_like(p)
            for batch in batches:
                seen = np.zeros((len(batch), len(languages)))
                for n, (langs, counts) in enumerate(zip(batch["langs"], batch["counts"])):
                    seen[n, [column[v] for v in langs]] = counts
                total += expected_uses(batch["word"].tolist(), p, seen, path)
            piece, language = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "language": language, "uses": total[piece, language]})

        uses = words.mapInPandas(expect, "piece bigint, language bigint, uses double")
        total = np.full_like(p, PRIOR)
        for row in uses.groupBy("piece", "language").agg(F.sum("uses")).toLocalIterator():
            total[row[0], row[1]] += row[2]
        probability = total / total.sum(axis=0)
    return PieceModels(languages, probability, path)


def identify_languages(df: DataFrame, models: PieceModels, text: str = "text") -> DataFrame:
    """`df` with `lang_pred`, the learnt language under which the whole text is likeliest, and `score`, its
    posterior probability among the learnt languages.

    Words are runs of letters in lower case, of any length, taken as independent; each is scored over all its
    segmentations. A null text, a text without a letter, and any
    text when nothing was learnt give `und` with score 0. Every row stays, repeated rows included; columns named
    like the results are replaced.
    """

    def run(texts: list[str | None]) -> dict:
        names, scores = models.predict(texts, _memo(models))
        return {"lang_pred": names, "score": scores}

    return with_text_columns(df, text, run, "lang_pred: string, score: double")


def language_query(docs: DataFrame) -> DataFrame:
    """Every document with its predicted language, learnt from the documents that are not held out."""
    learn = docs.filter(~held_out("doc_id", 3, 1))
    found = identify_languages(docs.select("doc_id", "text"), learn_languages(learn))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
