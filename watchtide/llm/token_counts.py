"""Token counts of byte-level merge vocabularies: batches of pre-tokens merged rank by rank in numpy."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from watchtide.llm.ragged_merges import PairTable, merge_in_step
from watchtide.llm.texts import LATIN, LATIN_TEXT, WordMemo, runs, with_text_columns

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 1024
PRE_TOKENS = regex.compile(public_tokenizers.PATTERN)
# The same pattern for texts of the usual Latin letters, which the quicker library can be given as a class.
LATIN_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
CHUNK_CHARS = 1_000_000
CHUNK_WORDS = 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the rest takes the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def pre_tokens(text: str) -> list[str]:
    return (LATIN_PRE_TOKENS if LATIN_TEXT.fullmatch(text) else PRE_TOKENS).findall(text)


class MergeRanks:
    """Ranked pair merges over byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        steps = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level merge vocabulary")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take white space or need word bounds are not supported")
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self.base = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {c: -1 for c in byte_letters()}
        for rank, (a, b) in enumerate(pairs):
            if made[a] >= rank or made[b] >= rank:
                raise ValueError("a merge comes before its parts")
            made.setdefault(a + b, rank)
        left, right = (np.array([vocab[pair[k]] for pair in pairs], dtype=np.int64) for k in (0, 1))
        result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.table = PairTable(left, right, np.arange(len(pairs)), result, max(vocab.values()) + 1)
        self.memo = WordMemo(lambda words: self.symbols_left([w.encode("utf-8") for w in words]), room=6_000_000)

    def symbols_left(self, words: list[bytes]) -> list[int]:
        """How many symbols remain of each (non-empty) word after all merges.

        No merge ranks before the merges that made its parts (checked on loading), so each round may apply a
        word's lowest-ranked pair in all its places.
        """
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        _symbols, owner = merge_in_step(symbols, owner, self.table, together=True)
        return np.bincount(owner, minlength=len(words)).tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        totals = []
        for part in runs(map(len, texts), CHUNK_CHARS):
            specials, chunks = [], []
            for text in texts[part]:
                plain, found = [text], 0
                if self.special is not None and self.special.search(text):
                    plain = self.special.split(text)
                    found = len(plain) - 1
                specials.append(found)
                chunks.append(plain)
            if part.stop - part.start == 1 and len(texts[part.start]) > CHUNK_CHARS:
                totals.append(specials[0] + sum(self._count_long(p) for p in chunks[0]))
                continue
            words = [[w for p in plain for w in pre_tokens(p)] for plain in chunks]
            known = self.memo.of(set().union(*words))
            totals += [n + sum(map(known.__getitem__, own)) for n, own in zip(specials, words)]
        return totals

    def _count_long(self, text: str) -> int:
        found, total = (m.group() for m in PRE_TOKENS.finditer(text)), 0
        while words := list(islice(found, CHUNK_WORDS)):
            known = self.memo.of(set(words))
            total += sum(map(known.__getitem__, words))
        return total


@lru_cache(maxsize=2)
def merge_ranks(path: str) -> MergeRanks:
    return MergeRanks(path)


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """`df` with `n_bytes`, `n_tokens` and `over_limit` (more than `limit` tokens) of a text column.

    Counts equal those of the tokenizers library without begin, end or padding; its special strings inside
    a text count as one token each. A null text counts as empty: 0 bytes, 0 tokens. Every row stays, repeated
    rows included; columns named like the three results are replaced. The vocabulary file is read where the
    texts are, by its path.
    """

    def measure(texts: list[str | None]) -> dict:
        counts = merge_ranks(vocabulary).count([t or "" for t in texts])
        return {
            "n_bytes": [len((t or "").encode("utf-8")) for t in texts],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    return with_text_columns(df, text, measure, "n_bytes: bigint, n_tokens: bigint, over_limit: boolean")
