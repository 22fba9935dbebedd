"""SentencePiece encoding and decoding of merge-type vocabularies, by an agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
import re
import string
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from watchtide.llm.ragged_merges import PairTable, merge_in_step
from watchtide.llm.texts import WordMemo, runs, with_text_columns

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
CHUNK_CHARS = 500_000
CHUNK_WORDS = 100_000
ROOM = 10_000_000
LINES = 32  # parts per text of the check
LONG_PART = 64  # symbols; longer parts keep their agenda in a heap


class PieceCodec:
    """Encodes by merges of highest score first (leftmost on ties), and decodes; both checked against the library."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.vocab_size())
        self.pieces = [lib.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in ids) or lib.encode(" ") == lib.encode(""):
            raise ValueError("unused pieces and models that trim white space are not supported")
        scores = {i: lib.get_score(i) for i in plain}
        place = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.cost = {self.pieces[i]: place[scores[i]] for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in ids if lib.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.value = {i: b for b, i in self.byte.items()}
        # No merge can span a place that no piece spans, so texts are cut there and their parts merged on their own:
        # before white space, around line ends, and between a Latin letter and most marks.
        spans = {self.pieces[i][at:at + 2] for i in plain for at in range(len(self.pieces[i]) - 1)}
        after_letter = {pair[1] for pair in spans if re.match(f"[{LATIN}]", pair)}
        marks = re.escape("".join(c for c in string.punctuation if c not in after_letter)) or "\n"
        self.in_parts = not any((b == SPACE and a != SPACE) or "\n" in (a, b) for a, b in spans)
        self.parts = re.compile(
            rf"{SPACE}*[^{SPACE}{LATIN}\n]*(?:[{LATIN}]+(?:[^{SPACE}{LATIN}{marks}\n][^{SPACE}\n]*)?|\n+)"
            rf"|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
        )
        # Symbols are piece ids; a character that is no piece is numbered behind them.
        self.width = len(self.pieces) + 0x110000
        self.symbol = np.arange(0x110000) + len(self.pieces)
        singles = [i for i in plain if len(self.pieces[i]) == 1]
        self.symbol[[ord(self.pieces[i]) for i in singles]] = singles
        number = lambda s: self.id.get(s) if len(s) > 1 else int(self.symbol[ord(s)])
        cuts = [(p[:k], p[k:], p) for p in self.id if len(p) > 1 for k in range(1, len(p))]
        pairs = [(number(a), number(b), self.cost[p], self.id[p]) for a, b, p in cuts]
        pairs = np.array([pair for pair in pairs if None not in pair], dtype=np.int64)
        self.table = PairTable(*pairs.T, self.width)
        self.names = list(map(str, ids))
        self.line_end = self.agenda("\n")
        self.memo = WordMemo(self._parts, room=ROOM)

    def agenda(self, word: str) -> list[int]:
        """Ids of one run of symbols (white space written as U+2581)."""
        symbols: list[str | None] = list(word)
        n, cost = len(symbols), self.cost
        pairs = enumerate(map(str.__add__, symbols, symbols[1:]))
        agenda = [(cost[pair], i, 2) for i, pair in pairs if pair in cost]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _cost, left, size = heappop(agenda)
            a = symbols[left]
            if a is None or (right := after[left]) == n or len(a) + len(symbols[right]) != size:
                continue  # one of the two has been merged since
            symbols[left] = merged = a + symbols[right]
            symbols[right] = None
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                pair = merged + symbols[nxt]
                if pair in cost:
                    heappush(agenda, (cost[pair], left, len(pair)))
            if (prev := before[left]) >= 0:
                pair = symbols[prev] + merged
                if pair in cost:
                    heappush(agenda, (cost[pair], prev, len(pair)))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                if s in self.id:
                    ids.append(self.id[s])
                else:
                    ids.extend(self.byte[b] for b in s.encode("utf-8"))
        return ids

    def surface(self, ids: list[int]) -> str:
        """Text of a run of ids, its leading white space included."""
        if not any(map(self.value.__contains__, ids)):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        parts, raw = [], bytearray()
        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(self.pieces[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ")

    def agendas(self, words: list[str]) -> list[list[int]]:
        """Ids of each run of symbols: the agendas of short runs are arrays that all advance together."""
        short = [w for w in words if len(w) <= LONG_PART]
        owner = np.repeat(np.arange(len(short)), np.fromiter(map(len, short), np.int64, len(short)))
        symbols = self.symbol[np.frombuffer("".join(short).encode("utf-32-le"), np.uint32)]
        symbols, owner = merge_in_step(symbols, owner, self.table, together=False)
        ends = np.cumsum(np.bincount(owner, minlength=len(short))).tolist()
        flat, known = symbols.tolist(), len(self.pieces)
        found = iter([flat[a:b] for a, b in zip([0, *ends], ends)])
        out = [next(found) if len(w) <= LONG_PART else self.agenda(w) for w in words]
        if len(symbols) and symbols.max() >= known:
            out = [self._in_bytes(ids) if max(ids) >= known else ids for ids in out]
        return out

    def _in_bytes(self, symbols: list[int]) -> list[int]:
        known, ids = len(self.pieces), []
        for s in symbols:
            ids += [s] if s < known else [self.byte[b] for b in chr(s - known).encode("utf-8")]
        return ids

    def _parts(self, parts: list[str]) -> list[str]:
        """Ids of each part, as decimals joined by commas; the library checks them, in lines of short texts."""
        found = self.agendas(parts)
        lines = list(map(self.surface, found))
        if lines != [p.replace(SPACE, " ") for p in parts]:
            raise ValueError("a part does not decode to itself")
        texts, wanted, start = [], [], self.library.encode("\n")[: -len(self.line_end)]
        for at in range(0, len(parts), LINES):
            texts.append("\n" + "\n".join(lines[at:at + LINES]))
            wanted.append(start + [i for own in found[at:at + LINES] for i in (*self.line_end, *own)])
        if self.library.encode(texts, num_threads=1) != wanted or self.library.decode(wanted, num_threads=1) != texts:
            raise ValueError("the agenda's pieces differ from the library's")
        return [",".join([self.names[i] for i in own]) for own in found]

    def _whole(self, text: str) -> tuple[str, str]:
        ids = self.agenda(SPACE + text.replace(" ", SPACE)) if text else []
        shown = self.surface(ids)[1:]
        if self.library.encode(text) != ids or self.library.decode(ids) != shown:
            raise ValueError("the agenda's pieces differ from the library's")
        return ",".join(map(str, ids)), shown

    def code(self, texts: list[str]) -> list[tuple[str, str]]:
        """Per text: its ids, as decimals joined by commas, and the text that they decode to."""
        if not self.in_parts:
            return list(map(self._whole, texts))
        out: list[tuple[str, str]] = []
        for part in runs(map(len, texts), CHUNK_CHARS):
            marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts[part]]
            if len(marked) == 1 and len(marked[0]) > CHUNK_CHARS:
                out.append(self._long(marked[0]))
                continue
            split = list(map(self.parts.findall, marked))
            known = self.memo.of(set().union(*split))
            # Each part was checked to decode to itself, so their texts do.
            out += [(",".join([known[p] for p in own]), m.replace(SPACE, " ")[1:]) for own, m in zip(split, marked)]
        return out

    def _long(self, marked: str) -> tuple[str, str]:
        found, ids = (m.group() for m in self.parts.finditer(marked)), []
        while own := list(islice(found, CHUNK_WORDS)):
            known = self.memo.of(set(own))
            ids.append(",".join([known[p] for p in own]))
        return ",".join(ids), marked.replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(df: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids") -> DataFrame:
    """`df` with an array column of the piece ids of each text (no begin or end ids).

    A null text counts as empty and gives an empty array. Every row stays; a column of the same name is replaced.
    """

    def run(texts: list[str | None]) -> dict:
        coded = piece_codec(model).code([t or "" for t in texts])
        return {ids: [[int(i) for i in joined.split(",")] if joined else [] for joined, _shown in coded]}

    return with_text_columns(df, text, run, f"{ids}: array<int>")


def piece_digests(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """`df` with `n_tokens`, `ids_sha256` and `decoded_sha256` of each text encoded and decoded again.

    Same answers as the sentencepiece library; each batch checks its new words against it and fails on a
    difference. A null text counts as empty: no ids, digests of the empty string. Every row stays, repeated
    rows included; columns named like the three results are replaced.
    """

    def run(texts: list[str | None]) -> dict:
        coded = piece_codec(model).code([t or "" for t in texts])
        digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        return {
            "n_tokens": [joined.count(",") + 1 if joined else 0 for joined, _shown in coded],
            "ids_sha256": [digest(joined) for joined, _shown in coded],
            "decoded_sha256": [digest(shown) for _joined, shown in coded],
        }

    return with_text_columns(df, text, run, "n_tokens: bigint, ids_sha256: string, decoded_sha256: string")
