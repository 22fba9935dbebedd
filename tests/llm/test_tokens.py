"""Token counts and piece ids against the libraries, edge cases included."""

import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from watchtide.llm.piece_codec import MODEL, PieceCodec, encode_pieces, piece_codec, piece_digests
from watchtide.llm.token_counts import VOCABULARY, count_tokens, merge_ranks

ODD = [
    None, "", " ", "  a", "a ", "a\x00b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<s> </s> <unk> <0x41>", "▁a▁ ▁",
    "😀 é́ ﬁ Ａ １２ ²", "a　b\xa0c\x85d\x1ce", "\r\n\t x\n\n", "aaaaaaaaaaaaa" * 40, "日本語テスト" * 30, " " * 500, "don't l'été. A.B,c!",
]
LONG = "wherein thatß " * 60_000 + "z" * 3000
ALPHABET = st.text(st.sampled_from(list("aab e\n\t.,!'é▁😀日<|endoftext|>0")) | st.characters(exclude_categories=["Cs"]), max_size=60)


def library_counts(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(documents):
    rows = [(i, t) for i, t in enumerate([*ODD, LONG, ODD[9], ODD[9]])] + [(None, "a b")]
    got = count_tokens(documents(rows).withColumn("N_TOKENS", F.lit("clash"))).collect()
    want = dict(zip([r[0] for r in rows], library_counts([r[1] for r in rows])))
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["n_bytes"] == len((r["text"] or "").encode()) for r in got)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_counts_of_the_table_equal_the_library(texts_session):
    got = count_tokens(texts_session.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert [r["n_tokens"] for r in got] == library_counts([r["text"] for r in got])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=8))
def test_any_text_counts_as_in_the_library(texts):
    assert merge_ranks(VOCABULARY).count(texts) == library_counts(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=8))
def test_any_text_has_the_librarys_pieces(texts):
    codec = piece_codec(MODEL)
    ids = codec.library.encode(texts)
    assert codec.code(texts) == [(",".join(map(str, i)), codec.library.decode(i)) for i in ids]
    assert [codec._whole(t) for t in texts] == codec.code(texts)


def test_heap_and_array_agendas_agree():
    codec = PieceCodec(MODEL)
    words = ["▁wherein", "▁▁▁▁▁a", "ßßß", "▁internationalization", "日本"]
    assert codec.agendas(words) == list(map(codec.agenda, words))


def test_digests_equal_the_library(documents):
    rows = [(i, t) for i, t in enumerate([*ODD, LONG, ODD[9]])]
    got = {r["doc_id"]: r for r in piece_digests(documents(rows)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, text in rows:
        ids = library.encode(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_ids_themselves(documents):
    got = {r["doc_id"]: r["ids"] for r in encode_pieces(documents([(1, "a  b"), (2, None)])).collect()}
    assert got == {1: [264, 28705, 287], 2: []}


def test_empty_tables(documents):
    assert count_tokens(documents([])).collect() == []
    assert piece_digests(documents([])).collect() == []
