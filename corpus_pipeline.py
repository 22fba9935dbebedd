"""A training corpus from `documents`, in stages that each write their rows for the next.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns
of `docs` as they came, extra ones included; a stage's own columns never touch them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.llm.piece_codec import piece_digests
from watchtide.llm.sentence_spans import remove_repeats
from watchtide.llm.simhash_vptree import one_of_each
from watchtide.llm.source_mixing import mix_sources
from watchtide.llm.texts import prepare_texts
from watchtide.llm.toxic_segments import learn_toxicity, without_toxic
from watchtide.session import scratch_path

KEPT_TOKENS = 0.5  # share of the tokens that the mixture keeps


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model learnt from those of them that have a label."""
    prepare_texts(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, learn_toxicity(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    prepare_texts(spark)
    return one_of_each(docs)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentence runs that occur before; `n_chars` follows the text. No document goes."""
    prepare_texts(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    held = docs.select("doc_id", "text", F.struct("n_chars", *(F.col(f"`{c}`") for c in others)).alias("held"))
    found = remove_repeats(held)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("held.n_chars"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": n_chars.cast(docs.schema["n_chars"].dataType)}
    return found.select(*((made[c] if c in made else F.col("held").getField(c)).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics take their target shares of the tokens."""
    prepare_texts(spark)
    held = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("held"))
    return mix_sources(held, budget=KEPT_TOKENS).filter("sampled").select("held.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts of each document, and digests of its ids and of the text decoded from them."""
    prepare_texts(spark)
    coded = piece_digests(docs.select("doc_id", "source", "lang", "text"))
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_neardup", drop_near_copies),
    ("substring_dedup", drop_repeated_spans),
    ("source_mixing", mix),
    ("sentencepiece", encode_texts),
]
ORACLE_SQL = None  # learnt scores, fingerprints and piece ids have no SQL; tests/llm says what each stage is held against


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
