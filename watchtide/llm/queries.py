"""Queries of the training-data operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.llm import importance_resampling, maxscore_search, vector_codes
from watchtide.llm.cross_polytope import similar_vectors
from watchtide.llm.language_id import language_query
from watchtide.llm.pairwise_quality import quality_query
from watchtide.llm.piece_codec import piece_digests
from watchtide.llm.sentence_spans import ORACLE, remove_repeats
from watchtide.llm.simhash_vptree import simhash_components
from watchtide.llm.source_mixing import mix_sources, oracle
from watchtide.llm.texts import prepare_texts
from watchtide.llm.token_counts import count_tokens
from watchtide.llm.toxic_segments import toxicity_query
from watchtide.llm.vptree_search import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query over the tables of a folder; without `sql` it is tested against a brute-force version."""

    def add(build: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_texts(spark)
            return build(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query("op1_language_id")
def op1_language_id(spark, table):
    return language_query(table("documents"))


@query("op2_source_mixing", sql=oracle())
def op2_source_mixing(spark, table):
    found = mix_sources(table("documents").select("doc_id", "text", "source", "lang"))
    return found.select(
        "doc_id", "source", "lang", "topic", "tokens",
        F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "sampled",
    )


@query("op3_simhash_neardup")
def op3_simhash_neardup(spark, table):
    return simhash_components(table("documents").select("doc_id", "text"))


@query("op4_token_counts")
def op4_token_counts(spark, table):
    found = count_tokens(table("documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op5_cross_polytope")
def op5_cross_polytope(spark, table):
    return similar_vectors(table("embeddings"))


@query("op6_toxic_segments")
def op6_toxic_segments(spark, table):
    return toxicity_query(table("documents"), table("labels"))


@query("op7_sentence_spans", sql=ORACLE)
def op7_sentence_spans(spark, table):
    found = remove_repeats(table("documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", "text")


@query("op8_piece_codec")
def op8_piece_codec(spark, table):
    found = piece_digests(table("documents").select("doc_id", "text"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op9_pairwise_quality")
def op9_pairwise_quality(spark, table):
    return quality_query(table("documents"), table("labels"))


@query("op10_vptree_search")
def op10_vptree_search(spark, table):
    return nearest(table("embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_importance_resampling", sql=importance_resampling.ORACLE)
def op11_importance_resampling(spark, table):
    found = importance_resampling.resample(table("documents"), table("benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_maxscore_search", sql=maxscore_search.oracle())
def op12_maxscore_search(spark, table):
    return maxscore_search.top_products(table("embeddings"), F.col("vec_id") % 50 == 0)


@query("op13_vector_codes", sql=vector_codes.oracle())
def op13_vector_codes(spark, table):
    codes, _books = vector_codes.compress(table("embeddings"))
    return codes
