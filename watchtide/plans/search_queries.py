"""Queries over finding text: chunks, search and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.functions.redact import ENTITIES
from watchtide.operators.keyword_index import add_to_index, keyword_search, search_index
from watchtide.operators.redaction import redact_text, redaction_report
from watchtide.operators.retrieval import chunk_fixed, hybrid_search, vector_topk
from watchtide.operators.vector_index import build_vector_index, recall, rows_read, vector_topk_approx
from watchtide.plans.registry import Inputs, query

TOKENS_SQL = "list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')"
CHUNKS_SQL = f"""
SELECT doc_id, chunk_no, array_to_string(piece, ' ') AS chunk, len(piece) AS chunk_tokens FROM (
  SELECT doc_id, i AS chunk_no, list_slice(tokens, i * 240 + 1, i * 240 + 300) AS piece FROM (
    SELECT doc_id, tokens, unnest(range(0, 1 + CAST(greatest(ceil((len(tokens) - 300) / 240.0), 0) AS BIGINT))) AS i
    FROM (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents) WHERE len(tokens) > 0))
"""


@query("chunk_fixed", CHUNKS_SQL)
def _(t):
    return chunk_fixed(t.table("documents")).withColumns(
        {"chunk_no": F.col("chunk_no").cast("long"), "chunk_tokens": F.col("chunk_tokens").cast("long")}
    )


# The centre of each label is one question, so every vector shapes the questions and is searched.
CENTRES_SQL = """centres AS (
  SELECT label, list(mean ORDER BY pos) AS embedding FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS mean FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"""


def centres(t: Inputs) -> DataFrame:
    """(query_id, embedding): the mean vector of each label."""
    spread = t.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = spread.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("embedding")
    )


def vectors(t: Inputs) -> DataFrame:
    return t.table("embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")


VECTOR_SQL = """SELECT CAST(c.label AS BIGINT) AS query_id, {id} AS chunk_id,
    round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.embedding), 6) AS score FROM {table} e CROSS JOIN centres c"""
RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({}) QUALIFY rank <= {}"


@query(
    "vector_topk",
    f"WITH {CENTRES_SQL} " + RANKED.format(VECTOR_SQL.format(id="CAST(e.vec_id AS VARCHAR)", table="embeddings"), 10),
)
def _(t):
    return vector_topk(vectors(t), centres(t), k=10).withColumn("rank", F.col("rank").cast("long"))


@query("vector_topk_approx")
def _(t):
    """Every hundredth row asks, against all rows; each answer with its recall and the share of codes read for it."""
    path = t.scratch("vector-index")
    build_vector_index(vectors(t), path)
    questions = t.table("embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    near = vector_topk_approx(t.spark, path, questions, k=10)
    exact = vector_topk(vectors(t).filter("embedding IS NOT NULL"), questions.filter("embedding IS NOT NULL"), k=10)
    return near.join(recall(exact, near), "query_id").join(rows_read(t.spark, path, questions), "query_id")


def _bm25_sql(chunks: str, question_sql: str) -> str:
    """BM25 of every (question, chunk) pair that shares a word; the two arguments are subqueries."""
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
  sized AS (SELECT chunk_id, {words.format('chunk')} AS ws FROM ({chunks})),
  totals AS (SELECT count(*) AS n, avg(len(ws)) AS mean_length FROM sized),
  posted AS (SELECT chunk_id, len(ws) AS length, unnest(ws) AS word FROM sized),
  postings AS (SELECT chunk_id, length, word, count(*) AS tf FROM posted GROUP BY ALL),
  holders AS (SELECT word, count(*) AS df FROM postings GROUP BY word),
  asked AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest({words.format('text')}) AS word FROM ({question_sql}))),
  bm25 AS (SELECT a.query_id, p.chunk_id,
      round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
    FROM asked a JOIN postings p USING (word) JOIN holders h USING (word) CROSS JOIN totals GROUP BY ALL)"""


KEYWORD_SQL = (
    "WITH "
    + _bm25_sql(
        f"SELECT CONCAT(CAST(doc_id AS VARCHAR), '#', CAST(chunk_no AS VARCHAR)) AS chunk_id, chunk FROM ({CHUNKS_SQL})",
        "SELECT item_id AS query_id, text FROM benchmark",
    )
    + RANKED.format("SELECT * FROM bm25 WHERE score > 0", 10)
)


def text_chunks(t: Inputs) -> DataFrame:
    return chunk_fixed(t.table("documents")).select(
        "doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "chunk"
    )


def text_questions(t: Inputs) -> DataFrame:
    return t.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("keyword_search", KEYWORD_SQL)
def _(t):
    return keyword_search(text_chunks(t), text_questions(t), k=10).withColumn("rank", F.col("rank").cast("long"))


@query("keyword_index", KEYWORD_SQL)
def _(t):
    """Documents arrive in two loads, the second of which is repeated."""
    path = t.scratch("keyword-index")
    for load, kept in (("even", F.col("doc_id") % 2 == 0), ("odd", F.col("doc_id") % 2 != 0), ("odd", F.col("doc_id") % 2 != 0)):
        add_to_index(text_chunks(t).filter(kept), path, load=load)
    return search_index(t.spark, path, text_questions(t), k=10).withColumn("rank", F.col("rank").cast("long"))


# Each benchmark text asks with the centre of one label as its vector.
QUESTIONS_SQL = "SELECT b.item_id AS query_id, b.text, c.embedding FROM benchmark b JOIN centres c ON c.label = b.item_id % 10"


@query(
    "hybrid_search",
    f", {CENTRES_SQL}, questions AS ({QUESTIONS_SQL}), "
    + _bm25_sql("SELECT chunk_id, chunk FROM chunk_table", "SELECT query_id, text FROM questions")
    + f""", near AS ({RANKED.format('''SELECT q.query_id, e.chunk_id,
        round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.embedding), 6) AS score FROM chunk_table e CROSS JOIN questions q WHERE e.embedding IS NOT NULL''', 50)}),
  said AS ({RANKED.format('SELECT * FROM bm25 WHERE score > 0', 50)}),
  fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60.0 + rank)), 9) AS score
    FROM (SELECT query_id, chunk_id, rank FROM near UNION ALL SELECT query_id, chunk_id, rank FROM said) GROUP BY ALL)
  {RANKED.format('SELECT * FROM fused', 10)}""",
    ("chunk_table",),
)
def _(t):
    asked = t.table("benchmark").select(
        F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 10).alias("_label")
    )
    questions = asked.join(centres(t).withColumnRenamed("query_id", "_label"), "_label").drop("_label")
    return hybrid_search(t.view("chunk_table"), questions, k=10).withColumn("rank", F.col("rank").cast("long"))


def _redact_sql(text: str) -> str:
    for _, pattern, replacement in ENTITIES:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(
            text, pattern.replace("'", "''"), replacement.replace("$", "\\")
        )
    return text


@query("redact_text", f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def _(t):
    return redact_text(t.table("documents")).select("doc_id", "text")


@query(
    "redaction_report",
    f"WITH redacted AS (SELECT doc_id, {_redact_sql('text')} AS text FROM documents) "
    + "SELECT doc_id, entity, found FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS entity, CAST((length(text) - length(replace(text, '{{{name}}}', ''))) / {len(name) + 2} AS BIGINT) AS found FROM redacted"
        for name, _, _ in ENTITIES
    )
    + ") WHERE found > 0",
)
def _(t):
    return redaction_report(t.table("documents"))
