"""Substring de-duplication: runs of consecutive sentences that occur elsewhere before are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.texts import per_text
from watchtide.session import scratch_path

SENTENCES = 2  # a run has at least so many sentences
WORDS = 12  # and so many words
# Up to an end mark and white space, a line end, or the end of the text; white space after it belongs to it.
SENTENCE = r"(?s)[ \t\r\n]*.+?(?:[.!?]+[ \t\r\n]+|\n[ \t\r\n]*|\z)"
PARTS = re.compile(SENTENCE.replace(r"\z", r"\Z"))
BLANK = " \t\r\n"


def sentences(text: str | None) -> list[str]:
    """Sentences with the white space around them; joined, they are the text."""
    return PARTS.findall(text or "")


def run_hashes(text: str | None, least_sentences: int, least_words: int) -> tuple[list[int], list[int]]:
    """For each sentence the hash of the run that starts there, and the run's number of sentences.

    A run is the shortest with enough sentences and words; sentences from which none reaches that far have none.
    A word is what one space more makes of a trimmed sentence.
    """
    parts = [s.strip(BLANK) for s in sentences(text)]
    n = len(parts)
    if n < least_sentences:
        return [], []
    total = np.cumsum([0, *(s.count(" ") + 1 for s in parts)])
    ends = np.searchsorted(total, total[:-1] + least_words, side="left")
    ends = np.maximum(ends, np.arange(n) + least_sentences)
    ends = ends[ends <= n]  # ascending: the runs that fit come first
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest("\n".join(parts[a:b]).encode("utf-8")) for a, b in enumerate(ends.tolist())], np.uint64)
    return hashes.view(np.int64).tolist(), (ends - np.arange(len(ends))).tolist()


def repeated_runs(docs: DataFrame, id_col: str, text: str, least_sentences: int, least_words: int) -> DataFrame:
    """(`row_key`, `start`, `sentences`): every run that occurs before, in order of id (null last), row and place.

    The runs are hashed once and written to the shared folder. A first pass over them counts runs by hash and takes
    the first place of each (both combine on the map side, so a run that a third of the rows share costs one row per
    task); a second joins the runs with those that repeat, where adaptive execution can split a hot hash.
    """

    def find(texts: list[str | None]) -> dict:
        found = [run_hashes(t, least_sentences, least_words) for t in texts]
        return {"hashes": [h for h, _n in found], "sizes": [n for _h, n in found]}

    runs = docs.select(
        F.col(id_col).alias("id"), _row_key(id_col, text).alias("row_key"),
        per_text(F.col(text), find, "hashes: array<bigint>, sizes: array<int>").alias("runs"),
    ).select("id", "row_key", F.posexplode(F.arrays_zip("runs.hashes", "runs.sizes")).alias("start", "run")).select(
        "id", "row_key", "start", F.col("run.hashes").alias("hash"), F.col("run.sizes").alias("sentences"),
    )
    path = scratch_path(docs.sparkSession, "runs")
    runs.write.parquet(path)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key", "start")
    runs = docs.sparkSession.read.parquet(path).withColumn("place", place)
    first = runs.groupBy("hash").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1")
    # Dealt anew, so that the join deals both of its sides itself and a hot hash can be split.
    first = first.repartition(F.xxhash64("hash", "first"))
    return runs.join(first, "hash").filter("place > first").select("row_key", "start", "sentences")


def _row_key(id_col: str, text: str):
    return F.xxhash64(F.col(id_col), F.col(text))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_sentences: int = SENTENCES, least_words: int = WORDS
) -> DataFrame:
    """`docs` with `text` less every sentence that a repeated run covers, `n_sentences` before and `n_removed`.

    A run is `least_sentences` or more consecutive sentences with `least_words` or more words in all. Its first
    occurrence, by id (a null id comes last), then by the hash of id and text where ids repeat or are null, then by
    place, stays; all others go, also within one text. Null texts stay null and have no sentences; a text of which
    nothing remains becomes empty, its row stays. Rows equal in id and text are alike: none is before the other. Columns named like the results are replaced.
    """
    covered = repeated_runs(docs, id_col, text, least_sentences, least_words).groupBy(F.col("row_key").alias("__row_key")).agg(
        F.collect_set(F.struct("start", "sentences")).alias("__covered")
    )
    joined = docs.withColumn("__row_key", _row_key(id_col, text)).join(covered, "__row_key", "left")
    kept = F.arrow_udf(_without, "struct<text: string, n_sentences: bigint, n_removed: bigint>")
    starts, sizes = F.col("__covered.start"), F.col("__covered.sentences")
    others = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    return joined.withColumn("__kept", kept(F.col(text), starts, sizes)).select(
        *(F.col("__kept.text").alias(c) if c == text else F.col(f"`{c}`") for c in others),
        F.col("__kept.n_sentences").alias("n_sentences"), F.col("__kept.n_removed").alias("n_removed"),
    )


def _without(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, starts, sizes in batches:
        out, before, removed = [], [], []
        for text, own, lengths in zip(texts.to_pylist(), starts.to_pylist(), sizes.to_pylist()):
            parts = sentences(text)
            gone = {i for a, n in zip(own or (), lengths or ()) for i in range(a, a + n)}
            out.append(text if not gone else "".join(s for i, s in enumerate(parts) if i not in gone))
            before.append(len(parts))
            removed.append(len(gone))
        yield pa.StructArray.from_arrays(
            [pa.array(out, pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64())],
            names=["text", "n_sentences", "n_removed"],
        )


ORACLE = rf"""
WITH docs AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, '{SENTENCE}'), []) AS parts FROM documents),
s AS (
  SELECT doc_id, parts, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM docs
), w AS (
  SELECT *, sum(length(trim(part, E' \t\r\n')) - length(replace(trim(part, E' \t\r\n'), ' ', '')) + 1)
    OVER (PARTITION BY doc_id ORDER BY i) AS total FROM s
), ends AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM w a LEFT JOIN w p ON p.doc_id = a.doc_id AND p.i = a.i - 1
  JOIN w b ON b.doc_id = a.doc_id AND b.i >= a.i + {SENTENCES - 1} AND b.total - coalesce(p.total, 0) >= {WORDS}
  GROUP BY 1, 2
), runs AS (
  SELECT e.doc_id, e.i, e.j, list_transform(docs.parts[e.i + 1:e.j + 1], lambda x: trim(x, E' \t\r\n')) AS run
  FROM ends e JOIN docs USING (doc_id)
), again AS (
  SELECT doc_id, i, j, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS turn FROM runs
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM again WHERE turn > 1
)
SELECT d.doc_id, len(d.parts) AS n_sentences,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
  coalesce((SELECT string_agg(s.part, '' ORDER BY s.i) FROM s WHERE s.doc_id = d.doc_id
    AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.i = s.i)), CASE WHEN d.text IS NOT NULL THEN '' END) AS text
FROM docs d
"""
