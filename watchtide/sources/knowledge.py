"""Finding text for retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.operators.dedup import last_write_wins
from watchtide.operators.retrieval import chunk_fixed


def kb_source_overlap(enriched: DataFrame, scored: DataFrame, on: Sequence[str] = ("finding_id",)) -> DataFrame:
    """Enriched findings that have no scored row yet. Scored keys are made distinct first, so one scored often moves once per task."""
    return enriched.join(scored.select(*on).distinct(), list(on), "left_anti")


def kb_ingest(enriched: DataFrame, scored: DataFrame) -> DataFrame:
    """Chunks of both finding tables: of each source and finding id its newest row, the scored form first.

    The text of a finding is its JSON, so scores can be found and cited. `chunk_id` is unique: origin, source and
    finding id name the document, and a number the chunk.
    """
    key = ("source", "finding_id")
    enriched, scored = last_write_wins(enriched, keys=key), last_write_wins(scored, keys=key)
    fresh = kb_source_overlap(enriched, scored, on=key)
    texts = [
        df.select("source", "finding_id", F.lit(origin).alias("origin"), F.to_json(F.struct(*df.columns)).alias("text"))
        for origin, df in (("scored", scored), ("enriched", fresh))
    ]
    both = texts[0].unionByName(texts[1]).withColumn("doc_id", F.concat_ws("/", "origin", "source", "finding_id"))
    return chunk_fixed(both).withColumn(
        "chunk_id", F.concat_ws("#", "doc_id", F.col("chunk_no").cast("string"))
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)
