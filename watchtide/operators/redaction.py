"""Redacted documents and a count of what was redacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.functions import redact as rx
from watchtide.operators.spread import spread


def redact_text(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """`documents` with the text column redacted."""
    return spread(documents).withColumn(text, rx.redact(F.col(text)))


def redaction_report(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, entity, found): redactions per document and entity, only where some were made.

    Tags already present in the source text are not counted.
    """
    before, after = rx.entity_counts(F.col(text)), rx.entity_counts(F.col("_redacted"))
    counts = F.array(*[
        F.struct(F.lit(name).alias("entity"), (after[name] - before[name]).alias("found")) for name in after
    ])
    return (
        spread(documents.select(id_column, text)).withColumn("_redacted", rx.redact(F.col(text)))
        .filter(F.col("_redacted") != F.col(text))
        .select(id_column, F.explode(counts).alias("c"))
        .select(id_column, "c.*")
        .filter(F.col("found") > 0)
    )
