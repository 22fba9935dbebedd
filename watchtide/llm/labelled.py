"""Folds, labelled documents and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.operators.small_side import join_checked
from watchtide.session import materialize

UNIT = 1 << 30


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def held_out(id_col: str, folds: int, held: int) -> Column:
    """Whether a row is kept from learning; a row without an id counts as learnable but is in no label table."""
    return F.coalesce(fold(id_col, folds) == held, F.lit(False))


def draw(rows: DataFrame, id_col: str, group: str, per_group: int, salt: str, most_groups: int = 1000) -> DataFrame:
    """A sample of about `per_group` rows of each value of `group` (all, if fewer), drawn by a hash of the id.

    Its size is bounded by `per_group` x `most_groups`, whatever the input; more groups than that are refused.
    """
    sizes = rows.groupBy(group).count().limit(most_groups + 1).collect()
    if len(sizes) > most_groups:
        raise ValueError(f"more than {most_groups} values of {group}")
    share = F.when(F.lit(False), 0)  # one flat list of cases, however many groups there are
    for value, n in sizes:
        share = share.when(F.col(group) == F.lit(value), int(UNIT * min(1.0, per_group / n)))
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(UNIT)) < share.otherwise(0))


def known_labels(labels: DataFrame, label: str, id_col: str, learn: Column) -> DataFrame:
    """(`id_col`, `label` 0 or 1), one row per id, `learn` true; an id with several labels takes the largest."""
    known = labels.select(F.col(id_col), F.col(label).alias("label")).filter(learn & F.col("label").isin(0, 1))
    return known.groupBy(id_col).agg(F.max("label").alias("label"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text: str, learn: Column) -> DataFrame:
    """(`id`, `text`, `label`) of every row of every document with a label; null texts count as empty.

    Texts stay where they are while ids and labels take little room; otherwise both sides are shuffled, those of
    `learn` only.
    """
    texts = docs.filter(learn).select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = join_checked(texts, known_labels(labels, label, id_col, learn), [id_col], "inner")
    return rows.select(F.col(id_col).alias("id"), "text", "label")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, id_col: str, text: str, learn: Column, per_label: int, salt: str
) -> DataFrame:
    """(`id`, `text`, `label` 0 or 1) of a bounded sample of documents with a label, `learn` true.

    Ids are drawn first, so that only the documents drawn are moved. Labels that are null or neither 0 nor 1 are
    left out; an id with several labels takes the largest, and one with several rows its smallest text, so that the
    bound holds for rows whatever repeats; null texts count as empty. Rows without an id have no label.
    """
    known = known_labels(labels, label, id_col, learn)
    drawn = materialize(draw(known, id_col, "label", per_label, salt))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most about 2 x per_label rows of an id and a bit
    rows = texts.join(F.broadcast(drawn), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))
    return materialize(rows.select(F.col(id_col).alias("id"), "text", "label"))
