"""Comparing all rows that share a key, in cells of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.operators.small_side import join_checked

BLOCK_ROWS = 2048


def pair_cells(rows: DataFrame, keys: Sequence[str], spread_by: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` dealt into cells, columns `cell_a`, `cell_b` and `block`, such that any two rows of a key share
    exactly one cell of it to be compared in.

    A key of at most `block_rows` rows is one cell. A larger one is cut into blocks by a hash of `spread_by`,
    and each pair of blocks is a cell: rows of block `cell_a` are to be compared with rows of block `cell_b`.
    No row is left out, and no task ever holds more than about two blocks. Only keys with more than
    `block_rows` rows take part in the lookup of their size, so that side stays small; it is measured anyway.
    """
    large = rows.groupBy(*keys).count().filter(F.col("count") > block_rows)
    large = large.select(*keys, F.ceil(F.col("count") / F.lit(block_rows)).cast("int").alias("_blocks"))
    dealt = join_checked(rows, large, list(keys), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(spread_by), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({
        "cell_a": F.least("block", "_other"), "cell_b": F.greatest("block", "_other"),
    }).drop("_blocks", "_other")


def star_links(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links i-j among n items, as few that connect the same items: each item to the first of its group."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]
