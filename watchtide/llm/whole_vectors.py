"""Vector columns turned into whole numbers, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole_rows(column: pa.Array, scale: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, values) of the vectors of a list column that hold only finite components.

    `rows` are their places in the column, `lengths` their numbers of components, and `values` the components,
    one vector after the other, as floor(scale * x) in int64, x in double precision. Null vectors and those with
    a null or non-finite component are left out; empty ones stay. A whole number beyond `most` either way is an
    error, as an overflowing cast is.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)  # nulls become NaN
    owner = np.repeat(np.arange(len(column)), lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[owner[~np.isfinite(flat)]] = False
    values = np.floor(scale * flat[good[owner]])
    if len(values) and np.abs(values).max() > most:
        raise ValueError(f"a component times {scale} is beyond {most}")
    rows = np.flatnonzero(good)
    return rows, lengths[rows], values.astype(np.int64)


def by_length(lengths: np.ndarray, values: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length to (places among the vectors, matrix) of the vectors of that length."""
    ends = np.cumsum(lengths)
    found = {}
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        found[int(length)] = at, values[(ends[at] - length)[:, None] + np.arange(length)]
    return found


def floats(rows: DataFrame, vector: str) -> Column:
    """The vector column as it is, if it holds floats or doubles; else in doubles."""
    kind = rows.schema[vector].dataType.elementType
    column = F.col(f"`{vector}`")
    return column if isinstance(kind, (T.FloatType, T.DoubleType)) else column.cast("array<double>")
