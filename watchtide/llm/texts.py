"""Text columns in Arrow batches of bounded size, and what is remembered of words between batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.session import prepare

# A Python worker holds one batch; one text above the byte limit is a batch of its own.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


# Letters of the usual Latin texts, for which a plain class does what a slower Unicode property does.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN_TEXT = re.compile(rf"[\t-\r -~{LATIN}]*")


def prepare_texts(spark: SparkSession) -> SparkSession:
    """Session settings that bound the memory of a Python worker."""
    prepare(spark)
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def per_text(column: Column, fn: Callable[[list[str | None]], dict[str, Any]], returns: str) -> Column:
    """A struct column `returns` (a DDL of fields) with what `fn` gives for each batch of texts."""
    names = [field.split()[0] for field in _fields(returns)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = fn(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(found[n], t) for n, t in zip(names, types)], names=names)

    types = [_arrow_type(field.split(None, 1)[1]) for field in _fields(returns)]
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"struct<{returns}>")(column)


def with_text_columns(df: DataFrame, text: str, fn, returns: str) -> DataFrame:
    """`df` with the fields of `per_text`; they replace columns of the same names."""
    held = "__per_text"
    names = [field.split()[0] for field in _fields(returns)]
    taken = {n.lower() for n in names}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.withColumn(held, per_text(F.col(text), fn, returns)).select(
        *kept, *(F.col(f"{held}.{n}").alias(n) for n in names)
    )


def _fields(returns: str) -> list[str]:
    return [part.strip().replace(":", " ", 1) for part in returns.split(",")]


def _arrow_type(name: str) -> pa.DataType:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(),
        "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
        "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
    }
    return kinds[name.strip()]


def runs(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum to about `most`; a larger single item is a slice of its own."""
    start = stop = total = 0
    for size in sizes:
        if stop > start and total + size > most:
            yield slice(start, stop)
            start, total = stop, 0
        stop, total = stop + 1, total + size
    if stop > start:
        yield slice(start, stop)


class WordMemo:
    """Remembers a result per word; forgets all of them when they outgrow `room` characters.

    Results depend on the word alone, so forgetting changes no answer.
    """

    def __init__(self, compute: Callable[[list[str]], Sequence[Any]], room: int = 3_000_000):
        self.compute, self.room = compute, room
        self.known: dict[str, Any] = {}
        self.held = 0

    def of(self, words: set[str]) -> dict[str, Any]:
        """A table that holds at least `words`."""
        if self.held > self.room:
            self.known, self.held = {}, 0
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, self.compute(new)))
            self.held += sum(map(len, new)) + 8 * len(new)
        return self.known
