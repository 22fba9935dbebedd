"""The table of queries: a name, a Spark query, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from watchtide.plans import adapters
from watchtide.session import scratch_path, prepare


@dataclass(frozen=True)
class Inputs:
    """What a query may read: the given tables and the views over them."""

    spark: SparkSession
    sf_dir: str

    def view(self, name: str) -> DataFrame:
        return adapters.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)

    def stream(self, name: str) -> DataFrame:
        """A view over the events table read as a stream."""
        schema = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        # The glob matches the table as one file and as a folder of files.
        source = self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/events.parquet*")
        source.createOrReplaceTempView("events_stream")
        return self.spark.sql(adapters.VIEWS[name].replace("FROM events", "FROM events_stream"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query; without `sql` only its rows are checked by the driver."""

    def add(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(prepare(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = adapters.with_views(sql, *views)
        return build

    return add
