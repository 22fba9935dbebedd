"""A forest per group (source, account, region) of one feature matrix, all fitted and applied in one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.operators.iforest import (
    MAX_FOREST_NODES, Hyperparameters, _grow, draw_by, forest_scores, packed_trees,
)
from watchtide.operators.quantiles import grouped_percentiles
from watchtide.operators.small_side import join_checked
from watchtide.schemas import FEATURE_COLUMNS, FOREST_NODES
from watchtide.session import materialize


def model_of(group: Column) -> Column:
    """Name of a group's model; null is a group of its own, apart from any text."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("null"))


@dataclass(frozen=True)
class GroupedForests:
    """Fitted forests by model name: all nodes, and the sample size and decision offset of each."""

    nodes: DataFrame
    params: Hyperparameters
    samples: Mapping[str, int]
    offsets: Mapping[str, float]
    columns: tuple[str, ...] = FEATURE_COLUMNS

    def raw_score(self, model: Column) -> Column:
        """Column expression for a row's raw score by the forest of its model; null where there is none."""
        if sum(self.params.n_estimators * (2 * s - 1) for s in self.samples.values()) > MAX_FOREST_NODES:
            raise ValueError("the forests are too large to broadcast; group by fewer values, or lower max_samples")
        table = self.nodes.toPandas()
        packed = {
            name: (packed_trees(own, self.params.n_estimators, self.samples[name]), self.samples[name])
            for name, own in table.groupby("model")
        }
        held = SparkSession.active().sparkContext.broadcast(packed)

        @F.pandas_udf("double")
        def score(names: pd.Series, *features: pd.Series) -> pd.Series:
            out = np.full(len(names), np.nan)
            values = [f.to_numpy(dtype=float) for f in features]
            for name, at in names.groupby(names).indices.items():
                if name in held.value:
                    trees, samples = held.value[name]
                    out[at] = forest_scores(trees, samples, [v[at] for v in values])
            return pd.Series(out).astype(object).where(~np.isnan(out), None)

        return score(model, *[F.col(c) for c in self.columns])

    def score(self, features: DataFrame, group: str) -> DataFrame:
        """Adds anomaly_score (higher is more normal) and is_anomaly. A group without a model gives null and false."""
        model = model_of(F.col(group))
        offset = F.lit(None).cast("double")
        if self.offsets:
            offsets = F.create_map(*[F.lit(x) for pair in self.offsets.items() for x in pair])
            offset = F.try_element_at(offsets, model)
        return features.withColumn("anomaly_score", self.raw_score(model) - offset).withColumn(
            "is_anomaly", F.coalesce(F.col("anomaly_score") < 0, F.lit(False))
        )


def fit_by_group(
    features: DataFrame, *, key: str, group: str, params: Hyperparameters | None = None, margin: float = 6.0
) -> GroupedForests:
    """A forest for each value of `group`, the same as `iforest_fit` gives for its rows alone.

    Groups and trees are tasks of one job, each of at most max_samples rows, so a group with a third of all rows
    costs no more to grow than another; offsets are exact percentiles per group, bracketed for large ones. Values
    of `group` are as many as forests fit into a broadcast (checked before it is made).
    """
    params = params or Hyperparameters()
    columns = [c for c in features.columns if c in FEATURE_COLUMNS]
    matrix = materialize(features.select(model_of(F.col(group)).alias("model"), key, *columns))
    counts = matrix.groupBy("model").agg(F.count(F.lit(1)).alias("_rows"))
    counts = materialize(counts.withColumn("_samples", F.least(F.col("_rows"), F.lit(params.max_samples))))
    trees = params.n_estimators
    if (counts.agg(F.sum(F.lit(trees) * (2 * F.col("_samples") - 1))).first()[0] or 0) > MAX_FOREST_NODES:
        raise ValueError("the forests are too large to broadcast; group by fewer values, or lower max_samples")
    samples = {r["model"]: r["_samples"] for r in counts.collect()}
    if not samples:
        raise ValueError("no training rows")
    sized = join_checked(matrix, counts, ["model"], "inner")
    while True:
        drawn = draw_by(sized, key, ["model"], F.col("_rows"), F.col("_samples"), trees, params.random_state, margin)
        nodes = materialize(
            drawn.select("model", "tree", *columns).groupBy("model", "tree").applyInPandas(
                _grown_with_model(columns, samples, params.random_state), f"model string, {FOREST_NODES}"
            )
        )
        roots = nodes.filter("node = 0").join(F.broadcast(counts), "model").filter(F.col("n_rows") == F.col("_samples"))
        if roots.count() == trees * len(samples):
            break
        if margin > 100:
            raise ValueError(f"column {key!r} is not unique enough to draw the rows of each tree")
        margin *= 3
    fitted = GroupedForests(nodes, params, samples, {}, tuple(columns))
    scores = materialize(matrix.select("model", fitted.raw_score(F.col("model")).alias("raw")))
    cuts = grouped_percentiles(scores, ["model"], "raw", {"cut": params.contamination}, [F.count("raw").alias("n")])
    offsets = {r["model"]: r["cut"] for r in cuts.collect()}
    return GroupedForests(nodes, params, samples, offsets, tuple(columns))


def _grown_with_model(columns: list[str], samples: Mapping[str, int], seed: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["model"].iloc[0]
        made = _grow(columns, samples[name], seed)(rows)
        made.insert(0, "model", name)
        return made

    return grow
