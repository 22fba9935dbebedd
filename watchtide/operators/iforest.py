"""Isolation forest (Liu, Ting and Zhou, 2008) fitted and applied with Spark."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchtide.operators.quantiles import exact_percentile
from watchtide.schemas import FEATURE_COLUMNS, FOREST_NODES
from watchtide.session import materialize

EULER_GAMMA = 0.5772156649015329
MAX_FOREST_NODES = 5_000_000  # the forest is broadcast to score; this bounds it
HASH_DIGITS = 13  # 52 bits, exact in a double


@dataclass(frozen=True)
class Hyperparameters:
    n_estimators: int = 100
    contamination: float = 0.01
    random_state: int = 42
    max_samples: int = 256

    @classmethod
    def from_text(cls, raw: Mapping[str, Any] | None) -> Hyperparameters:
        """Values often arrive as text; one that does not convert keeps its default."""
        params = cls()
        for name, default in asdict(params).items():
            try:
                params = replace(params, **{name: type(default)(raw[name])})
            except (KeyError, TypeError, ValueError):
                continue
        return params


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER_GAMMA) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def depth_limit(samples: int) -> int:
    return int(math.ceil(math.log2(max(samples, 2))))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def _unit_hash(*parts: Column) -> Column:
    """Uniform in [0, 1): the first 13 hex digits of an MD5, as any SQL engine can compute them."""
    return F.conv(F.substring(F.md5(_joined(*parts)), 1, HASH_DIGITS), 16, 10).cast("long") / F.lit(float(16**HASH_DIGITS))


def _unit(*parts: object) -> float:
    """`_unit_hash` of values in Python."""
    text = ":".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:HASH_DIGITS], 16) / 16**HASH_DIGITS


def draw_samples(rows: DataFrame, key: str, n: int, samples: int, trees: int, seed: int, margin: float) -> DataFrame:
    """(tree, features, _rank): `samples` rows per tree, without replacement, of a table of `n` rows (`draw_by`)."""
    return draw_by(rows, key, [], F.lit(n), F.lit(samples), trees, seed, margin)


def draw_by(
    rows: DataFrame, key: str, by: Sequence[str], n: Column, samples: Column, trees: int, seed: int, margin: float
) -> DataFrame:
    """`samples` rows per tree of each group of `by`, without replacement; `n` is the number of the group's rows.

    Rows are chosen by hash, so the draw does not depend on partitioning and
    only about trees * samples rows of a group move. In a round each tree owns a slice of
    the hash range; as many rounds, with a hash each, follow as the trees need:
    one for a large group, one per tree for a group that every tree takes whole.
    """
    seed_part = F.lit(seed)
    rows = rows.withColumns({"_n": n.cast("double"), "_s": samples.cast("double")})
    rate = F.least(F.lit(1.0), (F.col("_s") + F.lit(margin) * F.sqrt("_s")) / F.col("_n"))
    rows = rows.withColumn("_rate", rate).withColumn("_slices", F.greatest(F.lit(1), F.floor(F.lit(1.0) / F.col("_rate")).cast("int")))
    rounds = F.sequence(F.lit(0), (F.ceil(F.lit(float(trees)) / F.col("_slices")) - 1).cast("int"))
    taken = F.transform(
        rounds,
        lambda r: F.struct(r.alias("r"), F.floor(_unit_hash(seed_part, r, F.col(key)) / F.col("_rate")).cast("int").alias("slice")),
    )
    tree = F.col("_t.r") * F.col("_slices") + F.col("_t.slice")
    drawn = rows.withColumn("_t", F.explode(F.filter(taken, lambda t: t["slice"] < F.col("_slices"))))
    drawn = drawn.withColumn("tree", tree).filter(F.col("tree") < trees)
    drawn = drawn.withColumn("_order", F.md5(_joined(F.lit("order"), seed_part, F.col("tree"), F.col(key))))
    ranked = Window.partitionBy(*by, "tree").orderBy("_order", key)
    kept = drawn.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= F.col("_s"))
    return kept.drop("_t", "_n", "_s", "_rate", "_slices")


def _grow(columns: Sequence[str], samples: int, seed: int):
    """Builds one tree from at most `samples` rows, as rows of FOREST_NODES.

    Feature and threshold of a split are hashes of (seed, tree, node), so a tree depends on its rows alone, not on
    their order nor on a generator's state.
    """
    limit = depth_limit(samples)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        values = rows[list(columns)].to_numpy(dtype=float)
        nodes, todo = [], [(0, 0, np.arange(len(values)))]
        while todo:
            node, depth, members = todo.pop()
            low, high = values[members].min(axis=0), values[members].max(axis=0)
            splittable = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or len(splittable) == 0:
                nodes.append((tree, node, -1, 0.0, len(members)))
                continue
            feature = int(splittable[int(_unit("feature", seed, tree, node) * len(splittable))])
            threshold = float(low[feature] + _unit("threshold", seed, tree, node) * (high[feature] - low[feature]))
            if threshold >= high[feature]:  # rounded up to the top: nothing would go right
                threshold = float(low[feature])
            goes_left = values[members, feature] <= threshold
            nodes.append((tree, node, feature, threshold, len(members)))
            todo.append((2 * node + 2, depth + 1, members[~goes_left]))
            todo.append((2 * node + 1, depth + 1, members[goes_left]))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "n_rows"])

    return grow


def packed_trees(nodes: pd.DataFrame, trees: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, threshold and path-length arrays in heap order, one row per tree.

    Below a leaf every step goes left, down to a slot that holds the leaf's
    path length, so scoring needs no leaf test.
    """
    depth = depth_limit(samples)
    inner, total = 2**depth - 1, 2 ** (depth + 1) - 1
    shape = (trees, total)
    feature, threshold, length = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape)
    for row in nodes.itertuples(index=False):
        if row.feature >= 0:
            feature[row.tree, row.node], threshold[row.tree, row.node] = row.feature, row.threshold
            continue
        at = row.node
        while at < inner:
            at = 2 * at + 1
        length[row.tree, at] = (row.node + 1).bit_length() - 1 + average_path(row.n_rows)
    return feature, threshold, length


def forest_scores(packed: tuple[np.ndarray, np.ndarray, np.ndarray], samples: int, features: Sequence[np.ndarray]) -> np.ndarray:
    """Minus two to the power of the mean path over c(samples), negated, of rows given as feature columns."""
    depth, scale = depth_limit(samples), float(average_path(max(samples, 2)))
    flat = np.concatenate(features)
    rows = len(features[0])
    row_at, total = np.arange(rows), np.zeros(rows)
    for feature, threshold, length in zip(*packed):
        node = np.zeros(rows, dtype=np.int64)
        for _ in range(depth):
            value = flat.take(row_at + rows * feature.take(node))
            node = 2 * node + 1 + (value > threshold.take(node))
        total += length.take(node)
    return -np.exp2(-total / len(packed[0]) / scale)


@dataclass(frozen=True)
class IsolationForest:
    """A fitted forest: node table, parameters, feature contract and decision offset."""

    nodes: DataFrame
    params: Hyperparameters
    samples: int
    offset: float = 0.0
    columns: tuple[str, ...] = FEATURE_COLUMNS

    def check_contract(self, columns: Sequence[str]) -> None:
        if tuple(columns) != tuple(self.columns):
            raise ValueError(f"feature contract mismatch: model has {self.columns}, input has {tuple(columns)}")

    def _packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.params.n_estimators * (2 * self.samples - 1) > MAX_FOREST_NODES:
            raise ValueError("the forest is too large to broadcast; lower n_estimators or max_samples")
        return packed_trees(self.nodes.toPandas(), self.params.n_estimators, self.samples)

    def raw_score(self) -> Column:
        """Column expression for -2^(-E[path]/c): lower is more anomalous."""
        packed = SparkSession.active().sparkContext.broadcast(self._packed())
        samples = self.samples

        @F.pandas_udf("double")
        def score(*features: pd.Series) -> pd.Series:
            return pd.Series(forest_scores(packed.value, samples, [f.to_numpy(dtype=float) for f in features]))

        return score(*[F.col(c) for c in self.columns])

    def score(self, features: DataFrame) -> DataFrame:
        """Adds anomaly_score (higher is more normal) and is_anomaly (score below zero)."""
        self.check_contract([c for c in features.columns if c in FEATURE_COLUMNS])
        return features.withColumn("anomaly_score", self.raw_score() - F.lit(self.offset)).withColumn(
            "is_anomaly", F.col("anomaly_score") < 0
        )

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {
            "params": asdict(self.params), "samples": self.samples,
            "offset": self.offset, "columns": list(self.columns),
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(
            spark.read.schema(FOREST_NODES).parquet(f"{path}/nodes"),
            Hyperparameters(**meta["params"]), meta["samples"], meta["offset"], tuple(meta["columns"]),
        )


def iforest_fit(
    features: DataFrame, *, key: str, params: Hyperparameters | None = None, margin: float = 6.0
) -> IsolationForest:
    """Fits a forest on a feature matrix with a unique `key` column.

    Each tree is grown in its own task from at most max_samples rows. The
    decision offset is the contamination percentile of the training scores.
    """
    params = params or Hyperparameters()
    columns = [c for c in features.columns if c in FEATURE_COLUMNS]
    # The narrow matrix is written once: the count, the draw and the training scores all read it.
    return _fit_written(materialize(features.select(key, *columns)), key, columns, params, margin)


def _fit_written(features: DataFrame, key: str, columns: list[str], params: Hyperparameters, margin: float) -> IsolationForest:
    n = features.count()
    if n == 0:
        raise ValueError("no training rows")
    samples = min(params.max_samples, n)
    drawn = draw_samples(features, key, n, samples, params.n_estimators, params.random_state, margin)
    grown = drawn.groupBy("tree").applyInPandas(_grow(columns, samples, params.random_state), FOREST_NODES)
    nodes = materialize(grown)
    full = nodes.filter((F.col("node") == 0) & (F.col("n_rows") == samples)).count()
    if full < params.n_estimators:
        if margin > 100:
            raise ValueError(f"column {key!r} is not unique enough to draw {samples} rows per tree")
        return _fit_written(features, key, columns, params, margin * 3)
    model = IsolationForest(nodes, params, samples, 0.0, tuple(columns))
    scores = materialize(features.select(model.raw_score().alias("raw")))
    return replace(model, offset=exact_percentile(scores, "raw", params.contamination))
