"""Forests of groups equal forests fitted group by group."""

import pytest
from pyspark.sql import functions as F

from tests.test_scale_paths import feature_frame
from watchtide.operators.grouped_forest import fit_by_group, model_of
from watchtide.operators.iforest import Hyperparameters, iforest_fit

PARAMS = Hyperparameters(n_estimators=6, max_samples=32, contamination=0.05)


def grouped_frame(spark):
    source = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).when(F.col("id") == 1, "one").otherwise("null")
    return feature_frame(spark, n=420).withColumn("source", source)


def test_each_group_has_the_forest_of_its_rows(spark):
    df = grouped_frame(spark)
    found = fit_by_group(df.repartition(5), key="id", group="source", params=PARAMS)
    assert set(found.samples) == {"=hot", "null", "=one", "=null"}
    scored = {r.id: (r.anomaly_score, r.is_anomaly) for r in found.score(df, "source").collect()}
    for name in found.samples:
        own = df.filter(model_of(F.col("source")) == name)
        alone = iforest_fit(own.drop("source"), key="id", params=PARAMS)
        mine = found.nodes.filter(F.col("model") == name).drop("model")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, alone.nodes.collect()))
        assert found.offsets[name] == pytest.approx(alone.offset, abs=1e-15)
        for r in alone.score(own).collect():
            assert scored[r.id][0] == pytest.approx(r.anomaly_score, abs=1e-12)


def test_unknown_groups_and_bounds(spark, monkeypatch):
    from watchtide.operators import grouped_forest

    df = grouped_frame(spark)
    found = fit_by_group(df.filter("source = 'hot'"), key="id", group="source", params=PARAMS)
    other = found.score(df.filter("source = 'one'"), "source").first()
    assert other.anomaly_score is None and other.is_anomaly is False
    with pytest.raises(ValueError, match="no training rows"):
        fit_by_group(df.limit(0), key="id", group="source", params=PARAMS)
    monkeypatch.setattr(grouped_forest, "MAX_FOREST_NODES", 100)
    with pytest.raises(ValueError, match="too large"):
        fit_by_group(df, key="id", group="source", params=PARAMS)
