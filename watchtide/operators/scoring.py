"""Scores findings with a fitted forest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.operators.features import extract_features
from watchtide.operators.iforest import IsolationForest
from watchtide.operators.normalize import finding_to_event, merge_scores
from watchtide.schemas import FEATURE_COLUMNS


def score_with_features(
    findings: DataFrame, model: IsolationForest, *, rarity: str = "single",
    counts: DataFrame | None = None, scored_at: Column | None = None, model_endpoint: str = "forest",
) -> DataFrame:
    """Findings with their features and scores. No shuffle in the `single` mode."""
    kept = findings.columns
    events = finding_to_event(findings, keep=kept)
    features = extract_features(events, keep=kept, rarity=rarity, counts=counts)
    stamp = F.current_timestamp() if scored_at is None else scored_at
    return merge_scores(model.score(features), scored_at=stamp, model_endpoint=model_endpoint)


def score_findings(findings: DataFrame, model: IsolationForest, **options) -> DataFrame:
    """Findings with anomaly_score, is_anomaly, scored_at and model_endpoint."""
    return score_with_features(findings, model, **options).drop(*FEATURE_COLUMNS)
