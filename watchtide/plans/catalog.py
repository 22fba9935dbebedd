"""All registered queries, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.operators.normalize import normalize_findings
from watchtide.operators.query import query_findings
from watchtide.operators.scoring import score_findings
from watchtide.plans import finding_queries, lake_queries, model_queries, search_queries  # noqa: F401
from watchtide.plans.registry import QUERIES, SQL, Inputs  # noqa: F401
from watchtide.session import prepare


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw envelopes to findings, a forest fitted on audit events, scores, and the structured query."""
    t = Inputs(prepare(spark), sf_dir)
    model, _train, _validation = model_queries.fitted(t)
    findings = normalize_findings(t.view("envelopes"), enriched_at=F.col("event_ts"))
    scored = score_findings(findings, model)
    return query_findings(scored, severity="high", days_back=7, limit=25, as_of=finding_queries.NOW)
