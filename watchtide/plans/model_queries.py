"""Queries over features, models and metrics."""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.operators.features import RARITY_SOURCES, category_counts, extract_features, plain_features, rarity_lookup, with_parts
from watchtide.operators.grouped_forest import fit_by_group
from watchtide.operators.iforest import IsolationForest, iforest_fit
from watchtide.operators.metrics import alarm_states, api_status_rollup, budget_eval, metric_rollup, window_sums
from watchtide.operators.normalize import normalize_findings
from watchtide.operators.scoring import score_findings
from watchtide.operators.sketches import ACCURACY as SKETCH_ACCURACY
from watchtide.operators.sketches import ORIGIN, PERCENTILES, hourly, sketch_windows
from watchtide.operators.split import train_val_split, with_split
from watchtide.operators.summary import evaluation_report, training_distribution
from watchtide.plans.adapters import AS_OF
from watchtide.plans.finding_queries import EVENT_SQL, FINDING
from watchtide.plans.forest_sql import FIT_SQL, OFFSET_SQL, SINGLE_RARITY, baseline_rarity, feature_list, score_sql
from watchtide.plans.registry import Inputs, query
from watchtide.schemas import FEATURE_COLUMNS
from watchtide.session import materialize
from watchtide.sources.registry import approve_model, approvals, gate, keep_latest_models, model_states, register

C = ("cloudtrail",)
FRACTIONS = tuple(c for c in FEATURE_COLUMNS if not c.startswith("is_"))  # flags are 0 or 1 as they are
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)

# --- features ------------------------------------------------------------------------------------

IDENTITY = "CASE WHEN json_valid(useridentity) THEN lower(json_extract_string(useridentity, '$.type')) END"
FEATURE_SQL = {
    "hour_of_day": "COALESCE(hour(event_ts), 12) / CAST(24 AS DOUBLE)",
    "day_of_week": "COALESCE(isodow(event_ts) - 1, 3) / CAST(7 AS DOUBLE)",
    "is_weekend": "CASE WHEN isodow(event_ts) >= 6 THEN 1.0 ELSE 0.0 END",
    "is_business_hours": "CASE WHEN hour(event_ts) BETWEEN 8 AND 17 THEN 1.0 ELSE 0.0 END",
    "is_root_user": f"CASE WHEN {IDENTITY} = 'root' THEN 1.0 ELSE 0.0 END",
    "is_assumed_role": f"CASE WHEN {IDENTITY} = 'assumedrole' THEN 1.0 ELSE 0.0 END",
    "is_error_response": "CASE WHEN errorcode IS NOT NULL THEN 1.0 ELSE 0.0 END",
    "is_console_action": "CASE WHEN regexp_matches(eventname, 'ConsoleLogin|SignIn|Federation|SwitchRole') THEN 1.0 ELSE 0.0 END",
    **{
        name: f"""COALESCE(1.0 - (SELECT n FROM (SELECT {c} AS v, count(*) AS n FROM cloudtrail GROUP BY 1) x WHERE x.v = cloudtrail.{c})
            / CAST((SELECT max(n) FROM (SELECT count({c}) AS n FROM cloudtrail GROUP BY {c}) y) AS DOUBLE), 1.0)"""
        for name, c in RARITY_SOURCES.items()
    },
    "ip_octet_variance": """CASE WHEN len(string_split(sourceipaddress, '.')) = 4
        THEN list_var_pop(list_transform(string_split(sourceipaddress, '.'), lambda x: CAST(x AS DOUBLE))) / 10000 ELSE 0.0 END""",
}


def _rounded(name: str) -> str:
    return f"round(CAST({FEATURE_SQL[name]} AS DOUBLE), 9) AS {name}"


def _round_features(df: DataFrame, names: tuple[str, ...] = FRACTIONS) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in names})


def _register_feature(name: str) -> None:
    @query(f"feat_{name}", f"SELECT event_id, {_rounded(name)} FROM cloudtrail", C)
    def _(t):
        trail = t.view("cloudtrail")
        if name in RARITY_SOURCES:
            column = RARITY_SOURCES[name]
            rows = rarity_lookup(trail.select("event_id", column), materialize(category_counts(trail, [column])), [name])
        else:
            rows = with_parts(trail, F.col("event_ts")).withColumn(name, plain_features()[name])
        return _round_features(rows.select("event_id", name), (name,))


for _name in FEATURE_COLUMNS:
    _register_feature(_name)


def features(t: Inputs, **options) -> DataFrame:
    return extract_features(t.view("cloudtrail"), keep=["event_id"], ts=F.col("event_ts"), **options)


@query("extract_features", f"SELECT event_id, {', '.join(_rounded(c) for c in FEATURE_COLUMNS)} FROM cloudtrail", C)
def _(t):
    return _round_features(features(t))


@query(
    "extract_features_single",
    "SELECT event_id, "
    + ", ".join(
        f"CASE WHEN {RARITY_SOURCES[c]} IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {c}" if c in RARITY_SOURCES else _rounded(c)
        for c in FEATURE_COLUMNS
    )
    + " FROM cloudtrail",
    C,
)
def _(t):
    return _round_features(features(t, rarity="single"))


@query(
    "rarity_lookup",
    f"SELECT event_id, {', '.join(_rounded(c) for c in RARITY_SOURCES)} FROM cloudtrail",
    C,
)
def _(t):
    trail = t.view("cloudtrail")
    rows = rarity_lookup(trail.select("event_id", *RARITY_SOURCES.values()), materialize(category_counts(trail)))
    return _round_features(rows.select("event_id", *RARITY_SOURCES), tuple(RARITY_SOURCES))


COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS category, {c} AS value, count(*) AS n, max(count(*)) OVER () AS top_n FROM cloudtrail WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in RARITY_SOURCES.values()
)


@query("category_counts", COUNTS_SQL, C)
def _(t):
    return category_counts(t.view("cloudtrail"))


# --- model ---------------------------------------------------------------------------------------

SPLIT_SQL = """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5(CONCAT('42:', CAST(event_id AS VARCHAR))))
  <= CAST(floor((SELECT count(*) FROM cloudtrail) * (1.0 - 0.2)) AS BIGINT) THEN 'train' ELSE 'validation' END AS split FROM cloudtrail"""


@query("train_val_split", SPLIT_SQL, C)
def _(t):
    return with_split(t.view("cloudtrail").select("event_id"), key="event_id")


def fitted(t: Inputs) -> tuple[IsolationForest, DataFrame, DataFrame]:
    """(model, train features, validation features) with rarity counted on the training rows.

    Features are rounded to nine places, so that the last bits of an engine's arithmetic never decide a split.
    """
    train, validation = train_val_split(t.view("cloudtrail"), key="event_id")
    counts = materialize(category_counts(train))
    made = [
        _round_features(extract_features(rows, keep=["event_id"], ts=F.col("event_ts"), rarity="baseline", counts=counts))
        for rows in (train, validation)
    ]
    return iforest_fit(made[0], key="event_id"), made[0], made[1]


def _scored_round(df: DataFrame) -> DataFrame:
    return df.withColumn("anomaly_score", F.round("anomaly_score", 9))


# The whole fit in the checking engine: split, counts of the training rows, matrices, trees, scores and offset.
FEATURED_SQL = f""", parts AS MATERIALIZED (SELECT c.*, s.split FROM cloudtrail c JOIN ({SPLIT_SQL}) s USING (event_id)),
counts AS MATERIALIZED ({" UNION ALL ".join(
        f"SELECT '{c}' AS category, {c} AS value, count(*) AS n FROM parts WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}"
        for c in RARITY_SOURCES.values())}),
featured AS MATERIALIZED (SELECT split, event_id AS key, {feature_list(FEATURE_SQL, baseline_rarity('parts'))} AS f FROM parts)"""
TRAINED_SQL = FEATURED_SQL + """, matrix AS MATERIALIZED (SELECT key, f FROM featured WHERE split = 'train'),
held_out AS MATERIALIZED (SELECT key, f FROM featured WHERE split = 'validation')""" + FIT_SQL
FOREST_SQL = TRAINED_SQL + OFFSET_SQL
VALIDATED_SQL = FOREST_SQL + score_sql("held_out", "judged") + """
, validated AS (SELECT key AS event_id, raw - cut AS anomaly_score, raw - cut < 0 AS is_anomaly FROM judged CROSS JOIN cutoff)"""


@query("iforest_fit", TRAINED_SQL + "SELECT tree, node, feature, round(threshold, 9) AS threshold, n_rows FROM nodes", C)
def _(t):
    return fitted(t)[0].nodes.withColumn("threshold", F.round("threshold", 9))


@query(
    "iforest_score",
    VALIDATED_SQL + "SELECT event_id, round(anomaly_score, 9) AS anomaly_score, is_anomaly FROM validated",
    C,
)
def _(t):
    model, _train, validation = fitted(t)
    return _scored_round(model.score(validation).select("event_id", "anomaly_score", "is_anomaly"))


# Forests by region; the checking engine fits the rows of one region at a time.
GROUP_COLUMN = "awsregion"
GROUPS = ("us-east-1", "us-east-2", "us-west-2")


FITTED_NAMES = r"\b(matrix|sizes|rounds|drawn|grown|nodes|trained_walk|trained|cutoff|held_out|judged_walk|judged)\b"


def _group_sql(n: int, group: str) -> str:
    """The fit and the scores of one group's rows, with its number behind each table's name."""
    own = "SELECT x.key, x.f FROM featured x JOIN cloudtrail c ON c.event_id = x.key WHERE c.{column} = '{group}' AND x.split = '{split}'"
    rows = [
        f", {name} AS MATERIALIZED ({own.format(column=GROUP_COLUMN, group=group, split=split)})"
        for name, split in (("matrix", "train"), ("held_out", "validation"))
    ]
    return re.sub(FITTED_NAMES, rf"\1_{n}", "".join(rows) + FIT_SQL + OFFSET_SQL + score_sql("held_out", "judged"))


GROUP_SQL = FEATURED_SQL + "".join(_group_sql(n, g) for n, g in enumerate(GROUPS)) + "\n" + " UNION ALL ".join(
    f"""SELECT key AS event_id, '{g}' AS {GROUP_COLUMN}, round(raw - cut, 9) AS anomaly_score, raw - cut < 0 AS is_anomaly
    FROM judged_{n} CROSS JOIN cutoff_{n}""" for n, g in enumerate(GROUPS)
)


@query("iforest_by_group", GROUP_SQL, C)
def _(t):
    train, validation = train_val_split(t.view("cloudtrail"), key="event_id")
    counts = materialize(category_counts(train))
    made = [
        _round_features(
            extract_features(rows, keep=["event_id", GROUP_COLUMN], ts=F.col("event_ts"), rarity="baseline", counts=counts)
        )
        for rows in (train, validation)
    ]
    forests = fit_by_group(made[0], key="event_id", group=GROUP_COLUMN)
    return _scored_round(forests.score(made[1], GROUP_COLUMN).select("event_id", GROUP_COLUMN, "anomaly_score", "is_anomaly"))


@query(
    "training_distribution",
    FOREST_SQL + """SELECT count_if(raw - cut < 0) AS anomalies, count(*) AS rows,
      100.0::DOUBLE * count_if(raw - cut < 0) / count(*) AS percent FROM trained CROSS JOIN cutoff""",
    C,
)
def _(t):
    model, train, _validation = fitted(t)
    return training_distribution(model.score(train))


@query(
    "write_eval_report",
    VALIDATED_SQL + """SELECT round(count_if(is_anomaly) / CAST(count(*) AS DOUBLE), 9) AS anomaly_rate,
      count_if(is_anomaly) AS anomalies_detected, count(*) AS total_validation_rows,
      round(avg(anomaly_score), 6) AS mean, round(min(anomaly_score), 9) AS min, round(max(anomaly_score), 9) AS max FROM validated""",
    C,
)
def _(t):
    from watchtide.sources.registry import write_eval_report

    model, _train, validation = fitted(t)
    path = t.scratch("evaluation")
    write_eval_report(evaluation_report(model.score(validation)), path)
    schema = """anomaly_rate double, anomalies_detected long, total_validation_rows long,
                score_statistics struct<mean double, min double, max double>"""
    return _flat_report(t.spark.read.schema(schema).json(path)).withColumn("anomaly_rate", F.round("anomaly_rate", 9))


# Findings as the model sees them, `key` the row number; `rows` is what they are read from (as `normalized`).
def scored_findings_sql(rows: str) -> str:
    event = EVENT_SQL.replace("SELECT event_id", "SELECT event_id, CAST(left(enriched_at, 26) AS TIMESTAMP) AS event_ts").replace(
        "FROM normalized", f"FROM {rows}"
    )
    return FOREST_SQL + f"""
, finding_rows AS MATERIALIZED (SELECT event_id AS key, {feature_list(FEATURE_SQL, SINGLE_RARITY)} AS f FROM ({event}))""" + score_sql(
        "finding_rows", "finding_scores"
    ) + f"""
, scored_findings AS (SELECT e.*, x.f, x_raw - cut AS score, x_raw - cut < 0 AS is_anomaly FROM {rows} e
  JOIN (SELECT key, f, raw AS x_raw FROM finding_rows JOIN finding_scores USING (key)) x ON x.key = e.event_id CROSS JOIN cutoff)"""


FINDING_VIEWS = ("cloudtrail", "envelopes", "normalized")


@query(
    "score_findings",
    scored_findings_sql("normalized") + f"""SELECT {FINDING}, round(score, 9) AS anomaly_score, is_anomaly,
      enriched_at AS scored_at, 'forest-1' AS model_endpoint FROM scored_findings""",
    FINDING_VIEWS,
)
def _(t):
    findings = normalize_findings(t.view("envelopes"), enriched_at=F.col("event_ts"))
    scored = score_findings(
        findings, fitted(t)[0], scored_at=F.try_to_timestamp(F.col("enriched_at")), model_endpoint="forest-1"
    )
    return _scored_round(scored.drop("resource_tags"))


@query(
    "feature_contract",
    FOREST_SQL + f"""
, single_rows AS MATERIALIZED (SELECT event_id AS key, {feature_list(FEATURE_SQL, SINGLE_RARITY)} AS f FROM cloudtrail)"""
    + score_sql("single_rows", "loaded")
    + "SELECT key AS event_id, round(raw - cut, 9) AS anomaly_score, raw - cut < 0 AS is_anomaly FROM loaded CROSS JOIN cutoff",
    C,
)
def _(t):
    model = fitted(t)[0]
    path = t.scratch("model")
    model.save(path)
    loaded = IsolationForest.load(t.spark, path)
    rows = _round_features(features(t, rarity="single"))
    loaded.check_contract([c for c in rows.columns if c in FEATURE_COLUMNS])
    return _scored_round(loaded.score(rows).select("event_id", "anomaly_score", "is_anomaly"))


REPORT_SQL = """SELECT count_if(is_anomaly) / CAST(count(*) AS DOUBLE) AS anomaly_rate, count_if(is_anomaly) AS anomalies_detected,
  count(*) AS total_validation_rows, round(avg(anomaly_score), 6) AS mean, round(min(anomaly_score), 9) AS min, round(max(anomaly_score), 9) AS max"""


def _flat_report(df: DataFrame) -> DataFrame:
    stats = df.select(*[c for c in df.columns if c != "score_statistics"], "score_statistics.*")
    return stats.withColumns({"mean": F.round("mean", 6), "min": F.round("min", 9), "max": F.round("max", 9)})


@query(
    "evaluation_report",
    f"SELECT round(anomaly_rate, 9) AS anomaly_rate, * EXCLUDE (anomaly_rate) FROM ({REPORT_SQL} FROM scored)",
    ("scored",),
)
def _(t):
    return _flat_report(evaluation_report(t.view("scored"))).withColumn("anomaly_rate", F.round("anomaly_rate", 9))


# One model version per account and day, judged on that day's scores.
VERSIONS_SQL = """SELECT account_id AS model_group, CAST(strftime(enriched_ts, '%Y%m%d') AS BIGINT) AS version,
  count_if(anomaly_score < -0.75) / CAST(count(*) AS DOUBLE) AS anomaly_rate, count(*) AS total_validation_rows FROM scored GROUP BY ALL"""


def versions(t: Inputs) -> DataFrame:
    rows = t.view("scored").withColumns(
        {
            "model_group": F.col("account_id"),
            "version": F.date_format("enriched_ts", "yyyyMMdd").cast("long"),
            "is_anomaly": F.coalesce(F.col("anomaly_score") < -0.75, F.lit(False)),
        }
    )
    return evaluation_report(rows, by=["model_group", "version"])


@query(
    "evaluate_and_gate",
    f"""SELECT model_group, version, round(anomaly_rate, 9) AS anomaly_rate, total_validation_rows, 'PendingManualApproval' AS status
        FROM ({VERSIONS_SQL}) WHERE anomaly_rate <= 0.05""",
    ("scored",),
)
def _(t):
    return gate(versions(t)).select(
        "model_group", "version", F.round("anomaly_rate", 9).alias("anomaly_rate"), "total_validation_rows", "status"
    )


def _registered(t: Inputs, path: str) -> DataFrame:
    register(
        versions(t), path, group=F.col("model_group"), version=F.col("version"),
        artifact=F.concat_ws("/", F.lit("models"), "model_group", F.col("version").cast("string")), at=F.lit(NOW),
    )
    return t.spark.read.parquet(path)


@query(
    "approve_model",
    f"""SELECT model_group, version, round(anomaly_rate, 9) AS anomaly_rate,
        CASE WHEN anomaly_rate <= 0.02 THEN 'Approved' ELSE 'PendingManualApproval' END AS status
        FROM ({VERSIONS_SQL}) WHERE anomaly_rate <= 0.05""",
    ("scored",),
)
def _(t):
    path = t.scratch("models")
    models = _registered(t, path)
    approve_model(models, path, when=F.col("anomaly_rate") <= 0.02, at=F.lit(NOW))
    return model_states(t.spark.read.parquet(path)).select(
        "model_group", "version", F.round("anomaly_rate", 9).alias("anomaly_rate"), "status"
    )


@query(
    "keep_latest_models",
    f"""SELECT model_group, version, round(anomaly_rate, 9) AS anomaly_rate, CONCAT('models/', model_group, '/', CAST(version AS VARCHAR)) AS artifact
        FROM ({VERSIONS_SQL}) WHERE anomaly_rate <= 0.02 QUALIFY row_number() OVER (PARTITION BY model_group ORDER BY version DESC) = 1""",
    ("scored",),
)
def _(t):
    models = _registered(t, t.scratch("models"))
    approved = approvals(models, when=F.col("anomaly_rate") <= 0.02, at=F.lit(NOW))
    return keep_latest_models(models.unionByName(approved)).withColumn("anomaly_rate", F.round("anomaly_rate", 9))


# --- metrics -------------------------------------------------------------------------------------

WINDOW = "CAST(floor(epoch({ts}) / 300) * 300 AS BIGINT)"
START = WINDOW.format(ts="ts")


@query(
    "metric_rollup",
    f"""SELECT {START} AS window_start, name, dim, round(sum(value), 6) AS sum_value, round(avg(value), 6) AS avg_value, count(value) AS samples,
        round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM metrics GROUP BY ALL""",
    ("metrics",),
)
def _(t):
    rolled = metric_rollup(t.view("metrics"), ts=F.col("ts"))
    return rolled.withColumns({c: F.round(c, 6) for c in ("sum_value", "avg_value", "p50", "p99")})


@query(
    "metric_rollup_hot",
    """SELECT name, round(sum(value), 4) AS sum_value, count(value) AS samples,
        round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM metrics GROUP BY ALL""",
    ("metrics",),
)
def _(t):
    from watchtide.operators.quantiles import grouped_percentiles

    rolled = grouped_percentiles(
        t.view("metrics").select("name", "value"), ["name"], "value", {"p50": 0.5, "p99": 0.99},
        [F.sum("value").alias("sum_value"), F.count("value").alias("samples")], hot_rows=1000,
    )
    return rolled.withColumns({"sum_value": F.round("sum_value", 4), "p50": F.round("p50", 6), "p99": F.round("p99", 6)})


LOG_GAMMA = math.log((1 + SKETCH_ACCURACY) / (1 - SKETCH_ACCURACY))


def _sketch_value(bucket: str) -> str:
    gamma = (1 + SKETCH_ACCURACY) / (1 - SKETCH_ACCURACY)
    return f"sign({bucket}) * pow({gamma}, (abs({bucket}) - {ORIGIN})) * {2 / (gamma + 1)}"


def hourly_sql(closed: str = "TRUE") -> str:
    """Percentiles per hour and name over all dimensions, from bucket counts of the five-minute windows."""
    index = f"CAST(ceil(ln(abs(value)) / {LOG_GAMMA}) AS BIGINT) + {ORIGIN}"
    rank = "(SELECT list_min(list(bucket)) FROM ranked r WHERE r.hour_start = g.hour_start AND r.name = g.name AND r.upto > floor((g.samples - 1) * CAST({p} AS DOUBLE)))"
    found = ", ".join(
        f"round(least(greatest({_sketch_value(rank.format(p=p))}, low), high), 6) AS {name}" for name, p in PERCENTILES.items()
    )
    return f""", bucketed AS (SELECT {START} AS w, name, dim, CASE WHEN value > 0 THEN {index} WHEN value < 0 THEN -({index}) ELSE 0 END AS bucket,
    count(*) AS n, sum(value) AS total, min(value) AS low, max(value) AS high FROM metrics WHERE value IS NOT NULL GROUP BY ALL),
merged AS MATERIALIZED (SELECT w - w % 3600 AS hour_start, name, bucket, sum(n) AS n, sum(total) AS total, min(low) AS low, max(high) AS high
  FROM bucketed WHERE {closed} GROUP BY ALL),
ranked AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY hour_start, name ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM merged),
g AS (SELECT hour_start, name, CAST(sum(n) AS BIGINT) AS samples, sum(total) AS total, min(low) AS low, max(high) AS high FROM merged GROUP BY ALL)
SELECT hour_start, name, samples, round(total, 6) AS sum_value, round(low, 6) AS min_value, round(high, 6) AS max_value,
  round(total / samples, 6) AS avg_value, {found} FROM g"""


def rounded_hours(rolled: DataFrame) -> DataFrame:
    return rolled.withColumns({c: F.round(c, 6) for c in ("sum_value", "avg_value", "min_value", "max_value", *PERCENTILES)})


@query("metric_hourly", hourly_sql(), ("metrics",))
def _(t):
    return rounded_hours(hourly(sketch_windows(t.view("metrics"), ts=F.col("ts")), ["name"]))


@query(
    "api_status_rollup",
    f"""SELECT {START} AS window_start, count(*) AS requests, count_if(status // 100 = 4) AS errors_4xx, count_if(status // 100 = 5) AS errors_5xx
        FROM metrics GROUP BY 1""",
    ("metrics",),
)
def _(t):
    return api_status_rollup(t.view("metrics"), ts=F.col("ts"))


def alarm_sql(horizon: str) -> str:
    """Alarm changes on a gap-filled grid of windows that are complete at `horizon` (epoch seconds)."""
    return f"""
, sums AS (SELECT {START} AS w, name, sum(failures) AS total FROM metrics GROUP BY ALL),
grid AS (SELECT name, unnest(range((SELECT min(w) FROM sums), CAST({horizon} AS BIGINT) - 299, 300)) AS w FROM (SELECT DISTINCT name FROM metrics)),
states AS (SELECT g.name, g.w, COALESCE(s.total, 0) >= 1 AS bad FROM grid g LEFT JOIN sums s ON s.name = g.name AND s.w = g.w),
changes AS (SELECT name, w, bad, lag(bad, 1, FALSE) OVER (PARTITION BY name ORDER BY w) AS was FROM states)
SELECT name, w AS at, CASE WHEN bad THEN 'ALARM' ELSE 'OK' END AS state FROM changes WHERE bad <> was"""


@query("alarm_states", alarm_sql(f"epoch(TIMESTAMP '{AS_OF}')"), ("metrics",))
def _(t):
    sums = window_sums(t.view("metrics"), ts=F.col("ts"), keys=["name"], value=F.col("failures"))
    return alarm_states(sums, horizon=int(NOW.timestamp()))


@query(
    "budget_eval",
    """, monthly AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS actual FROM orders GROUP BY 1),
    spend AS (SELECT *, actual * day(last_day(m)) / greatest(least(date_diff('day', m, TIMESTAMP '1998-07-16'), day(last_day(m))), 1) AS forecast FROM monthly),
    notices AS (SELECT * FROM (VALUES ('ACTUAL', 80), ('ACTUAL', 100), ('FORECASTED', 100)) v(kind, percent))
    SELECT strftime(m, '%Y-%m') AS month, kind, percent, round(actual, 2) AS actual, round(forecast, 2) AS forecast,
      CASE kind WHEN 'ACTUAL' THEN actual ELSE forecast END > 30000000.0 * percent / 100 AS exceeded FROM spend CROSS JOIN notices""",
    ("metrics",),
)
def _(t):
    judged = budget_eval(
        t.table("orders"), ts=F.col("o_orderdate"), cost=F.col("o_totalprice"), limit=3e7, as_of=F.lit("1998-07-16").cast("date")
    )
    return judged.withColumns({"actual": F.round("actual", 2), "forecast": F.round("forecast", 2)})
