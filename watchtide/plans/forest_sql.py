"""The isolation forest as SQL for the checking engine: the draw, the trees, the offset and the scores."""

from __future__ import annotations

from watchtide.operators.iforest import EULER_GAMMA, HASH_DIGITS, Hyperparameters
from watchtide.operators.features import RARITY_SOURCES
from watchtide.schemas import FEATURE_COLUMNS

PARAMS = Hyperparameters()
MARGIN = 6.0  # of the draw, in standard deviations
N = len(FEATURE_COLUMNS)


def _unit(*parts: str) -> str:
    text = f"concat_ws(':', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})"
    return f"(CAST(CONCAT('0x', substr(md5({text}), 1, {HASH_DIGITS})) AS BIGINT) / CAST({16**HASH_DIGITS} AS DOUBLE))"


def _variance(ip: str) -> str:
    """Octet variance with the operations in the order the feature has them."""
    parts = [f"CAST(string_split({ip}, '.')[{i}] AS DOUBLE)" for i in range(1, 5)]
    mean = f"(({' + '.join(parts)}) / 4.0)"
    squares = " + ".join(f"({p} - {mean}) * ({p} - {mean})" for p in parts)
    return f"CASE WHEN len(string_split({ip}, '.')) = 4 THEN ({squares}) / 4.0 / 10000.0 ELSE 0.0 END"


def feature_list(feature_sql: dict[str, str], rarity: dict[str, str]) -> str:
    """The features of a row, rounded to nine places, as one list in contract order."""
    terms = feature_sql | rarity | {"ip_octet_variance": _variance("sourceipaddress")}
    return "[" + ", ".join(f"round(CAST({terms[c]} AS DOUBLE), 9)" for c in FEATURE_COLUMNS) + "]"


def baseline_rarity(rows: str) -> dict[str, str]:
    """Rarity terms that read the counts of the training rows; `rows` names the table the terms stand over."""
    return {
        name: f"""COALESCE(1.0 - (SELECT x.n FROM counts x WHERE x.category = '{c}' AND x.value = {rows}.{c})
            / CAST((SELECT max(n) FROM counts WHERE category = '{c}') AS DOUBLE), 1.0)"""
        for name, c in RARITY_SOURCES.items()
    }


SINGLE_RARITY = {name: f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END" for name, c in RARITY_SOURCES.items()}


def _choice(lows: str, highs: str, count: str) -> str:
    """Feature and threshold of the split of a node (feature -1: a leaf) from the bounds of its rows."""
    able = f"list_filter(range({N}), lambda i: ({highs})[i + 1] > ({lows})[i + 1])"
    return f"""CASE WHEN depth >= dl OR {count} <= 1 OR len({able}) = 0 THEN -1
      ELSE ({able})[1 + CAST(floor({_unit("'feature'", str(PARAMS.random_state), 'tree', 'node')} * len({able})) AS INTEGER)] END"""


def _bounds(aggregate: str, over: str = "") -> str:
    return "[" + ", ".join(f"{aggregate}(f[{i}]){over}" for i in range(1, N + 1)) + "]"


SEED, TREES, SAMPLES = PARAMS.random_state, PARAMS.n_estimators, PARAMS.max_samples
RATE = f"least(1.0, (s + {MARGIN} * sqrt(CAST(s AS DOUBLE))) / n)"
HASHED_THRESHOLD = f"lo + {_unit(chr(39) + 'threshold' + chr(39), str(SEED), 'tree', 'node')} * (hi - lo)"
MEAN_PATH = f"""CASE WHEN {{n}} <= 1 THEN 0.0 WHEN {{n}} = 2 THEN 1.0
  ELSE 2.0 * (ln(CAST({{n}} - 1 AS DOUBLE)) + {EULER_GAMMA}) - 2.0 * (CAST({{n}} AS DOUBLE) - 1.0) / {{n}} END"""


def _splits(source: str) -> str:
    """Rows of `source` (tree, node, depth, key, f) with the split of their node."""
    over = " OVER (PARTITION BY tree, node)"
    return f"""SELECT *, CASE WHEN thr >= hi THEN lo ELSE thr END AS threshold FROM (SELECT *, {HASHED_THRESHOLD} AS thr FROM (
      SELECT *, lows[feature + 1] AS lo, highs[feature + 1] AS hi FROM (
        SELECT *, {_choice('lows', 'highs', 'members')} AS feature FROM (
          SELECT g.*, sizes.dl, {_bounds('min', over)} AS lows, {_bounds('max', over)} AS highs,
            count(*){over} AS members FROM {source} g CROSS JOIN sizes))))"""


# Reads `matrix` (key, f): the training rows. Gives `nodes` and `sizes`.
FIT_SQL = f"""
, sizes AS MATERIALIZED (SELECT n, s, {RATE} AS rate, CAST(floor(1.0 / {RATE}) AS INTEGER) AS slices,
    CAST(ceil(log2(greatest(s, 2))) AS INTEGER) AS dl
  FROM (SELECT count(*) AS n, least(count(*), {SAMPLES}) AS s FROM matrix)),
rounds AS (SELECT unnest(range(CAST(ceil(CAST({TREES} AS DOUBLE) / slices) AS INTEGER))) AS r FROM sizes),
drawn AS (SELECT tree, key, f FROM (
    SELECT r * slices + CAST(floor(u / rate) AS INTEGER) AS tree, CAST(floor(u / rate) AS INTEGER) AS slice, slices, s, key, f
    FROM (SELECT r, key, f, {_unit(str(SEED), 'r', 'key')} AS u FROM matrix CROSS JOIN rounds) CROSS JOIN sizes)
  WHERE slice < slices AND tree < {TREES}
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY md5(concat_ws(':', 'order', '{SEED}', CAST(tree AS VARCHAR), CAST(key AS VARCHAR))), key) <= s),
grown AS (
  SELECT tree, 0 AS node, 0 AS depth, key, f FROM drawn
  UNION ALL
  SELECT tree, 2 * node + CASE WHEN f[feature + 1] > threshold THEN 2 ELSE 1 END, depth + 1, key, f FROM ({_splits('grown')}) WHERE feature >= 0),
nodes AS MATERIALIZED (SELECT DISTINCT tree, node, CAST(feature AS INTEGER) AS feature,
    CASE WHEN feature < 0 THEN 0.0 ELSE threshold END AS threshold, members AS n_rows, depth FROM ({_splits('grown')}))
"""


def score_sql(rows: str, made: str) -> str:
    """CTE `made` (key, raw): minus two to the power of the mean path, for `rows` (key, f); trees sum in their order."""
    return f"""
, {made}_walk AS (
  SELECT key, tree, 0 AS node FROM {rows} CROSS JOIN (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT w.key, w.tree, 2 * w.node + CASE WHEN r.f[n.feature + 1] > n.threshold THEN 2 ELSE 1 END
  FROM {made}_walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN {rows} r ON r.key = w.key WHERE n.feature >= 0),
{made} AS MATERIALIZED (SELECT key, -pow(2.0, -total / {TREES} / scale) AS raw FROM (
  SELECT w.key, list_reduce(list(n.depth + {MEAN_PATH.format(n='n.n_rows')} ORDER BY w.tree), lambda a, b: a + b) AS total
  FROM {made}_walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY w.key)
  CROSS JOIN (SELECT {MEAN_PATH.format(n='greatest(s, 2)')} AS scale FROM sizes))"""


# The offset is the contamination percentile of the training scores.
OFFSET_SQL = score_sql("matrix", "trained") + f"""
, cutoff AS MATERIALIZED (SELECT quantile_cont(raw, {PARAMS.contamination}) AS cut FROM trained)"""
