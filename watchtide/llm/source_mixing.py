"""Mixing sources: token weights raked to target marginals, then documents sampled by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.operators.small_side import BROADCAST_BYTES, measured_bytes
from watchtide.session import materialize

ROUNDS = 8  # of raking, each over all marginals
BUDGET = 0.5  # share of all tokens to sample
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Marginal:
    """Target shares of the values of a column: their shares of tokens, raised to `power` and rescaled
    (1: as they are, 0: all alike)."""

    column: str
    power: float


# The topic is what a text's form says of it; any column of labels can take its place.
MARGINALS = (Marginal("source", 0.5), Marginal("lang", 0.7), Marginal("topic", 0.8))


def topic(text: Column) -> Column:
    """A coarse kind of text by its marks: table, shout, code or prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("!! ")), "shout")
        .when(F.contains(text, F.lit("{")) | F.contains(text, F.lit("###")), "code").otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def raked(cells: DataFrame, marginals: Sequence[Marginal], rounds: int = ROUNDS) -> DataFrame:
    """`cells` with `weight`: their `tokens` raked, in turn and `rounds` times, to the targets of each marginal
    (iterative proportional fitting; weights sum to 1). Cells without tokens keep weight 0.

    The table of cells is as large as there are combinations of values, whatever the number of documents; each
    step is one window sum over it.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for m in marginals:
        share = F.sum("weight").over(Window.partitionBy(m.column))
        cells = cells.withColumn(f"_{m.column}", F.when(share > 0, F.pow(share, F.lit(m.power))).otherwise(0.0))
    cells = materialize(cells)
    for m in marginals:
        values = cells.select(m.column, f"_{m.column}").distinct()
        scale = values.agg(F.sum(f"_{m.column}")).first()[0] or 1.0
        cells = cells.withColumn(f"_{m.column}", F.col(f"_{m.column}") / F.lit(scale))
    for turn in range(rounds):
        for m in marginals:
            now = F.sum("weight").over(Window.partitionBy(m.column))
            fitted = F.when(F.col("weight") > 0, F.col("weight") * F.col(f"_{m.column}") / now).otherwise(0.0)
            cells = cells.withColumn("weight", fitted)
        if turn % 4 == 3:
            cells = materialize(cells)
    return cells.drop(*(f"_{m.column}" for m in marginals))


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with `p`, such that sampling documents with it gives about `budget` of all tokens in the proportions of
    `weight`. A cell with too few tokens is taken whole (p = 1) and the rest share what it lacks.

    p = min(1, c * weight / tokens) with one c for all cells: c grows until the cells that are full under it are
    those it was computed for. Each step is one aggregate of the cells; full cells stay full, so it ends.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    cells = materialize(cells.withColumn("_ratio", ratio))
    wanted = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    c, full = wanted, 0
    while True:
        n, tokens_full, weight_full = cells.filter(F.lit(c) * F.col("_ratio") > 1).agg(
            F.count("*"), F.sum("tokens"), F.sum("weight")
        ).first()
        if n == full:
            break
        rest = 1.0 - weight_full
        c, full = (max(c, (wanted - tokens_full) / rest) if rest > 1e-12 else 1e300), n
    return cells.withColumn("p", F.least(F.lit(1.0), F.lit(c) * F.col("_ratio"))).drop("_ratio")


def chance(id_col: str) -> Column:
    """A number in [0, 1) from the id: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", marginals: Sequence[Marginal] = MARGINALS,
    budget: float = BUDGET,
) -> DataFrame:
    """All rows of `docs` with `topic`, `tokens`, `weight` (target share of their cell), `p` and `sampled`.

    Cells are the combinations of the marginal columns, nulls being a value of their own. A document is sampled
    if the number its id hashes to is below p, so the same id gets the same answer in any run, repeated rows
    included; a row without an id is sampled only where p is 1. Null and empty texts have no tokens and p = 0 in
    a cell of their own, the p of their cell otherwise. Token counts are summed on the map side, so a hot source
    costs one row per task; documents find their cell by a join whose small side is measured before it is sent.
    Columns named like the results are replaced.
    """
    columns = [m.column for m in marginals]
    made = ("topic", "tokens", "weight", "p", "sampled")
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in made or (c == "topic" and "topic" not in columns)))
    if "topic" in columns:
        rows = rows.withColumn("topic", topic(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("tokens", tokens(F.col(text)))
    cells = materialize(rows.groupBy(*columns).agg(F.sum("tokens").alias("tokens")))
    targets = probabilities(raked(cells, marginals), budget).select(
        *(F.col(c).alias("_" + c) for c in columns), "weight", "p"
    )
    targets = materialize(targets)
    if measured_bytes(targets) <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col("_" + c)) for c in columns))  # nulls match nulls
    sampled = F.coalesce(chance(id_col) < F.col("p"), F.col("p") >= 1, F.lit(False))
    return rows.join(targets, same, "left").drop(*("_" + c for c in columns)).withColumn("sampled", sampled)


def oracle(marginals: Sequence[Marginal] = MARGINALS, budget: float = BUDGET, rounds: int = ROUNDS) -> str:
    """The same in SQL, step by step."""
    columns = [m.column for m in marginals]
    steps = [f"""rows AS (SELECT doc_id, source, lang, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
    WHEN contains(coalesce(text, ''), '!! ') THEN 'shout' WHEN contains(coalesce(text, ''), '{{') OR contains(coalesce(text, ''), '###')
    THEN 'code' ELSE 'prose' END AS topic, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM documents)""",
        f"cells AS (SELECT {', '.join(columns)}, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL)",
        "w0 AS (SELECT *, tokens / nullif(sum(tokens) OVER (), 0) AS weight FROM cells)"]
    for m in marginals:
        steps.append(f"""t_{m.column} AS (SELECT v, raised / sum(raised) OVER () AS target FROM
    (SELECT {m.column} AS v, CASE WHEN sum(weight) > 0 THEN sum(weight) ^ {m.power} ELSE 0 END AS raised FROM w0 GROUP BY 1))""")
    last = "w0"
    for turn in range(rounds):
        for m in marginals:
            name = f"w{turn}_{m.column}"
            steps.append(f"""{name} AS MATERIALIZED (SELECT {', '.join(columns)}, tokens, CASE WHEN weight > 0 THEN weight * target
    / sum(weight) OVER (PARTITION BY {m.column}) ELSE 0 END AS weight FROM {last} LEFT JOIN t_{m.column} ON v IS NOT DISTINCT FROM {m.column})""")
            last = name
    order = "ORDER BY ratio DESC, " + ", ".join(f"{c} NULLS FIRST" for c in columns)
    steps.append(f"r AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio, sum(tokens) OVER () AS every FROM {last})")
    steps.append(f"""b AS (SELECT *, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    1 - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, row_number() OVER o AS place
    FROM r WINDOW o AS ({order}))""")
    steps.append(f"c AS (SELECT *, CASE WHEN rest > 1e-12 THEN (every * {budget} - filled) / rest END AS c FROM b)")
    steps.append("f AS (SELECT coalesce(arg_min(c, place), 1e300) AS c FROM c WHERE c * ratio <= 1)")
    steps.append(f"p AS (SELECT {', '.join('c.' + c for c in columns)}, weight, least(1.0, greatest(0.0, f.c * ratio)) AS p FROM c, f)")
    same = " AND ".join(f"rows.{c} IS NOT DISTINCT FROM p.{c}" for c in columns)
    return f"""WITH {', '.join(steps)}
SELECT doc_id, rows.source, rows.lang, rows.topic, tokens, round(weight, 6) AS weight, round(p, 6) AS p,
  coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < p, p >= 1, false) AS sampled
FROM rows LEFT JOIN p ON {same}"""
