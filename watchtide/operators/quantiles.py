"""Exact percentiles and order statistics that never sort a large group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.operators.small_side import join_checked
from watchtide.session import materialize

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY  # the sketch may be off by 1/ACCURACY of the ranks
HOT_ROWS = 1_000_000
FEW_ROWS = 10_000
SLIVER = 4  # a guess is worth writing if it holds at most one row in so many


def _bracket(value: str, p: float) -> Column:
    """[lower, upper] values around percentile p that hold its exact rank, for groups above ACCURACY rows."""
    return F.percentile_approx(value, [max(0.0, p - MARGIN), min(1.0, p + MARGIN)], ACCURACY)


def grouped_percentiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: Mapping[str, float],
    aggregates: Sequence[Column],
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`aggregates` and exact, interpolated percentiles per group.

    Groups up to `hot_rows` rows use the built-in exact percentile. For larger
    ones a mergeable sketch brackets each percentile, rows below the bracket are
    only counted, and the few values inside are ranked.
    """
    rows = rows.filter(F.col(value).isNotNull())
    plain = [F.percentile(value, p).alias(name) for name, p in percentiles.items()]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.filter(F.col("_n") > hot_rows))
    if hot.isEmpty():
        return rows.groupBy(*keys).agg(*aggregates, *plain)

    # Keys travel as one struct: struct comparison treats null fields as equal, so null groups join too.
    tagged = rows.select(F.struct(*keys).alias("_k"), *[c for c in rows.columns if c not in keys])
    hot = hot.select(F.struct(*keys).alias("_k"))
    spilled = [f"_k.{k}" for k in keys]
    small = (
        join_checked(tagged, hot, ["_k"], "left_anti")
        .groupBy("_k")
        .agg(*aggregates, *plain)
        .select(*spilled, "*")
        .drop("_k")
    )
    warm = join_checked(tagged, hot, ["_k"], "left_semi")
    names = list(percentiles)
    sketch = materialize(
        warm.groupBy("_k").agg(
            *aggregates,
            F.count(F.lit(1)).alias("_n"),
            F.min(value).alias("_min"),
            F.max(value).alias("_max"),
            *[_bracket(value, percentiles[name]).alias(f"_b_{name}") for name in names],
        )
    )
    # Up to ACCURACY rows a group keeps all its values inside the bracket.
    few = F.col("_n") <= ACCURACY
    cuts = sketch.select(
        "_k",
        F.array(*[
            F.struct(
                F.lit(name).alias("_name"),
                F.when(few, F.col("_min")).otherwise(F.col(f"_b_{name}")[0]).alias("_lo"),
                F.when(few, F.col("_max")).otherwise(F.col(f"_b_{name}")[1]).alias("_hi"),
                ((F.col("_n") - 1) * F.lit(percentiles[name])).alias("_rank"),
            )
            for name in names
        ]).alias("_cuts"),
    )
    placed = (
        join_checked(warm, cuts, ["_k"], "inner")
        .select("_k", value, F.explode("_cuts").alias("_cut"))
        .select("_k", value, "_cut.*")
    )
    group = ["_k", "_name", "_rank"]
    below = placed.filter(F.col(value) < F.col("_lo")).groupBy(*group).agg(F.count(F.lit(1)).alias("_below"))
    inside = (
        placed.filter(F.col(value).between(F.col("_lo"), F.col("_hi")))
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_c"))
        .join(below, group, "left")
    )
    upto = Window.partitionBy(*group).orderBy(value)
    ranked = inside.withColumn("_end", F.coalesce("_below", F.lit(0)) + F.sum("_c").over(upto))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank), F.col(value)))

    low, high = F.col("_low"), F.col("_high")
    exact = (
        ranked.groupBy(*group)
        .agg(value_at(F.floor("_rank")).alias("_low"), value_at(F.ceil("_rank")).alias("_high"))
        .withColumn("_p", low + (high - low) * (F.col("_rank") - F.floor("_rank")))
        # The sketch bounds its error, so a rank is always inside its bracket; were it not, that must show.
        .withColumn("_p", F.coalesce("_p", F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")))
        .groupBy("_k")
        .pivot("_name", names)
        .agg(F.first("_p"))
    )
    kept = [c for c in sketch.columns if not c.startswith("_")]
    large = sketch.select("_k", *kept).join(exact, "_k").select(*spilled, *kept, *names)
    return small.unionByName(large)


def order_statistic(rows: DataFrame, value: str, rank: int, low=None, high=None) -> object:
    """Value at 0-based `rank` in ascending order; `low` and `high` are a first guess of where it lies.

    The range is cut at values drawn by hash (any type that has an order will do) and the parts are counted, until
    the part with the rank holds few rows; only those are sorted. A round moves a few values, and takes the range to
    about a fifth. Where a guess holds the rank, one pass counts around it and one writes the few rows inside; `rows`
    are not computed again.
    """
    column = F.col(value)
    inside = rows.filter(column.isNotNull())
    if low is not None and high is not None:
        counted, smaller, upto = inside.agg(F.count(column), F.count_if(column < low), F.count_if(column <= high)).first()
        if smaller <= rank < upto and (upto - smaller) * SLIVER <= counted:
            few = materialize(inside.filter(column.between(low, high)).select(value))
            return order_statistic(few, value, rank - smaller)
    n, last = inside.agg(F.count(column), F.max(column)).first()
    if not 0 <= rank < n:
        raise ValueError(f"rank {rank} is beyond the rows")
    after, below, upto = None, 0, last  # the range (after, upto], and the rows up to `after`
    guesses = sorted({g for g in (low, high) if g is not None and g < last})
    while True:
        part = inside.filter(column <= upto) if after is None else inside.filter((column > after) & (column <= upto))
        size, smaller, next_down, *cuts = part.agg(
            F.count(column), F.count_if(column < upto), F.max(F.when(column < upto, column)),
            *[F.min_by(column, F.xxhash64(column, F.lit(i))).alias(f"cut{i}") for i in range(7)],
        ).first()
        if rank - below >= smaller:
            return upto
        if size <= FEW_ROWS:
            return part.select(value).orderBy(value).offset(rank - below).limit(1).first()[0]
        cuts = guesses or sorted({c for c in cuts if c < upto}) or [next_down]
        guesses = []
        counts = part.agg(*[F.count_if(column <= c).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        base = below
        for cut, count in zip(cuts, counts):
            if base + count > rank:
                upto = cut
                break
            after, below = cut, base + count


def exact_percentile(rows: DataFrame, value: str, p: float) -> float:
    """Linearly interpolated percentile of one column over all rows."""
    n, lo, hi, bounds = rows.agg(
        F.count(value), F.min(value), F.max(value), _bracket(value, p)
    ).first()
    if n == 0:
        raise ValueError("no rows")
    rank = (n - 1) * p
    if n > ACCURACY:
        lo, hi = bounds
    low = order_statistic(rows, value, int(rank), lo, hi)
    if rank == int(rank):
        return low
    high = order_statistic(rows, value, int(rank) + 1, lo, hi)
    return low + (high - low) * (rank - int(rank))
