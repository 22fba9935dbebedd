"""Connected components of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.session import materialize

MOST_ROUNDS = 60


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(`node`, `component`) of every node in `links`; the component is its smallest node.

    Alternating large-star and small-star steps: each ties the neighbours of a node to the smallest of them,
    until nothing changes (a number of rounds that grows with the logarithm of the longest chain). A hub costs
    one partial minimum per task and a join that adaptive execution can split. Links of a node to itself keep
    it as a component of one; null ends are dropped; repeated links change nothing.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    edges = materialize(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _round in range(MOST_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        edges = materialize(_star(_star(edges, larger_only=True), larger_only=False))
    else:
        raise RuntimeError("components did not settle")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own).groupBy("node").agg(
        F.min("component").alias("component")
    )


def _star(edges: DataFrame, *, larger_only: bool) -> DataFrame:
    """Ties neighbours of a node u to the smallest of u and its neighbours: those larger than u (each edge seen
    from both ends), or those smaller than u (each edge seen from its larger end) and u itself."""
    if larger_only:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Dealt anew, so that the join deals both of its sides itself and a hub can be split.
    tied = near.join(least.repartition(F.xxhash64("u")), "u")
    if larger_only:
        pairs = tied.filter("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = tied.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v")
    return pairs.filter("u >= v").distinct()
