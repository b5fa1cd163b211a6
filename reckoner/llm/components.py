"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import stage


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the two-column table ``edges`` that is not the smallest of its component.

    Alternates large-star and small-star steps until the edges are stars. A node's smallest neighbour is an aggregate
    with partial sums and its edges are re-hung by a join that adaptive execution may split, so a node with any number of
    neighbours is never gathered in one task. Every round is staged: a lost executor costs a part of one round.
    Loops and repeated edges are ignored; edges with a null end too.
    """
    a, b = (F.col(c) for c in edges.columns)
    edges = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        edges = stage(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
