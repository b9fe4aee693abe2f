"""Connected components of links between long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import BROADCAST_ROWS, table, with_known


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """a, b, m of edges(a, b) and least(a, m, n: edges of a); least is broadcast at once if the number n of edges bounds it."""
    told = edges.join(F.broadcast(least), "a") if 2 * n <= BROADCAST_ROWS else with_known(edges, table(least), ["a"], "n")
    return told.select("a", "b", "m")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b) -> (node, component): the least id that a node reaches, for nodes with a link to another.

    Each round writes its edges to the shared folder, so a lost executor costs a round at most. Minima are aggregated
    partially and joined back, those of nodes with many neighbours by broadcast; no task holds a node's neighbours.
    """
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = with_least(both, least, state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = with_least(large, least, state[0])
        pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        edges = table(joined.select(pairs.alias("p")).select("p.a", "p.b").where("a <> b").distinct())
        was, state = state, _state(edges)
        if state == was:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("the links did not settle")
