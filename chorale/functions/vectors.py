"""Vectors as array columns and as rows: norms, cosines, means, the relational parts of clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Of unit length; an error if it is shorter than 1e-8."""
    n = norm(a)
    return F.when(n < 1e-8, F.raise_error(F.lit("the vector has no direction")).cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mean_pool(vectors: DataFrame, key: str, column: str = "embedding", dim: int = 64) -> DataFrame:
    """key, pooled: the mean vector of a key, one partial sum for each dimension before the shuffle."""
    means = [F.avg(F.col(column)[i].cast("double")).alias(f"_{i}") for i in range(dim)]
    return vectors.groupBy(key).agg(*means).select(key, F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("pooled"))


def pair_cosines(vectors: DataFrame, block: str, least: float = -2.0) -> DataFrame:
    """block, a, b, cosine of all pairs inside a block (clip), a < b; blocks are meant to be small."""
    v = vectors.select(F.col(block).alias("block"), "vec_id", F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding"))).alias("u"))
    left, right = v.select("block", F.col("vec_id").alias("a"), F.col("u").alias("ua")), v.select("block", F.col("vec_id").alias("b"), F.col("u").alias("ub"))
    pairs = left.join(right, "block").where("a < b").select("block", "a", "b", dot(F.col("ua"), F.col("ub")).alias("cosine"))
    return pairs.where(F.col("cosine") >= least)


def nearest(vectors: DataFrame, block: str) -> DataFrame:
    """vec_id, other, cosine: each vector's most similar other one in its block; the lower id wins a tie."""
    p = pair_cosines(vectors, block)
    both = p.select(F.col("a").alias("vec_id"), F.col("b").alias("other"), "cosine").unionByName(p.select(F.col("b").alias("vec_id"), F.col("a").alias("other"), "cosine"))
    return both.groupBy("vec_id").agg(F.max(F.struct("cosine", (-F.col("other")).alias("o"))).alias("m")).select("vec_id", (-F.col("m.o")).alias("other"), "m.cosine")


def affinity_degree(vectors: DataFrame, block: str) -> DataFrame:
    """vec_id, degree: the sum of its cosines to others of its block, negative ones as 0."""
    p = pair_cosines(vectors, block).withColumn("w", F.greatest("cosine", F.lit(0.0)))
    both = p.select(F.col("a").alias("vec_id"), "w").unionByName(p.select(F.col("b").alias("vec_id"), "w"))
    return both.groupBy("vec_id").agg(F.sum("w").alias("degree"))


def kmeans_step(vectors: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """vec_id, centre, distance: one Lloyd assignment to a few centres, which stand in the plan; the lower number wins a tie."""
    x = F.col("embedding")
    apart = [F.struct(F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("distance"), F.lit(i).alias("centre")) for i, c in centres]
    return vectors.select("vec_id", F.array_min(F.array(*apart)).alias("m")).select("vec_id", "m.centre", "m.distance")


def compact_labels(labels: DataFrame, order: str, label: str = "label", most: int = 400_000) -> DataFrame:
    """Adds compact: labels numbered from 0 by first appearance in order.

    One window ranks the distinct labels, two numbers each; they are broadcast if they were counted to be at most `most`.
    """
    ranked = labels.groupBy(label).agg(F.min(order).alias("_first"))
    ranked = ranked.select(label, (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("compact"))
    return labels.join(F.broadcast(ranked) if labels.select(label).distinct().count() <= most else ranked, label)
