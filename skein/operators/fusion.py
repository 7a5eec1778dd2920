"""Fusion of ranked lists. Inputs have (query_id, id, score); every query is fused apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["query_id", "id"]


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order))


def reciprocal_rank(dense: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """score = sum of 1 / (k + rank), ranks from 1; vector_score is the dense score (0 for rows
    of the lexical list alone, which are fused_only)."""
    v = ranked(dense).select(*KEYS, F.col("score").alias("vector_score"), F.col("rank").alias("rv"))
    b = ranked(lexical).select(*KEYS, F.col("rank").alias("rb"))

    def part(rank: str) -> Column:
        return F.coalesce(1 / (F.lit(k) + F.col(rank)), F.lit(0.0))

    return v.join(b, KEYS, "full_outer").select(
        *KEYS,
        F.round(part("rv") + part("rb"), 6).alias("score"),
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.col("rv").isNull().alias("fused_only"),
    )


def min_max(score: Column, window) -> Column:
    """(s - min) / (max - min); a flat list is 1 if positive, else 0."""
    low, high = F.min(score).over(window), F.max(score).over(window)
    flat = F.when(high > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(high > low, (score - low) / (high - low)).otherwise(flat)


def weighted(dense: DataFrame, lexical: DataFrame, weight: float = 0.7) -> DataFrame:
    """weight * min-max dense + (1 - weight) * min-max lexical."""
    own = Window.partitionBy("query_id")
    v = dense.select(*KEYS, F.col("score").alias("vector_score"), min_max(F.col("score"), own).alias("nv"))
    b = lexical.select(*KEYS, min_max(F.col("score"), own).alias("nb"))
    score = weight * F.coalesce("nv", F.lit(0.0)) + (1 - weight) * F.coalesce("nb", F.lit(0.0))
    return v.join(b, KEYS, "full_outer").select(
        *KEYS,
        F.round(score, 6).alias("score"),
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.col("nv").isNull().alias("fused_only"),
    )


def with_sparse(dense: DataFrame, sparse: DataFrame, weight: float = 0.3) -> DataFrame:
    """Rows of both lists mix scores over their maxima; sparse rows alone weigh ``weight``; rows
    of the dense list alone keep their score as it is."""
    own = Window.partitionBy("query_id")

    def share(score: str) -> Column:
        return F.try_divide(F.col(score), F.max(score).over(own))

    v = dense.select(*KEYS, F.col("score").alias("d"), share("score").alias("nd"))
    s = sparse.select(*KEYS, share("score").alias("ns"))
    both = (1 - weight) * F.coalesce("nd", F.lit(0.0)) + weight * F.coalesce("ns", F.lit(0.0))
    score = (
        F.when(F.col("ns").isNull(), F.col("d"))
        .when(F.col("d").isNull(), weight * F.coalesce("ns", F.lit(0.0)))
        .otherwise(both)
    )
    return v.join(s, KEYS, "full_outer").select(*KEYS, F.round(score, 6).alias("score"))


def weighted_reciprocal_rank(
    lists: dict[str, DataFrame], weights: dict[str, float], k: int = 60
) -> DataFrame:
    """Sum over the named lists of weight / (k + rank), and the rank by that sum."""
    parts = [
        ranked(rows).select(*KEYS, (F.lit(float(weights.get(name, 1.0))) / (k + F.col("rank"))).alias("s"))
        for name, rows in lists.items()
    ]
    union = reduce(DataFrame.unionByName, parts)
    return ranked(union.groupBy(*KEYS).agg(F.round(F.sum("s"), 6).alias("score")))


def best_per_id(rows: DataFrame) -> DataFrame:
    """The best-scored row of each (query_id, id); ties go to the first in ``ord`` if there."""
    order = [F.desc("score"), *([F.asc("ord")] if "ord" in rows.columns else [])]
    top = Window.partitionBy(*KEYS).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n")


def union_stores(*stores: DataFrame) -> DataFrame:
    """Hits of several stores, the best score of each id."""
    union = reduce(DataFrame.unionByName, stores)
    return union.groupBy(*KEYS).agg(F.max("score").alias("score"))


def above_threshold(rows: DataFrame, threshold: float = 0.3, hybrid_weighted: bool = False) -> DataFrame:
    """Rows that are fused_only or whose signal reaches the threshold: the score in weighted
    hybrid mode, else the vector score, each in place of the other where it is missing."""
    names = ("score", "vector_score") if hybrid_weighted else ("vector_score", "score")
    signal = F.coalesce(*names, F.lit(0.0))
    return rows.where(F.coalesce("fused_only", F.lit(False)) | (signal >= threshold))
