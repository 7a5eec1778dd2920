"""Queries over a store that keeps words and vectors side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.hybrid_store import HybridStore
from skein.plans import ranking
from skein.plans.incremental import folder
from skein.plans.registry import registry, table

QUERIES, query = registry()


def store(spark: SparkSession, sf_dir: str) -> HybridStore:
    """Documents and the vectors that share their ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    built = HybridStore(spark, folder(spark, "hybrid"))
    built.build(docs, ranking.vectors(spark, sf_dir).select("id", "embedding"))
    return built


def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts and the vectors that ask, by shared number; either may be alone."""
    texts = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("query_id"), "text")
    return texts.join(ranking.vector_queries(spark, sf_dir), "query_id", "full_outer")


@query(ranking.QUERIES["rrf_fusion"][1])
def hybrid_store_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fusing the two searches by rank gives, from one scan."""
    return store(spark, sf_dir).search(both_sides(spark, sf_dir))


@query(ranking.QUERIES["weighted_fusion"][1])
def hybrid_store_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fusing the two searches by weight gives, from one scan."""
    return store(spark, sf_dir).search(both_sides(spark, sf_dir), weight=0.7)
