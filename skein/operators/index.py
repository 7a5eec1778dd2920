"""An inverted-file index over vectors, and the hooks that make vectors of texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.search import CELLS, Best, matrix, top_k, unit_rows

#: Vectors that the centroids are fitted to, whatever the table's size.
SAMPLE = 20_000


def embed(docs: DataFrame, model: Callable[[pd.Series], pd.Series], text_col: str = "text") -> DataFrame:
    """``docs`` with an embedding by an injected model of texts, in Arrow batches; null texts are
    embedded as empty ones."""
    return docs.withColumn("embedding", F.pandas_udf(model, "array<float>")(F.coalesce(text_col, F.lit(""))))


def encode_sparse(docs: DataFrame, model: Callable[[pd.Series], pd.Series], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, weight) by an injected model that returns a dictionary of weights for each text;
    weights that are not positive are left out."""
    weights = F.pandas_udf(lambda texts: model(texts).map(dict.items).map(list), "array<struct<term:string,weight:double>>")
    rows = docs.select(F.col(id_col).alias("id"), F.explode(weights(F.coalesce(text_col, F.lit("")))).alias("w"))
    return rows.select("id", "w.term", "w.weight").where("weight > 0")


def fit_centroids(vectors: DataFrame, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centroids by k-means of at most ``sample`` vectors, the least by hash of their id. Their
    number follows the table's: one for 500 rows, between 8 and 256."""
    parts = min(256, max(8, vectors.count() // 500))
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()
    points = unit_rows(matrix(rows["embedding"]))
    centroids = points[np.linspace(0, len(points) - 1, min(parts, len(points))).astype(int)] if len(points) else points
    for _ in range(rounds if len(points) else 0):
        own = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids = np.where(np.bincount(own, minlength=len(centroids))[:, None] > 0, unit_rows(sums), centroids)
    return centroids


class VectorIndex:
    """All vectors with the number of their nearest centroid (id, embedding, part).

    Every row is indexed; only the centroids come from a sample. ``save`` writes a folder by part,
    so that a search of few queries reads few parts.
    """

    def __init__(self, rows: DataFrame, centroids: np.ndarray):
        self.rows, self.centroids = rows, centroids

    @classmethod
    def build(cls, vectors: DataFrame, sample: int = SAMPLE) -> VectorIndex:
        rows = vectors.select("id", "embedding")
        centroids = fit_centroids(rows, sample)
        shared = rows.sparkSession.sparkContext.broadcast(centroids)

        def assign(batches):
            for batch in batches:
                own = unit_rows(matrix(batch["embedding"]))
                part = (own @ shared.value.T).argmax(axis=1) if len(own) and own.shape[1] else np.zeros(len(own))
                yield batch.append_column("part", pa.array(part.astype(np.int32)))

        schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])
        return cls(rows.mapInArrow(assign, schema), centroids)

    def save(self, folder: str) -> None:
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows")
        lists = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(lists, "part int, centroid array<double>").write.mode("overwrite").parquet(f"{folder}/centroids")

    @classmethod
    def load(cls, spark, folder: str) -> VectorIndex:
        found = spark.read.parquet(f"{folder}/centroids").orderBy("part").toArrow()
        return cls(spark.read.parquet(f"{folder}/rows"), matrix(found["centroid"]))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """(query_id, id, score, rank) by cosine among the ``probes`` parts whose centroids are
        nearest to each query; exact within them. The stated queries are collected."""
        asked = queries.select("query_id", "embedding").toArrow()
        weights = unit_rows(matrix(asked["embedding"]))
        few = min(probes, len(self.centroids))
        probed = np.argsort(-(weights @ self.centroids.T), axis=1)[:, :few] if len(asked) and few else np.zeros((len(asked), 0), int)
        names = asked["query_id"].combine_chunks()
        schema = queries.select("query_id").schema.add("id", self.rows.schema["id"].dataType).add("score", "double")
        wanted = sorted(set(probed.ravel().tolist()))
        shared = self.rows.sparkSession.sparkContext.broadcast((names, weights, probed))

        def score(batches):
            names, weights, probed = shared.value
            order = np.argsort(probed, axis=None, kind="stable")
            part_of, who_of = probed.ravel()[order], order // max(1, probed.shape[1])
            best = Best(names, k, schema.names)
            for batch in batches:
                part = batch["part"].to_numpy()
                for p in np.unique(part):
                    who = who_of[np.searchsorted(part_of, p) : np.searchsorted(part_of, p, side="right")]
                    own = pa.array(np.flatnonzero(part == p))
                    step = max(1, CELLS // max(1, len(who)))
                    for at in range(0, len(own) if len(who) else 0, step):
                        few = own[at : at + step]
                        near = unit_rows(matrix(batch["embedding"].take(few)))
                        best.add(np.round(near @ weights[who].T, 6), batch["id"].take(few), who)
            yield from best.batches()

        rows = self.rows.where(F.col("part").isin(wanted)) if wanted else self.rows.limit(0)
        return top_k(rows.mapInArrow(score, schema), k)
