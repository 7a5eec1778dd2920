"""A store of documents with words and vectors side by side: one scan scores both."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import tokens
from skein.operators import fusion
from skein.operators.quantized import wide
from skein.operators.search import K1, B, Best, add_up, bags, incidence, slices, top_k, unit_rows
from skein.session import cut_lineage


class HybridStore:
    """A folder that tasks share, with ``rows`` (bucket, id, embedding, dl, terms, tfs), filed by the
    hash of their id, and ``terms`` (term, df), filed by the hash of the term.

    A row has all that both searches want of a document: its vector and, instead of its text, its
    different words with their counts. A search reads the rows once: each batch is scored against
    the queries' vectors and their words, and hands on its best rows of either kind. With ``buckets``
    given to a search, only those buckets' documents are scored, by statistics of all.

    ``build`` takes documents (id, text) and vectors (id, embedding). An id may be in one of them
    only: without a text it is no document (it is not counted, nor found by words), without a vector
    it is not found by vector. A null text has no words but counts; a null vector is a zero vector.
    Null ids are ignored; ids and vectors are of one type each. Of rows that repeat an id the greatest text and the greatest vector count.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, id_type: str = "long", vector_type: str = "array<double>"):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.schema = f"id {id_type}, embedding {vector_type}, vector boolean, dl long, terms array<string>, tfs array<long>, bucket int"

    def build(self, docs: DataFrame, vectors: DataFrame) -> None:
        texts = docs.where("id IS NOT NULL").groupBy("id").agg(F.max("text").alias("text"))
        lexical = bags(texts)
        near = vectors.where("id IS NOT NULL").groupBy("id").agg(F.max("embedding").alias("embedding")).withColumn("vector", F.lit(True))
        both = lexical.join(near, "id", "full_outer").select(
            "id", "embedding", F.coalesce("vector", F.lit(False)).alias("vector"), "dl",
            F.when(F.size("terms") > 0, F.col("terms")).alias("terms"), F.when(F.size("terms") > 0, F.col("tfs")).alias("tfs"),
            F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket"),
        )
        types = {f.name: f.dataType for f in T.StructType.fromDDL(self.schema)}
        both = both.select(*[F.col(c).cast(types[c]).alias(c) for c in both.columns])
        both.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows")
        written = self.rows()
        df = written.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.folder}/terms")
        stats = written.where("dl IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/stats")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def hits(self, queries: DataFrame, k: int = 50, buckets: list[int] | None = None, k1: float = K1, b: float = B, block: int = 1000) -> DataFrame:
        """(query_id, kind, id, score, rank): the k best by vector (kind ``dense``: cosine) and by words
        (``lexical``: positive BM25) of stated queries (query_id, text, embedding), null where a query
        has no such side. Queries are broadcast in blocks of about ``block``, with the terms of each."""
        rows = self.rows()
        wanted = (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select("id", "embedding", "vector", "dl", "terms", "tfs")
        stats = self.spark.read.parquet(f"{self.folder}/stats").first()
        average = stats.words / stats.n if stats.n else 0.0
        fields = [queries.schema["query_id"], T.StructField("kind", T.StringType()), rows.schema["id"], T.StructField("score", T.DoubleType())]
        schema = T.StructType(fields)
        blocks = max(1, -(-queries.count() // block))
        found = None
        for number in range(blocks):
            part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
            near = wanted.mapInArrow(self.scorer(part, k, stats.n, average, k1, b, schema.names), schema)
            found = near if found is None else found.unionByName(near)
        best = top_k(found.select(F.struct("query_id", "kind").alias("asked"), "id", "score"), k, query="asked")
        return best.select("asked.query_id", "asked.kind", "id", "score", "rank")

    def scorer(self, queries: DataFrame, k: int, n: int, average: float, k1: float, b: float, columns: list[str]):
        """A function of Arrow batches of rows that gives their best rows for one block of queries."""
        asked = queries.select("query_id", "embedding", F.array_distinct(tokens(F.col("text"))).alias("terms"))
        asked = cut_lineage(asked)
        words = asked.select(F.explode("terms").alias("term")).distinct()
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        known = self.spark.read.parquet(f"{self.folder}/terms").join(F.broadcast(words), "term").select("term", idf.alias("idf"))
        weight = {r.term: (i, r.idf) for i, r in enumerate(known.orderBy("term").collect())}  # terms of one block
        block = asked.toArrow()
        names = block["query_id"].combine_chunks()
        seeing = np.flatnonzero(np.array(block["embedding"].is_valid()))
        against = unit_rows(wide(block["embedding"].take(pa.array(seeing)), 0))
        lists = [[weight[t][0] for t in terms or () if t in weight] for terms in block["terms"].to_pylist()]
        saying = np.array([i for i, terms in enumerate(lists) if terms], np.int64)
        lists = [lists[i] for i in saying]
        place = {t: i for t, (i, _) in weight.items()}
        idfs = np.array([v for _, v in weight.values()])
        shared = self.spark.sparkContext.broadcast((names.take(pa.array(seeing)), against, names.take(pa.array(saying)), lists, place, idfs))

        def dense(batch, best, against):
            own = batch.filter(batch["vector"])
            if own.num_rows and len(against):
                best.add(np.round(unit_rows(wide(own["embedding"], against.shape[1])) @ against.T, 6), own["id"])

        def lexical(batch, best, has, asking, known, idfs):
            own = batch.filter(batch["terms"].is_valid())
            if not (own.num_rows and asking):
                return
            sizes = pc.list_value_length(own["terms"]).to_numpy(zero_copy_only=False)
            at = pc.index_in(own["terms"].flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
            tf = own["tfs"].flatten().to_numpy(zero_copy_only=False)
            row, held = np.repeat(np.arange(own.num_rows), sizes), at >= 0
            row, at, tf = row[held], at[held], tf[held]
            length = own["dl"].to_numpy(zero_copy_only=False)
            norm = k1 * (1 - b + b * length / average) if average else np.full(len(length), k1)
            scores = add_up(row, at, idfs[at] * tf * (k1 + 1) / (tf + norm[row]), has, (own.num_rows, asking))
            best.add(np.round(scores, 6), own["id"])

        def score(batches):
            seeing, against, saying, lists, place, idfs = shared.value
            known = pa.array(list(place), pa.string())
            near, said = Best(seeing, k, ["query_id", "id", "score"]), Best(saying, k, ["query_id", "id", "score"], positive=True)
            has = incidence(lists, len(idfs))
            for batch in slices(batches, max(len(has[1]), len(seeing), len(saying))):
                dense(batch, near, against)
                lexical(batch, said, has, len(lists), known, idfs)
            for best, kind in ((near, "dense"), (said, "lexical")):
                for rows in best.batches():
                    kinds = pa.array([kind] * rows.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([rows["query_id"], kinds, rows["id"], rows["score"]], names=columns)

        return score

    def search(self, queries: DataFrame, k: int = 50, weight: float | None = None, **options) -> DataFrame:
        """The two lists of one scan, fused by reciprocal rank or, with ``weight``, by weighted scores."""
        hits = cut_lineage(self.hits(queries, k, **options))
        dense, lexical = (hits.where(F.col("kind") == kind).select("query_id", "id", "score") for kind in ("dense", "lexical"))
        return fusion.reciprocal_rank(dense, lexical) if weight is None else fusion.weighted(dense, lexical, weight)
