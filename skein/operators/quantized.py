"""A product-quantised index over vectors: short codes are scanned, few vectors are scored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import cosine
from skein.operators.index import SAMPLE
from skein.operators.search import Best, matrix, slices, top_k, unit_rows

#: Codewords of a part of a vector: a byte names one.
WORDS = 256


def fit_codebooks(vectors: DataFrame, parts: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Codewords (parts, WORDS, width of a part) by k-means of at most ``sample`` unit vectors, those of
    least hash of their id. A width that ``parts`` does not divide is filled up with zeros."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()
    points = in_parts(unit_rows(wide(rows["embedding"], parts)), parts)
    books = np.zeros((parts, WORDS, points.shape[2]))
    for part in range(parts):
        own = points[:, part]
        words = own[np.linspace(0, max(0, len(own) - 1), WORDS).astype(int)] if len(own) else books[part]
        for _ in range(rounds if len(own) else 0):
            near = nearest(own, words)
            sums, sizes = np.zeros_like(words), np.bincount(near, minlength=WORDS)
            np.add.at(sums, near, own)
            words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
        books[part] = words
    return books


def wide(column, least: int) -> np.ndarray:
    """A column of lists as a matrix of at least ``least`` columns; null lists are zero vectors."""
    rows = matrix(column) if column.null_count < len(column) else np.zeros((len(column), 0))
    return np.pad(rows, ((0, 0), (0, max(0, least - rows.shape[1]))))


def in_parts(rows: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into ``parts`` equally wide parts: (rows, parts, width)."""
    width = -(-rows.shape[1] // parts)
    return np.pad(rows, ((0, 0), (0, parts * width - rows.shape[1]))).reshape(len(rows), parts, width)


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The number of the codeword nearest to each point."""
    return ((words * words).sum(axis=1) - 2 * points @ words.T).argmin(axis=1)


class QuantizedIndex:
    """Vectors (id, embedding) and a code (id, code) for each: a byte a part of the unit vector, the
    number of its nearest codeword.

    Every row is coded where it lies; only the codewords come from a sample. A search reads the codes
    alone, a sixteenth of the vectors or less, adds up what each part's codeword scores against the
    query, and gives the best ``rerank`` rows a query their exact cosines. ``save`` writes codes,
    vectors and codewords, so that searches do not code anew.

    Null vectors count as zero vectors. Repeated ids are rows of their own. An empty table finds
    nothing.
    """

    def __init__(self, codes: DataFrame, vectors: DataFrame, books: np.ndarray):
        self.codes, self.vectors, self.books = codes, vectors, books

    @classmethod
    def build(cls, vectors: DataFrame, parts: int = 16, sample: int = SAMPLE) -> QuantizedIndex:
        rows = vectors.select("id", "embedding")
        books = fit_codebooks(rows, parts, sample)
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def code(batches):
            for batch in batches:
                books = shared.value
                own = wide(batch["embedding"], books.shape[0] * books.shape[2])
                cut = in_parts(unit_rows(own), len(books))
                codes = np.stack([nearest(cut[:, i], books[i]) for i in range(len(books))], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

        schema = T.StructType([rows.schema["id"], T.StructField("code", T.BinaryType())])
        return cls(rows.mapInArrow(code, schema), rows, books)

    def save(self, folder: str) -> None:
        self.codes.write.mode("overwrite").parquet(f"{folder}/codes")
        self.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
        books = [(i, book.ravel().tolist()) for i, book in enumerate(self.books)]
        frame = self.vectors.sparkSession.createDataFrame(books, "part int, words array<double>")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/books")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> QuantizedIndex:
        books = spark.read.parquet(f"{folder}/books").orderBy("part").toArrow()
        words = matrix(books["words"])
        return cls(spark.read.parquet(f"{folder}/codes"), spark.read.parquet(f"{folder}/vectors"), words.reshape(len(words), WORDS, -1))

    def candidates(self, queries: DataFrame, rerank: int, block: int = 1000) -> DataFrame:
        """(query_id, id) of the ``rerank`` rows whose codes score best; the stated queries (query_id,
        embedding) are broadcast in blocks of about ``block``."""
        context = self.codes.sparkSession.sparkContext
        schema = queries.select("query_id").schema.add("id", self.codes.schema["id"].dataType).add("score", "double")
        blocks = max(1, -(-queries.count() // block))
        found = self.codes.limit(0).mapInArrow(lambda batches: iter(()), schema)
        for number in range(blocks):
            asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", "embedding").toArrow()
            if not len(asked):
                continue
            wanted = unit_rows(wide(asked["embedding"], self.books.shape[0] * self.books.shape[2]))
            # what each codeword adds to the score of each query
            told = np.einsum("qpw,pkw->pkq", in_parts(wanted, len(self.books)), self.books)
            shared = context.broadcast((asked["query_id"].combine_chunks(), told))

            def score(batches, shared=shared):
                names, told = shared.value
                best = Best(names, rerank, schema.names)
                for batch in slices(batches, len(names)):
                    codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(batch.num_rows, len(told))
                    scores = np.zeros((batch.num_rows, len(names)))
                    for part in range(len(told)):
                        scores += told[part][codes[:, part]]
                    best.add(scores, batch["id"])
                yield from best.batches()

            found = found.unionByName(self.codes.mapInArrow(score, schema))
        return top_k(found, rerank).select("query_id", "id")

    def search(self, queries: DataFrame, k: int = 10, rerank: int = 50) -> DataFrame:
        """(query_id, id, score, rank): the k best by exact cosine of the ``rerank`` best by code."""
        few = self.candidates(queries, rerank).distinct()
        pairs = few.join(self.vectors, "id").join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")
        score = F.round(F.coalesce(cosine(F.col("embedding"), F.col("asked")), F.lit(0.0)), 6)
        return top_k(pairs.select("query_id", "id", score.alias("score")), k)
