"""One scan of words and vectors against the two searches apart."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import fusion, search
from skein.operators.hybrid_store import HybridStore
from tests.conftest import rows_of

QUERIES = "query_id int, text string, embedding array<double>"


def made(rng, n):
    words = [f"w{i}" for i in range(40)]
    docs = [(i, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 30)))])) for i in range(n)]
    vectors = [(i, None if i % 17 == 0 else [rng.uniform(-1, 1) for _ in range(6)]) for i in range(n // 3, n + 20)]
    asked = [(i, " ".join(rng.choices([*words, "absent"], k=5)), [rng.uniform(-1, 1) for _ in range(6)]) for i in range(9)]
    asked += [(20, None, [1.0] * 6), (21, "w1 w1 W2", None), (22, "absent", None), (23, None, None)]
    return docs, vectors, asked


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs, vectors, asked = made(random.Random(5), 300)
    store = HybridStore(spark, str(tmp_path_factory.mktemp("hybrid")), buckets=4, id_type="int")
    frames = (
        spark.createDataFrame(docs, "id int, text string").repartition(5),
        spark.createDataFrame(vectors, "id int, embedding array<double>").repartition(3),
        spark.createDataFrame(asked, QUERIES),
    )
    store.build(frames[0].withColumn("bucket", F.lit("x")), frames[1].withColumn("text", F.lit(0)))
    return store, frames


@pytest.mark.parametrize("block", [1000, 4])
def test_same_hits_as_two_searches(stored, block):
    store, (docs, vectors, asked) = stored
    hits = store.hits(asked, 7, block=block)
    names = ["query_id", "id", "score", "rank"]
    dense = search.dense_search(vectors, asked.where("embedding IS NOT NULL"), 7)
    lexical = search.bm25_search(docs, asked, 7)
    assert rows_of(hits.where("kind = 'dense'").select(names)) == rows_of(dense.select(names))
    assert rows_of(hits.where("kind = 'lexical'").select(names)) == rows_of(lexical.select(names))
    fused = fusion.reciprocal_rank(dense, lexical)
    assert rows_of(store.search(asked, 7, block=block)) == rows_of(fused)
    assert rows_of(store.search(asked, 7, weight=0.7)) == rows_of(fusion.weighted(dense, lexical, 0.7))


def test_one_scan_of_the_rows(stored):
    store, (_, _, asked) = stored
    plan = store.hits(asked, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "text" not in store.rows().columns


def test_buckets_hold_all_and_can_be_asked_apart(stored):
    store, (_, _, asked) = stored
    apart = [store.hits(asked, 1000, buckets=[i]).drop("rank") for i in range(4)]
    union = apart[0].union(apart[1]).union(apart[2]).union(apart[3])
    assert rows_of(union) == rows_of(store.hits(asked, 1000).drop("rank"))


def test_empty_store_and_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None)], "id int, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0])], "id int, embedding array<double>")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0])], QUERIES)
    store = HybridStore(spark, str(tmp_path / "few"), id_type="int")
    store.build(docs, vectors)
    got = rows_of(store.hits(asked, 5).select("kind", "id", "rank"))
    assert got == [("dense", 1, 1), ("lexical", 1, 1)]
    assert store.hits(asked.limit(0), 5).count() == 0
    empty = HybridStore(spark, str(tmp_path / "none"), id_type="int")
    empty.build(docs.limit(0), vectors.limit(0))
    assert empty.search(asked, 5).count() == 0
