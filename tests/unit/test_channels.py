"""The composed plan with further channels, a model and routes."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.plans.retrieval import ROUTES, Channels, Config, search_raw, search_routed


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, f"word{i} shared number{i % 3}") for i in range(12)], "id int, text string")
    vectors = spark.createDataFrame(
        [(i, [1.0 if k == i else 0.1 for k in range(12)]) for i in range(12)], "id int, embedding array<float>"
    )
    queries = vectors.where("id < 2").join(docs, "id").select(F.col("id").alias("query_id"), "text", "embedding")
    return queries.cache(), vectors, docs


def hit(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, id int, score double")


def best(frame):
    return {r.query_id: r.id for r in frame.where("rank = 1").collect()}


def test_a_sentence_hit_joins_the_dense_list_once(spark, tables):
    config = Config(top_k=3, hybrid=False)
    channels = Channels(sentences=hit(spark, (0, 7, 1.5), (0, 7, 0.2), (1, 1, 0.1)))
    got = search_raw(*tables, config, channels=channels)
    assert best(got) == {0: 7, 1: 1}
    assert got.where("id = 7 AND query_id = 0").count() == 1
    assert got.where("query_id = 1 AND id = 1").first().score > 0.9  # its own better score stays


def test_a_symbol_joins_the_lexical_list(spark, tables):
    config = Config(top_k=2, similarity_threshold=0.99)
    plain = search_raw(*tables, config)
    assert plain.where("query_id = 0 AND id = 11").isEmpty()
    got = search_raw(*tables, config, channels=Channels(symbols=hit(spark, (0, 11, 99.0))))
    row = got.where("query_id = 0 AND id = 11").first()
    assert (row["rank"], row.score) == (2, round(1 / 61, 6))
    assert best(got)[1] == 1


def test_a_sparse_hit_alone_is_judged_by_its_score(spark, tables):
    config = Config(top_k=12, hybrid=False, similarity_threshold=0.29, sparse_weight=0.3)
    few = tables[1].where("id < 6")
    got = search_raw(tables[0], few, tables[2], config, channels=Channels(sparse=hit(spark, (0, 9, 4.0), (0, 10, 2.0))))
    ids = {r.id for r in got.where("query_id = 0").collect()}
    assert 9 in ids and 10 not in ids  # 0.3 * 4 / 4 and 0.3 * 2 / 4


def test_a_model_orders_the_pool(tables):
    def by_length(query: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.extract(r"word(\d+)")[0].astype(float)

    got = search_raw(*tables, Config(top_k=2, similarity_threshold=0.0), channels=Channels(reranker=by_length))
    rows = sorted((r.query_id, r["rank"], r.id) for r in got.collect())
    for query in (0, 1):
        ids = [i for q, _, i in rows if q == query]
        assert len(ids) == 2 and ids == sorted(ids, reverse=True)


def test_routes_change_the_limits(spark, tables):
    queries, vectors, docs = tables
    texts = {0: "word0 the row of a table", 1: None}
    asked = queries.withColumn("text", F.when(F.col("query_id") == 0, texts[0]))
    got = search_routed(asked, vectors, docs, Config(top_k=2, similarity_threshold=0.0))
    found = {(r.query_id, r.route): r.n for r in got.groupBy("query_id", "route").agg(F.count("*").alias("n")).collect()}
    assert found == {(0, "table_lookup"): min(12, ROUTES["table_lookup"]["top_k"]), (1, "factual"): 2}
    assert best(got) == {0: 0, 1: 1}
    assert search_routed(asked.limit(0), vectors, docs).isEmpty()
