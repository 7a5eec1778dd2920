"""What one task holds and hands on does not grow with what it reads."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.operators import batches, chunking, context, graph, search
from skein.operators.batches import text_slices
from skein.operators.lexical_store import LexicalStore
from skein.plans import graphs, splitting
from tests.conftest import SMALL, rows_of

TEXTS = [(i, None if i % 11 == 0 else " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(60)]


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_search_by_an_index_shuffles_hits_alone(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w16"), (2, "w3")], "query_id long, text string")
    index = search.Bm25Index.build(docs)
    assert exchanges(index.search(asked)) == 1  # the best of each query
    assert exchanges(index.postings) == 0
    assert rows_of(index.search(asked)) == rows_of(search.bm25_search(docs, asked))


def test_an_index_of_flat_postings_finds_the_same(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w16"), (2, "w3"), (3, None)], "query_id long, text string")
    index = search.Bm25Index.build(docs)
    flat = search.Bm25Index(index.postings, index.terms, index.stats)
    saved = search.Bm25Index.of(index.bags, index.terms, index.stats)
    assert rows_of(flat.search(asked)) == rows_of(index.search(asked)) == rows_of(saved.search(asked, block=1))


def test_a_lexical_store_writes_a_row_for_each_document(spark, tmp_path):
    store = LexicalStore(spark, str(tmp_path))
    store.add(spark.createDataFrame(TEXTS, "id long, text string"))
    assert sorted(p.name for p in (tmp_path / "generation=1").iterdir()) == ["docs", "gone"]
    told = store.part([1], "docs")
    assert told.count() == len(TEXTS)
    assert told.where(F.size("terms") != F.size("tfs")).count() == 0
    assert told.agg(F.sum("dl")).first()[0] == sum(len((t or "").split()) for _, t in TEXTS)


def test_the_best_of_many_batches_are_k_rows_a_query():
    draw = np.random.default_rng(3)
    scores = np.round(draw.integers(-3, 9, (500, 7)) / 4, 6)
    ids = draw.permutation(500)
    for positive in (False, True):
        best = search.Best(pa.array(np.arange(7) * 10), 5, ["query_id", "id", "score"], positive)
        for at in range(0, 500, 13):
            best.add(scores[at : at + 13], pa.array(ids[at : at + 13]))
            best.rank()
        got = [tuple(r.values()) for batch in best.batches(4) for r in batch.to_pylist()]
        want = []
        for q in range(7):
            ranked = sorted((-s, i) for s, i in zip(scores[:, q], ids, strict=True) if s > 0 or not positive)
            want += [(10 * q, i, -s) for s, i in ranked[:5]]
        assert sorted(got) == sorted(want)


def test_texts_are_taken_in_pieces_of_bounded_size():
    rng = random.Random(4)
    texts = [None if rng.random() < 0.1 else "é" * rng.choice([0, 1, 30, 400]) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(300)), "text": texts})
    pieces = list(text_slices(iter([batch, batch.slice(0, 0), batch.slice(7, 90)]), most=500))
    assert [x for p in pieces for x in p["text"].to_pylist()] == texts + texts[7:97]
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= 500 for p in pieces)


def test_splitters_take_texts_in_pieces(spark):
    docs = spark.createDataFrame([(i, "One two. " * (i % 5)) for i in range(40)] + [(90, None)], "id long, text string")
    split = chunking.chunk(docs, "recursive", size=12, overlap=2)
    assert "MapInArrow" in split._jdf.queryExecution().executedPlan().toString()  # which pieces need: a pandas function must answer batch by batch
    want = [(i, c) for i in range(40) for c in chunking.recursive("One two. " * (i % 5), 12, 2)]
    assert rows_of(split.select("source_id", "chunk")) == sorted(want, key=repr)


def test_files_made_of_few_rows_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(splitting, "TASK_FILES", 50)
    assert splitting.files(spark, SMALL).rdd.getNumPartitions() == 1 + 200 // 50


def test_relations_are_merged_in_parts_of_bounded_size(spark, monkeypatch):
    whole = rows_of(graph.merge_relations(graphs.relations(spark, SMALL)))
    monkeypatch.setattr(batches, "PART_ROWS", 200)
    rows = graphs.relations(spark, SMALL)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    parts = rows.withColumn("part", F.spark_partition_id())
    assert lines == rows.count() and rows.rdd.getNumPartitions() >= lines / 200
    assert parts.groupBy("chunk_id").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    assert max(r["count"] for r in parts.groupBy("part").count().collect()) < 400
    assert rows_of(graph.merge_relations(rows)) == whole


def test_relevance_hands_on_the_best_rows_of_each_task(spark):
    docs = spark.createDataFrame([*TEXTS, (7, "w1 w1 w2"), (60, "w3 W16")], "id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "w1 w2 w16"), (2, "w3 w3"), (3, None), (4, "")], "query_id long, text string")
    whole, want = rows_of(context.shared_words(docs, asked)), []
    for query in {q for q, _, _ in whole}:
        best = sorted((-s, i) for q, i, s in whole if q == query)[:3]
        want += [(query, i, -s, rank + 1) for rank, (s, i) in enumerate(best)]
    got = context.relevance(docs, asked, 3)
    assert rows_of(got) == rows_of(context.relevance(docs, asked, 3, block=1)) == sorted(want, key=repr)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
