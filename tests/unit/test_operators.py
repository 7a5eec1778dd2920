"""Literal cases of the library's operators."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking, facts, fusion, graph, ingest, rerank, routing, search, windows
from skein.operators.components import connected_components
from tests.conftest import rows_of


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sentences_merge_short_pieces(spark):
    df = frame(spark, [("First sentence here. Ok! Another one follows? Yes.",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.sentences(F.col("t"))).collect()]
    assert got == [["First sentence here. Ok!", "Another one follows? Yes."], [], []]


def test_cosine_and_jaccard(spark):
    df = frame(spark, [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    df = frame(spark, [(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [0.333333, 0.0]


def test_github_addresses(spark):
    df = frame(spark, [("https://github.com/o/r/blob/main/a/b.py",), ("https://x.org/a",)], "u string")
    assert [r[0] for r in df.select(T.github_raw(F.col("u"))).collect()] == [
        "https://raw.githubusercontent.com/o/r/main/a/b.py",
        "https://x.org/a",
    ]


def test_top_k_breaks_ties_by_id(spark):
    df = frame(spark, [(1, 3, 0.5), (1, 2, 0.5), (1, 1, 0.1)], "query_id int, id int, score double")
    assert rows_of(search.top_k(df, 2).select("id", "rank")) == [(2, 1), (3, 2)]
    assert search.top_k(df, 0).isEmpty()


def test_dense_search_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)]
    vectors = frame(spark, rows, "id int, embedding array<float>")
    asked = vectors.where("id < 7").withColumnRenamed("id", "query_id")
    whole = rows_of(search.dense_search(vectors, asked, 5))
    assert rows_of(search.dense_search(vectors, asked, 5, block=2)) == whole
    best = {r.query_id: r.id for r in search.dense_search(vectors, asked, 1).collect()}
    assert best == {i: i for i in range(7)}
    assert search.dense_search(vectors, asked.limit(0), 5).isEmpty()


def test_rrf_counts_ranks_from_one_and_keeps_lexical_rows(spark):
    v = frame(spark, [(1, "a", 0.9), (1, "b", 0.8)], "query_id int, id string, score double")
    b = frame(spark, [(1, "b", 7.0), (1, "c", 5.0)], "query_id int, id string, score double")
    got = {r.id: r for r in fusion.reciprocal_rank(v, b).collect()}
    assert got["a"].score == round(1 / 61, 6) and got["b"].score == round(1 / 62 + 1 / 61, 6)
    assert got["c"].fused_only and got["c"].vector_score == 0 and not got["a"].fused_only
    assert {r.id for r in fusion.above_threshold(fusion.reciprocal_rank(v, b), 0.85).collect()} == {"a", "c"}


def test_flat_lists_normalise_to_one(spark):
    v = frame(spark, [(1, "a", 0.4), (1, "b", 0.4)], "query_id int, id string, score double")
    none = v.limit(0)
    assert {r.score for r in fusion.weighted(v, none, 0.7).collect()} == {0.7}


def test_sparse_fusion_keeps_dense_only_scores(spark):
    v = frame(spark, [(1, "a", 0.8), (1, "b", 0.4)], "query_id int, id string, score double")
    s = frame(spark, [(1, "b", 2.0), (1, "c", 4.0)], "query_id int, id string, score double")
    got = {r.id: r.score for r in fusion.with_sparse(v, s, 0.3).collect()}
    assert got == {"a": 0.8, "b": round(0.7 * 0.5 + 0.3 * 0.5, 6), "c": 0.3}


def test_mmr_drops_near_copies_and_follows_the_greedy_loop(spark):
    rows = [(1, 1, "red green blue sky", 0.9), (1, 2, "red green blue sky!", 0.8), (1, 3, "other words entirely", 0.5)]
    df = frame(spark, rows, "query_id int, id int, text string, score double")
    assert [r.id for r in rerank.mmr(df).orderBy("mmr_rank").collect()] == [1, 3]


def test_code_boost_prefers_the_symbol(spark):
    schema = "query_id int, id int, score double, text string, symbol string, qualified string, file string, symbol_type string, start_line int, end_line int"
    rows = [
        (1, 1, 0.9, "nothing", "other", "m.other", "a/x.py", "class", 1, 200),
        (1, 2, 0.5, "def load_table", "load_table", "m.load_table", "a/y.py", "function", 1, 10),
    ]
    tokens = frame(spark, [(1, "load_table")], "query_id int, token string")
    got = rerank.code_boost(frame(spark, rows, schema), tokens).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1]


def test_confidence_of_nothing_is_low(spark):
    rows = frame(spark, [], "query_id int, id int, score double, source string")
    totals = frame(spark, [(1, 5)], "query_id int, candidates long")
    got = rerank.retrieval_confidence(rows, totals).first()
    assert got.verdict == "low" and got.n == 0


@pytest.mark.parametrize("size,overlap", [(40, 10), (100, 0), (7, 3)])
def test_recursive_chunks_cover_the_text(size, overlap):
    text = "one two three\nfour five six\n\nseven eight nine ten " * 5
    chunks = chunking.recursive(text, size, overlap)
    assert all(len(c) <= size for c in chunks)
    assert set(text.split()) <= set(" ".join(chunks).split()) or size < 10
    with pytest.raises(ValueError):
        chunking.recursive(text, 10, 10)


def test_semantic_chunks_keep_all_sentences():
    text = "Dr. Smith came in. He sat down! Was it late? Yes it was. " * 10
    chunks = chunking.semantic(text, size=20, overlap=5)
    assert "Dr. Smith came in." in chunks[0]
    for sentence in chunking.split_sentences(text):
        assert any(sentence in c for c in chunks)


def test_chunk_rows_have_lineage(spark):
    df = frame(spark, [("d", "a b c d e f g h"), ("n", None)], "id string, text string")
    got = chunking.chunk(df, "recursive", size=8, overlap=0).orderBy("chunk_index").collect()
    assert [r.id for r in got] == [f"d_chunk_{i}" for i in range(len(got))]
    assert all(r.total_chunks == len(got) for r in got)


def test_sentence_window_frame(spark):
    df = frame(spark, [(1, "Sentence nil here. Sentence one here. Sentence two here. Sentence three.")], "id int, text string")
    records = windows.sentence_records(df)
    got = {r.sentence_idx: r.window for r in windows.sentence_windows(records, 1).collect()}
    assert got[2] == "Sentence one here. Sentence two here. Sentence three."
    hits = frame(spark, [(7, 1, 2, 0.9), (7, 1, 0, 0.2)], "query_id int, chunk_id int, sentence_idx int, score double")
    assert windows.best_windows(hits, records, 1).first().window == got[2]


def test_drill_down_reaches_leaves(spark):
    nodes = frame(spark, [("r", ["s", "a"]), ("s", ["b", "c"])], "id string, children_ids array<string>")
    leaves = frame(spark, [("a", 0.1), ("b", 0.9), ("c", 0.5)], "id string, score double")
    hits = frame(spark, [(1, "r", 1.0)], "query_id int, id string, score double")
    assert rows_of(windows.drill_down(hits, nodes, leaves, 2)) == [(1, "b", 0.9), (1, "c", 0.5)]


def test_ingest_keeps_copies_within_a_batch(spark):
    batch = frame(spark, [(1, "x"), (2, "x"), (3, "old")], "id int, text string")
    seen = batch.where("text = 'old'").select(F.md5("text").alias("hash"))
    assert rows_of(ingest.unseen(batch, seen).select("id")) == [(1,), (2,)]


def test_delete_by_id_or_source(spark):
    rows = frame(spark, [("a", "s1"), ("b", "s1"), ("c", "s2")], "id string, source string")
    gone = frame(spark, [("a",), ("s2",)], "id string")
    assert rows_of(ingest.delete_ids(rows, gone)) == [("s1", "b")] or rows_of(
        ingest.delete_ids(rows, gone).select("id")
    ) == [("b",)]


def test_prune_drops_empty_nodes(spark):
    nodes = frame(spark, [("n", ["1", "2"]), ("m", ["2"])], "entity string, chunk_ids array<string>")
    gone = frame(spark, [("2",)], "id string")
    assert rows_of(ingest.prune_arrays(nodes, gone)) == [("n", ["1"])]


def test_project_tree_ends_on_cycles(spark):
    rows = [("b", "a"), ("c", "b"), ("a", "c"), ("x", "y")]
    df = frame(spark, rows, "project string, parent string")
    assert rows_of(ingest.project_tree(df, "a")) == [("b",), ("c",)]


def test_dataset_types(spark):
    rows = [
        ("x", "src/a.py", "codebase"),
        ("{}", "package.json", "manifest"),
        ("x", "/docs/api/x.html", "reference"),
        ('{"role": "user"}', "a.json", "discussion"),
        ("a,b,c,d\n1,2,3,4", "t", "knowledge"),
        ("def f():\nimport x", "t", "codebase"),
        ("Abstract of it.\nReferences follow", "t", "paper"),
        ("plain", "t", "doc"),
        (None, None, "doc"),
    ]
    df = frame(spark, rows, "text string, source string, want string")
    got = df.select("want", routing.dataset_type(F.col("text"), F.col("source"))["type"]).collect()
    assert [r[1] for r in got] == [r[0] for r in got]


def test_code_tokens(spark):
    df = frame(spark, [("where is CodeSplitter in loaders.py and foo.bar_baz",)], "q string")
    got = set(df.select(routing.code_tokens(F.col("q"))).first()[0])
    assert {"codesplitter", "code", "splitter", "loaders", "foo", "bar_baz", "foo.bar_baz", "bar", "baz"} <= got


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(rows_of(connected_components(frame(spark, edges, "src int, dst int"))))
    assert got == {x: root(x) for x in parent}


def test_communities_split_two_cliques(spark):
    clique = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b]
    df = frame(spark, [*clique, ("a", "w", 0.1)], "src string, dst string, weight double")
    got = dict(rows_of(graph.communities(df)))
    assert len({got[x] for x in "abcd"}) == 1 and len({got[x] for x in "wxyz"}) == 1
    assert got["a"] != got["w"]


def test_hops_and_expansion(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    seeds = frame(spark, [(1, "a")], "query_id int, node string")
    assert rows_of(graph.hops(edges, seeds, 2)) == [(1, "a", 0), (1, "b", 1), (1, "c", 2)]
    matches = frame(spark, [(1, "a", 1.0)], "query_id int, entity string, score double")
    mentions = frame(spark, [("a", "k1"), ("b", "k2"), ("c", "k1")], "entity string, chunk_id string")
    base = frame(spark, [(1, "zz", 0.5)], "query_id int, id string, score double")
    got = rows_of(graph.expand_results(base, matches, edges, mentions).select("id", "score"))
    assert got == [("k1", 0.8), ("k2", 0.56)]


def test_parsers_of_model_lines(spark):
    lines = frame(spark, [(1, "Ann | person | an engineer\nbad\nBob | PERSON")], "chunk_id int, output string")
    assert rows_of(graph.parse_entities(lines).select("name", "type")) == [("Ann", "PERSON"), ("Bob", "PERSON")]
    lines = frame(spark, [(1, "Ann | KNOWS | Bob | met | 99\nAnn | KNOWS | Cid")], "chunk_id int, output string")
    assert rows_of(graph.parse_relations(lines).select("src", "target", "strength")) == [
        ("ann", "bob", 10.0),
        ("ann", "cid", 5.0),
    ]


def test_budget_skips_and_goes_on(spark):
    rows = [(1, "a", 1, 6), (1, "b", 2, 6), (1, "c", 3, 4)]
    df = frame(spark, rows, "query_id int, id string, rank int, cost int")
    assert rows_of(graph.fill_budget(df, 10).select("id")) == [("a",), ("c",)]
    assert rows_of(graph.prefix_budget(df, 10, F.col("cost")).select("id")) == [("a",)]


def test_fact_succession(spark):
    rows = [
        (1, "s", "2024-01-01 00:00:00"),
        (2, "s", "2024-01-02 00:00:00"),
        (3, "s", "2024-01-02 00:00:00.5"),
        (4, None, "2024-01-01 00:00:00"),
        (5, "t", "2024-01-01 00:00:00"),
    ]
    df = frame(spark, rows, "fact_id int, scope_key string, at string")
    got = {r.fact_id: r for r in facts.succession(df.withColumn("valid_at", F.col("at").cast("timestamp"))).collect()}
    assert [got[i].status for i in range(1, 6)] == ["superseded", "conflicted", "conflicted", "active", "active"]
    assert str(got[1].invalid_at) == "2024-01-02 00:00:00" and got[5].invalid_at is None


def test_orphans_are_superseded(spark):
    rows = frame(spark, [(1, "active"), (2, "active")], "fact_id int, status string")
    evidence = frame(spark, [(1,)], "fact_id int")
    assert rows_of(facts.orphans(rows, evidence)) == [(1, "active"), (2, "superseded")]


def test_symbol_search(spark):
    symbols = frame(spark, [(1, "load", "m.load"), (2, "loader", "m.loader")], "id int, symbol string, qualified string")
    asked = frame(spark, [(1, "load"), (2, "lo")], "query_id int, token string")
    assert rows_of(search.symbol_search(symbols, asked).select("id", "score")) == [(1, 1.0), (2, 0.6)]
    assert rows_of(search.symbol_search(symbols, asked, 1).select("id", "score")) == [(1, 1.0)]


def test_bm25_without_an_index_equals_the_index(spark):
    docs = frame(spark, [(1, "a b b c"), (2, "b c d"), (3, None), (4, ""), (5, "a a a"), (5, "a a a")], "id int, text string")
    asked = frame(spark, [(1, "a B"), (2, "zzz"), (3, ""), (4, "c c d")], "query_id int, text string")
    direct = search.bm25_search(docs.where("id < 5"), asked)
    assert rows_of(direct) == rows_of(search.Bm25Index.build(docs.where("id < 5")).search(asked))
    assert search.bm25_search(docs, asked, 0).isEmpty()
    assert search.bm25_search(docs, asked.limit(0)).isEmpty()
    assert search.bm25_search(docs.limit(0), asked).isEmpty()


def test_a_word_that_all_prose_says_stays_in_its_partitions(spark):
    from skein.operators.codegraph import mention_edges

    rows = [("f::load", "load"), ("g::load", "load"), ("f::keep", "keep"), ("f::two", "load"), ("f::two", "keep")]
    nodes = spark.createDataFrame([(n, "function", name) for n, name in rows] + [("f", "file", "load")], "node_id string, node_type string, name string")
    prose = spark.range(4000).selectExpr("id", "concat('see load() ', if(id % 1000 = 0, 'keep', concat('w', id)), ' load') AS text")
    edges = mention_edges(nodes, prose.union(prose.where("id < 9")))
    assert {r.source: r["count"] for r in edges.groupBy("source").count().collect()} == {"f::load": 4000, "g::load": 4000, "f::two": 4000, "f::keep": 4}
    assert "LeftAnti" in edges._jdf.queryExecution().toString()  # hot words are looked up apart
