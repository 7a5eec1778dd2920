"""Code graphs, contexts, policies and the composed retrieval plan."""

import random

from pyspark.sql import functions as F

from skein.operators import codegraph, context, policies
from skein.plans.retrieval import Config, search_raw
from tests.conftest import rows_of


def code_chunks(spark):
    schema = "id string, file_path string, symbol_type string, symbol_name string, qualified_name string, imports array<string>"
    rows = [
        ("1", "pkg/a.py", "function", "load_rows", "load_rows", ["from pkg.b import x", "import os"]),
        ("2", "pkg/b.py", "class", "Table", "b.Table", []),
        ("3", "other/b.py", None, None, None, None),
    ]
    return spark.createDataFrame(rows, schema)


def test_code_graph(spark):
    chunks = code_chunks(spark)
    nodes = codegraph.code_nodes(chunks)
    assert {r.node_id for r in nodes.collect()} == {
        "pkg/a.py", "pkg/b.py", "other/b.py", "pkg/a.py::load_rows", "pkg/b.py::b.Table",
    }
    assert rows_of(codegraph.import_edges(chunks)) == [("pkg/a.py", "pkg/b.py", "IMPORTS")]
    prose = spark.createDataFrame([("p", "call load_rows(x) twice: load_rows"), ("q", "reload_rows")], "id string, text string")
    assert rows_of(codegraph.mention_edges(nodes, prose)) == [("pkg/a.py::load_rows", "p", "MENTIONED_IN")]
    edges = codegraph.contains_edges(chunks).union(codegraph.import_edges(chunks))
    members = nodes.join(chunks, "file_path").select("node_id", "id").distinct()
    hit = spark.createDataFrame([(1, "pkg/a.py")], "query_id int, node_id string")
    assert {r.id for r in codegraph.expand(hit, edges, members, 5).collect()} == {"1", "2"}


def test_python_facts(spark):
    text = "import os\nfrom a.b import c\nclass X(Base):\n    def m(self): pass\ndef f(): pass\n"
    files = spark.createDataFrame([("m.py", text), ("bad.py", "def ("), ("n", None)], "source string, text string")
    assert set(rows_of(codegraph.python_facts(files).select("subject", "relation", "object"))) == {
        ("m.py", "IMPORTS", "os"), ("m.py", "IMPORTS", "a.b"), ("m.py", "CONTAINS", "X"),
        ("X", "INHERITS", "Base"), ("m.py", "CONTAINS", "f"),
    }


def test_failure_labels(spark):
    schema = "query_id int, id int, symbol string, file string, start_line int, end_line int, is_fallback boolean"
    rows = spark.createDataFrame([(1, 1, "g", "a.py", 1, 500, True)], schema)
    want = spark.createDataFrame([(1, "f", "a.py"), (2, "f", "a.py")], "query_id int, symbol string, file string")
    assert rows_of(codegraph.retrieval_failures(rows, want)) == [(1, True, True, True, True), (2, True, False, False, False)]


def test_context_and_citations(spark):
    rows = spark.createDataFrame([(1, 1, "a", "one", 0.9), (1, 2, "b", "two", 0.8)], "query_id int, rank int, id string, text string, score double")
    assert context.build_context(rows).first().context == "[Document 1]\none\n\n[Document 2]\ntwo"
    answers = spark.createDataFrame([(1, "As [1] and [Document 2, p. 3] and [9] say [1].")], "query_id int, answer string")
    assert rows_of(context.citations(answers, rows)) == [(1, 1, 2, "a"), (1, 2, 1, "b")]
    long = rows.withColumn("text", F.repeat(F.lit("x"), 600))
    assert {len(r.text) for r in context.slim_sources(long).collect()} == {501}


def test_compression_never_lengthens(spark):
    rows = spark.createDataFrame([(1, "q", "abc def")], "query_id int, query_text string, text string")
    longer = context.compress(rows, lambda q, t: t + t)
    assert longer.first().text == "abc def"
    shorter = context.compress(rows, lambda q, t: t.str[:3])
    assert shorter.first().text == "abc"
    assert context.compression_ratio(rows, shorter).first().ratio == 0.0
    text = F.lit("Cats sleep a lot. Dogs run in parks. Birds fly over parks and cats.")
    kept = spark.range(1).select(context.extract_sentences(F.lit("cats parks"), text, 1)).first()[0]
    assert kept == "Cats sleep a lot."


def test_query_variants_are_distinct(spark):
    queries = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    got = context.query_variants(queries, lambda s: s.map(lambda t: [t, t + " c"]))
    assert rows_of(got) == [(1, 0, "a b"), (1, 1, "a b c")]
    assert context.query_variants(queries).count() == 1


def test_reports(spark):
    reports = spark.createDataFrame([("r", "x" * 25), ("s", "")], "id string, text string")
    assert [r.chunk for r in context.report_chunks(reports, 10).orderBy("part").collect()] == ["x" * 10, "x" * 10, "x" * 5]
    points = spark.createDataFrame([(1, "p", 90), (1, "q", 10)], "query_id int, point string, score int")
    assert rows_of(context.best_points(points).select("point")) == [("p",)]
    queries = spark.createDataFrame([(1, "red car")], "query_id int, text string")
    found = context.relevance(spark.createDataFrame([("a", "red car here"), ("b", "red"), ("c", "no")], "id string, text string"), queries)
    assert rows_of(found.select("id", "score")) == [("a", 1.0), ("b", 0.5)]


def test_policies(spark):
    kinds = spark.createDataFrame([("paper",), ("knowledge",), ("discussion",), (None,)], "kind string")
    got = {r.kind for r in kinds.where(policies.allowed(F.col("kind"), "summaries")).collect()}
    assert got == {"paper", None}
    chunks = spark.createDataFrame([("a", "x" * 100, None), ("a", "s", 1), ("b", "y", None)], "source string, text string, raptor_level int")
    assert {r.source for r in policies.large_sources(chunks, 50 / 1024 / 1024).collect()} == {"a"}
    assert rows_of(policies.skip_leaves(chunks.union(chunks.where("source = 'a'")), 2).select("source", "raptor_level")) == [
        ("a", 1), ("a", 1), ("b", None),
    ]
    rows = spark.createDataFrame([("e", "one", 1), ("e", "two", 2), ("e", "one", 3), ("f", "x", 1)], "entity string, description string, chunk_id int")
    assert rows_of(policies.conflicting_descriptions(rows)) == [("e", ["one", "two"])]
    assert rows_of(kinds.where(policies.matches({"kind": "paper"}))) == [("paper",)]


def test_retrieval_plan(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, f"word{i} shared text number {i}") for i in range(40)], "id int, text string")
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(30)], "id int, embedding array<float>")
    queries = vectors.where("id < 3").join(docs, "id").select(F.col("id").alias("query_id"), "text", "embedding")
    for config in (Config(), Config(hybrid_mode="weighted"), Config(hybrid=False), Config(mmr=True)):
        got = search_raw(queries, vectors, docs, config.with_overrides(top_k=5, nothing=1, mmr=None))
        best = {r.query_id: r.id for r in got.where("rank = 1").collect()}
        assert best == {0: 0, 1: 1, 2: 2}
        assert got.groupBy("query_id").count().where("count > 5").isEmpty()
    more = spark.createDataFrame([(0, 39, 0.5)], "query_id int, id int, score double")
    got = search_raw(queries, vectors, docs, Config(top_k=2), expanded=more)
    assert {r.id for r in got.where("expanded").collect()} == {39}
