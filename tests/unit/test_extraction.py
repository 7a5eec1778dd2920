"""Parsers of model lines, aliases and merged backends."""

from skein.operators import extraction, graph
from tests.conftest import rows_of


def test_claims_and_facts(spark):
    text = "A | B | T | true | said | 2024-01-02 | unknown | none\nC | D | T | maybe | said\nshort | line"
    lines = spark.createDataFrame([(1, text)], "chunk_id int, output string")
    got = rows_of(extraction.parse_claims(lines).select("subject", "status", "start_date", "end_date", "source_text"))
    assert [(r[0], r[1], str(r[2]), r[3], r[4]) for r in got] == [
        ("a", "TRUE", "2024-01-02", None, None), ("c", "SUSPECTED", "None", None, None),
    ]
    lines = spark.createDataFrame([(1, "Ann | is ceo of | Acme | 25\nAnn | likes | Tea\nbad")], "chunk_id int, output string")
    assert rows_of(extraction.parse_facts(lines).select("relation", "confidence", "scope_key")) == [
        ("IS_CEO_OF", 1.0, "ann:IS_CEO_OF"), ("LIKES", 1.0, None),
    ]


def test_aliases_reach_both_ends(spark):
    groups = spark.createDataFrame([("ibm", "ibm"), ("i.b.m.", "ibm")], "node string, component string")
    entities = spark.createDataFrame([("ibm", 1), ("i.b.m.", 5)], "entity string, frequency int")
    names = extraction.canonical_names(groups, entities)
    assert rows_of(names) == [("i.b.m.", "i.b.m."), ("ibm", "i.b.m.")]
    relations = spark.createDataFrame(
        [("x", "ibm", "R", 1.0), ("ibm", "i.b.m.", "R", 1.0)], "src string, target string, relation string, weight double"
    )
    assert rows_of(extraction.apply_aliases(relations, names)) == [("x", "i.b.m.", "R", 1.0)]


def test_backends_merge_first_wins(spark):
    a = spark.createDataFrame([("n", "A")], "id string, label string")
    b = spark.createDataFrame([("n", "B"), ("m", "B")], "id string, label string")
    links = spark.createDataFrame([("n", "m")], "source string, target string")
    nodes, merged = extraction.merge_backends({"a": a, "b": b}, {"a": links, "b": links})
    assert rows_of(nodes.select("id", "label")) == [("m", "B"), ("n", "A")]
    assert merged.count() == 2


def test_local_context_order_and_budget(spark):
    relations = spark.createDataFrame(
        [("a", f"t{i}", "R", float(i)) for i in range(5)] + [("b", "t4", "R", 1.0)],
        "src string, target string, relation string, weight double",
    )
    chosen = spark.createDataFrame([("a",), ("b",)], "entity string")
    assert dict(rows_of(extraction.mutual_support(relations, chosen)))["t4"] == 2
    top = extraction.top_relations(relations, chosen)
    assert rows_of(top.where("entity = 'a'").select("target")) == [("t2",), ("t3",), ("t4",)]
    rows = spark.createDataFrame([(1, "x", "abcdefgh", 0.5)], "query_id int, id string, text string, score double")
    more = spark.createDataFrame([(1, "y", "abcd" * 20, 0.9)], "query_id int, id string, text string, score double")
    ordered = extraction.local_context({"entity": rows, "chunk": more}, {"entity": 3.0, "chunk": 1.0})
    assert rows_of(ordered.select("id", "rank", "cost")) == [("x", 1, 2), ("y", 2, 20)]
    assert rows_of(graph.fill_budget(ordered, 10)) == [(1, "x")]
