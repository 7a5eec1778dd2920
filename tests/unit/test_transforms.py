"""Sub-queries of injected models, and their hits folded back."""

import pandas as pd

from skein.operators.transforms import Transforms, folded, sub_queries
from skein.plans.retrieval import search_raw


def vector(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(len(t)), float(t.count("a")), 1.0])


def test_variants_are_ordered_distinct_and_embedded(spark):
    models = Transforms(
        embed=vector,
        multi=lambda t: t.map(lambda x: [x.upper(), x, "", None, "other"]),
        step_back=lambda t: t.map(lambda x: "other" if x else None),
        decompose=lambda t: t.map(lambda x: None if x == "one" else x.split(" and ")),
        hyde=lambda t: t.map(lambda x: "an answer" if x == "one" else ""),
        weights={"decompose": 0.5},
    )
    rows = sub_queries(spark.createDataFrame([(1, "a and b"), (2, "one"), (3, None)], "query_id long, text string"), models).collect()
    told = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.variant)):
        told.setdefault(r.query_id, []).append((r.kind, r.text, r.weight))
        assert r.sub_id == f"{r.query_id}#{r.variant}"
        spoken = "an answer" if (r.query_id, r.variant) == (2, 0) else r.text
        assert list(r.embedding) == [float(len(spoken)), float(spoken.count("a")), 1.0]
    assert told == {
        1: [("query", "a and b", 1.0), ("multi", "A AND B", 1.0), ("multi", "other", 1.0), ("decompose", "a", 0.5), ("decompose", "b", 0.5)],
        2: [("query", "one", 1.0), ("multi", "ONE", 1.0), ("multi", "other", 1.0)],
        3: [("query", "", 1.0), ("multi", "other", 1.0)],
    }


def test_the_best_weighted_hit_counts(spark):
    subs = spark.createDataFrame([("1#0", 1, 1.0), ("1#1", 1, 0.5), ("2#0", 2, 1.0)], "sub_id string, query_id long, weight double")
    hits = spark.createDataFrame([("1#0", 7, 0.3), ("1#1", 7, 0.8), ("1#1", 8, 0.4), ("2#0", 7, 0.1)], "query_id string, id long, score double")
    assert {(r.query_id, r.id): r.score for r in folded(hits, subs).collect()} == {(1, 7): 0.4, (1, 8): 0.2, (2, 7): 0.1}


def test_a_part_finds_what_the_whole_question_does_not(spark):
    docs = spark.createDataFrame([(1, "plum tree"), (2, "fig tree"), (3, "nothing else")], "id long, text string")
    vectors = docs.selectExpr("id", "array(float(1), float(id)) AS embedding")
    asked = spark.createDataFrame([(1, "plums figs")], "query_id long, text string")
    models = Transforms(embed=lambda t: t.map(lambda x: [1.0, float("plum" in x)]), decompose=lambda t: t.map(lambda x: ["plum", "fig"]))
    found = search_raw(asked, vectors, docs, transforms=models)
    assert {r.id for r in found.collect()} >= {1, 2}
    plain = search_raw(asked.selectExpr("query_id", "text", "array(float(1), float(0)) AS embedding"), vectors, docs)
    lexical = {r.id for r in found.where("rank <= 2").collect()}
    assert lexical == {1, 2} and plain.count() <= 3
