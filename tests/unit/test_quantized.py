"""Recall and work of the quantised index against the exact search; answers over reports."""

import json

import pytest

from skein.operators.quantized import QuantizedIndex
from skein.operators.search import dense_search
from skein.plans import global_search, ranking
from tests.conftest import rows_of

MIDDLE = "/root/testdata/sf0.01"


def test_recall_and_work_of_a_saved_index(spark, tmp_path):
    rows = ranking.vectors(spark, MIDDLE)
    asked = ranking.vector_queries(spark, MIDDLE)
    QuantizedIndex.build(rows).save(str(tmp_path))
    saved = QuantizedIndex.load(spark, str(tmp_path))
    n, queries = rows.count(), asked.count()
    assert saved.codes.count() == n
    scored = saved.candidates(asked, 40).count()
    assert scored < 0.1 * n * queries
    exact = {(r.query_id, r.id): r.score for r in dense_search(rows, asked, 10).collect()}
    found = {(r.query_id, r.id): r.score for r in saved.search(asked, 10, 40).collect()}
    hits = set(exact) & set(found)
    assert len(hits) >= 0.9 * len(exact)
    assert all(abs(exact[x] - found[x]) < 2e-6 for x in hits)
    few = saved.candidates(asked, 40, block=3)
    assert rows_of(few.distinct()) == rows_of(saved.candidates(asked, 40).distinct())


def test_odd_vectors(spark, tmp_path):
    data = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [0.9, 0.1, 0.0]), (4, [0.9, 0.1, 0.0]), (5, [-1.0, 0.0, 0.0])]
    rows = spark.createDataFrame(data, "id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    found = QuantizedIndex.build(rows, parts=2).search(asked, k=2, rerank=6).collect()
    assert [(r.id, r.score) for r in sorted(found, key=lambda r: r["rank"])][0] == (1, 1.0)
    QuantizedIndex.build(rows.limit(0), parts=2).save(str(tmp_path))
    assert QuantizedIndex.load(spark, str(tmp_path)).search(asked).collect() == []


def plain_answers(reports, queries, level, chars, floor, most, budget):
    known = [r for r in reports if r[2] == level] or reports
    out = {}
    for key, text in queries:
        words = set(text.lower().split())
        shared = [(len(words & set((t or "").lower().split())) / len(words), i, t) for i, t, _ in known if words]
        near = sorted((x for x in shared if x[0] > 0), key=lambda x: (-x[0], x[1]))[:2]
        points = []
        for _, _, t in near:
            for at in range(0, len(t), chars):
                piece = t[at : at + chars]
                points += [(-float(p["score"]), p["point"]) for p in json.loads(model_says(piece))] if model_says(piece).startswith("[") else []
        kept, spent = [], 0
        for _, point in sorted(p for p in points if -p[0] >= floor and p[1])[:most]:
            spent += len(point) // 4
            if spent > budget:
                break
            kept.append(point)
        out[key] = (global_search.NO_DATA if not kept else kept[0] if len(kept) == 1 else f"{text}={'+'.join(kept)}", len(kept))
    return out


def model_says(piece):
    if "nothing" in piece:
        return "no json at all"
    return json.dumps([{"point": w, "score": 10 * len(w)} for w in piece.split()])


@pytest.mark.parametrize("level", [0, 5])
def test_answers_equal_a_plain_loop(spark, level):
    reports = [(1, "alpha beta gamma delta", 0), (2, "alpha nothing here", 0), (3, "beta beta", 1), (4, None, 0), (5, "", 0), (6, "gamma epsilon alpha zeta", 0)]
    queries = [(1, "alpha gamma"), (2, "beta"), (3, "unknown"), (4, "nothing"), (5, "")]
    found = global_search.map_reduce(
        spark.createDataFrame(reports, "id long, text string, level int"),
        spark.createDataFrame(queries, "query_id long, text string"),
        lambda q, c: c.map(model_says),
        lambda q, p: q + "=" + p.str.replace("\n", "+"),
        level=level, communities=2, chars=12, floor=40, most=4, budget=4,
    ).collect()
    assert {r.query_id: (r.answer, r.points) for r in found} == plain_answers(reports, queries, level, 12, 40, 4, 4)
