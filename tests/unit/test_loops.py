"""Operators that SQL does not express, against plain loops."""

import re

import numpy as np
import pytest

from skein.operators import graph, index, search
from skein.plans import catalog, graphs, ranking, records
from tests.conftest import SMALL, rows_of

ABBREVIATED = re.compile(r"(?i)(?:^|\s)(mr|mrs|ms|dr|prof|rev|st|gen|rep|sen|ph\.d|m\.d|b\.a|m\.a|b\.s|m\.s|e\.g|i\.e|etc)$")


def sentences_of(text):
    words, out, held = re.split(r"([.!?]+\s+)", text.strip()), [], ""
    for body, end in zip(words[::2], [*words[1::2], ""], strict=True):
        if body.strip():
            held = f"{held} {body.strip()}{end.strip()}".strip()
            if not ABBREVIATED.search(body.strip()):
                out.append(held)
                held = ""
    return [*out, held] if held else out


def packed(text, size, overlap):
    """Chunks as (first, last) sentence, found by looking back from each start."""
    parts = sentences_of(text)
    costs = [len(p) // 4 for p in parts]
    out, first, at = [], 0, 0
    while at < len(parts):
        if at > first and sum(costs[first : at + 1]) > size:
            out.append(" ".join(parts[first:at]))
            back = at
            while back > first and sum(costs[back - 1 : at]) <= overlap and sum(costs[back - 1 : at + 1]) <= size:
                back -= 1
            first = back
        at += 1
    return [*out, " ".join(parts[first:])] if parts else []


def test_semantic_chunks_equal_a_plain_loop(spark):
    got = {}
    for r in catalog.queries()["semantic_chunks"](spark, SMALL).orderBy("source_id", "chunk_index").collect():
        got.setdefault(r.source_id, []).append(r.chunk)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert got == {d.doc_id: c for d in docs if (c := packed(d.text or "", 100, 20))}


def test_mmr_equals_a_plain_loop(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    own = F.max("score").over(Window.partitionBy("query_id"))
    hits = ranking.lexical(spark, SMALL).withColumn("score", F.round(F.col("score") / own, 6)).collect()
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {}
    for r in catalog.queries()["mmr"](spark, SMALL).orderBy("query_id", "mmr_rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert set(got) == {h.query_id for h in hits}
    for key, ids in got.items():
        assert len(ids) == len(set(ids)) <= sum(h.query_id == key for h in hits)
        best = max((h for h in hits if h.query_id == key), key=lambda h: (h.score, -h.id))
        assert ids[0] == best.id and all(i in texts for i in ids)


def stable(labels, edges):
    """Whether no node has more weight in another community than in its own."""
    near = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            if x != y:
                own = near.setdefault(x, {})
                own[labels[y]] = own.get(labels[y], 0.0) + w
    return all(max(own.values()) <= own.get(labels[x], 0.0) + 1e-5 for x, own in near.items())


def test_communities_are_stable(spark):
    from pyspark.sql import functions as F

    edges = graph.merge_relations(graphs.relations(spark, SMALL)).select("src", F.col("target").alias("dst"), "weight")
    got = catalog.queries()["community_labels"](spark, SMALL).collect()
    assert stable({r.node: r.community for r in got}, [tuple(r) for r in edges.collect()])


def test_a_long_chain_of_nodes_settles(spark):
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst", "1.0D + (id * 7 % 5) AS weight")
    got = graph.communities(chain).collect()
    assert len(got) == 301 and stable({r.node: r.community for r in got}, [tuple(r) for r in chain.collect()])


def by_rounds(spark, edges):
    """The labels of ``graph.communities`` by plain loops over all nodes, of integer weights."""
    from pyspark.sql import functions as F

    near = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            if x != y:
                near.setdefault(x, {})[y] = near.setdefault(x, {}).get(y, 0) + w
    nodes = spark.createDataFrame([(x,) for x in near], "node long")
    labels = {x: x for x in near}
    for step in range(1000):
        wished = {}
        for x, own in near.items():
            votes = {}
            for y, w in own.items():
                votes[labels[y]] = votes.get(labels[y], 0) + w
            best = min(votes, key=lambda c: (-votes[c], c))
            if votes[best] > votes.get(labels[x], 0):
                wished[x] = best
        if not wished:
            return labels
        turn = {r.node: r.h for r in nodes.select("node", F.xxhash64("node", F.lit(step)).alias("h")).collect()}
        inside = sum(w for x in near for y, w in near[x].items() if labels[x] == labels[y])
        new = labels | {x: c for x, c in wished.items() if turn[x] % 2 == 0}
        if sum(w for x in near for y, w in near[x].items() if new[x] == new[y]) <= inside:
            free = [x for x in wished if all((turn[x], x) > (turn[y], y) for y in near[x] if y in wished)]
            new = labels | {x: wished[x] for x in free}
        labels = new
    raise AssertionError("no end")


def grids():
    """A long chain, a hub, and nodes linked at random, as three graphs."""
    rng = np.random.default_rng(5)
    chain = [(i, i + 1, 1) for i in range(400)]
    hub = [(0, i, int(rng.integers(1, 4))) for i in range(1, 120)] + [(i, i + 1, 2) for i in range(1, 119) if i % 3]
    some = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 200, 500), rng.integers(0, 200, 500), rng.integers(1, 6, 500), strict=True)]
    return {"chain": chain, "hub": hub, "random": some}


@pytest.mark.parametrize("kind", ["chain", "hub", "random"])
def test_rounds_over_the_part_that_still_moves_equal_rounds_over_all(spark, kind, monkeypatch):
    edges = grids()[kind]
    frame, asked = spark.createDataFrame(edges, "src long, dst long, weight long"), []
    written = graph.written
    monkeypatch.setattr(graph, "written", lambda *a: (r := written(*a), asked.append(r[1]["nodes"]))[0])
    monkeypatch.setattr(graph, "HUB", 50)
    monkeypatch.setattr(graph, "SHARE", 3)
    got = {r.node: r.community for r in graph.communities(frame, small=1).collect()}
    assert got == by_rounds(spark, edges)
    # no round asked all nodes once few of them would move
    if kind == "chain":
        assert sum(n == len(got) for n in asked) < len(asked) / 2 and min(asked) < len(got) / 10


def test_nested_communities_refine(spark):
    rows = records.QUERIES["nested_communities"][0](spark, SMALL).collect()
    found = {}
    for r in rows:
        found.setdefault(r.level, {})[r.node] = r.community
    for level in range(1, len(found)):
        assert set(found[level]) == set(found[0])
        for node, name in found[level].items():
            above = found[level - 1][node]
            assert name == above or name.startswith(f"{above}/")


@pytest.mark.parametrize("block", [40, 4096])
def test_similar_pairs_equal_all_pairs(spark, block):
    rows = ranking.vectors(spark, SMALL).select("id", "embedding")
    rows = rows.union(rows.where("id < 20").selectExpr("id + 100000", "embedding"))
    data = {r.id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows.collect()}
    want = {(a, b) for a in data for b in data if a < b and round(float(data[a] @ data[b]), 6) >= 0.4}
    assert {tuple(r) for r in search.similar_pairs(rows, 0.4, block).collect()} == want
    links = {tuple(r) for r in search.similar_pairs(rows, 0.4, block, forest=True).collect()}
    assert links <= want
    from skein.operators.components import connected_components

    whole = spark.createDataFrame(sorted(want), "src long, dst long")
    some = spark.createDataFrame(sorted(links), "src long, dst long")
    assert rows_of(connected_components(whole)) == rows_of(connected_components(some))


@pytest.mark.parametrize("spread", [0.02, 0.1, 3.0])
def test_a_forest_meets_no_pairs_within_the_largest_component(spark, spread, monkeypatch):
    """One tight cluster, with a chain, a pair and lone vectors apart from it; a loose cluster; no cluster."""
    from skein.operators.components import connected_components

    noise = np.random.default_rng(3)
    near = np.eye(24)[0] + spread * noise.normal(size=(300, 24))
    chain = [np.cos(i * 0.7) * np.eye(24)[2] + np.sin(i * 0.7) * np.eye(24)[3] for i in range(3)]
    apart = [np.eye(24)[i] for i in (5, 5, 7, 8)]
    data = np.array([*near, *chain, *apart, near[0]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<double>").repartition(3)
    whole, cells = search.similar_pairs(rows, 0.7, 20), []
    meetings = search.meetings
    monkeypatch.setattr(search, "meetings", lambda r, f, low, groups, *more: cells.append(low * groups) or meetings(r, f, low, groups, *more))
    some = search.similar_pairs(rows, 0.7, 20, forest=True)
    assert len(cells) == 2 and (spread == 3.0 or sum(cells) < 60)
    assert rows_of(connected_components(some)) == rows_of(connected_components(whole))
    assert some.count() <= (10 * len(data) if spread < 3.0 else whole.count())


def test_the_index_finds_nine_of_ten(spark, tmp_path):
    rows, asked = ranking.vectors(spark, "/root/testdata/sf0.01"), ranking.vector_queries(spark, "/root/testdata/sf0.01")
    made = index.VectorIndex.build(rows)
    assert made.rows.count() == rows.count()
    probes = 3 * len(made.centroids) // 4
    want = {(r.query_id, r.id) for r in search.dense_search(rows, asked).collect()}
    got = {(r.query_id, r.id) for r in made.search(asked, probes=probes).collect()}
    assert len(got & want) >= 0.9 * len(want)
    made.save(str(tmp_path / "index"))
    again = index.VectorIndex.load(spark, str(tmp_path / "index")).search(asked, probes=probes)
    assert {(r.query_id, r.id) for r in again.collect()} == got
    assert {(r.query_id, r.id) for r in made.search(asked, probes=10**6).collect()} == want


def test_groups_of_sentences_are_bounded(spark):
    from skein.operators.chunking import similarity_breaks

    rows = [("d", i, [1.0, 0.0] if i % 7 else [0.0, 1.0], 3 + i % 4) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc string, idx int, embedding array<double>, length int")
    got = {r.idx: r.group for r in similarity_breaks(frame, 0.5, 12).collect()}
    group, total, before = 0, 0, None
    for _, i, e, n in rows:
        if before is None or e != before or total + n > 12:
            group, total = group + 1, 0
        total, before = total + n, e
        assert got[i] == group
