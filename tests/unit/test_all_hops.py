"""Hops over every order against a breadth-first search."""

from collections import defaultdict

from skein.plans import catalog
from tests.conftest import SMALL, rows_of


def test_hops_reach_every_order(spark):
    near = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        near[f"o{r[0]}"].add(f"c{r[1]}")
        near[f"c{r[1]}"].add(f"o{r[0]}")
    want = []
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id").collect():
        hop = {f"c{r[0] + 1}": 0}
        front = list(hop)
        for step in (1, 2, 3):
            front = list({y for x in front for y in near[x]} - hop.keys())
            hop |= dict.fromkeys(front, step)
        want += [(r[0], node, n) for node, n in hop.items()]
    assert rows_of(catalog.queries()["graph_hops_all"](spark, SMALL)) == sorted(want, key=repr)
