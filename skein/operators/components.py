"""Connected components of an undirected graph as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut_lineage

#: A key with more than one in SHARE of all rows is looked up by broadcast: fewer than SHARE keys.
SHARE = 512


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that hold more than one in SHARE of the rows; fewer than SHARE rows."""
    counts = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * SHARE > total).select(key)


def lookup(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``values`` (one row a key). Rows of hot keys stay where they are: only
    those keys' values are broadcast. So no key is dealt to one task."""
    few = F.broadcast(values.join(F.broadcast(hot), key, "left_semi"))
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(values, key)
    return cold.unionByName(rows.join(few, key))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge; component is its least node.

    Each round, a node takes the least label among its own, its neighbours' and that label's own
    label (pointer jumping), until nothing changes: about log(longest path) rounds. Labels are
    minima, so a hub's neighbours are combined in each task before they are dealt; labels of hubs
    and of large components are looked up by broadcast (see ``lookup``). Rounds go through the
    checkpoint folder. Null ends are ignored; loops make a component of one node.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL"
    )
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    hubs = hot_keys(both, "b")
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        told = lookup(both, labels.select(F.col("a").alias("b"), "label"), "b", hubs)
        near = told.groupBy("a").agg(F.min("label").alias("near"))
        stepped = cut_lineage(
            labels.join(near, "a").select(
                "a", F.col("label").alias("old"), F.least("label", "near").alias("label")
            )
        )
        up = stepped.select(F.col("a").alias("label"), F.col("label").alias("up"))
        jumped = cut_lineage(
            lookup(stepped, up, "label", hot_keys(stepped, "label")).select(
                "a", "old", F.least("label", "up").alias("label")
            )
        )
        if jumped.where("label <> old").isEmpty():
            return jumped.select(F.col("a").alias("node"), F.col("label").alias("component"))
        labels = jumped.select("a", "label")
