"""Near-duplicates by SimHash fingerprints, searched with vantage-point trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh_name
from skein.operators.components import connected_components
from skein.session import cut_lineage

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints that the driver gets to choose vantage points from, whatever the table's size.
TREE_SAMPLE = 8192
#: Trees are planted for shards with about SHARD_GOAL fingerprints at home, MAX_DEPTH deep at most.
SHARD_GOAL, MAX_DEPTH = 512, 14
#: Blocks of bits, each with a tree: of two fingerprints within RADIUS one block differs in one bit
#: at most, the radius of each tree's search.
BLOCKS = 3
#: Fingerprints at home in one shard that are compared in one task; a larger home is dealt to tiles.
SHARD = 8192
#: Least share of the sample that a node's bound is taken from; nodes with less take all of it.
LEAST = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, as a signed long; zero without words.

    Words are split at ASCII white space after lower-casing A-Z. A bit is set if it is set in
    over half of the shingles' hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = max(1, len(words) - shingle + 1)
    begin, end = starts[:n].tolist(), (starts[min(shingle, len(words)) :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[b:e], SEED) for b, e in zip(begin, end, strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(id, those in ``keep``, fp) of every row; null texts have no words."""
    names = [id_col, *(keep or [])]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*names, "fp"])

    return rows.mapInArrow(run, rows.drop("_text").schema.add("fp", "long"))


@dataclass
class Tree:
    """A vantage-point tree under the Hamming distance over the bits of ``mask``.

    Complete and of one depth: node k has the children 2k+1 (distance to its point at most its
    bound) and 2k+2. A leaf is a shard.
    """

    mask: np.uint64
    points: np.ndarray
    bounds: np.ndarray
    radius: int

    @classmethod
    def fit(cls, sample: np.ndarray, mask: int, depth: int, radius: int) -> Tree:
        """Vantage points from a bounded sample; each bound is the median of the node's share, or
        of the whole sample where the share is too small to tell."""
        m, nodes = np.uint64(mask), (1 << depth) - 1
        points, bounds = np.zeros(nodes, np.uint64), np.zeros(nodes, np.int64)
        shares = {0: sample}
        for node in range(nodes):
            share = shares.pop(node, sample[:0])
            pool = share if len(share) >= LEAST else sample
            # of a few candidates, the point whose distances spread most splits best
            if len(pool):
                at = np.linspace(0, len(pool) - 1, min(8, len(pool))).astype(int)
                candidates = pool[(at + node) % len(pool)]
                far = np.bitwise_count((candidates[:, None] ^ pool[None, :512]) & m)
                points[node] = candidates[int(far.std(axis=1).argmax())]
                away = np.bitwise_count((pool ^ points[node]) & m).astype(np.int64)
                bounds[node] = int(np.median(away))
                if away.max() > away.min() and bounds[node] == away.max():
                    bounds[node] -= 1
            if len(share) >= LEAST:
                shares[2 * node + 1] = share[away <= bounds[node]]
                shares[2 * node + 2] = share[away > bounds[node]]
        return cls(m, points, bounds, radius)

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The leaf of each fingerprint."""
        nodes = np.zeros(len(fps), np.int64)
        while len(nodes) and nodes[0] < len(self.points):
            away = np.bitwise_count((fps ^ self.points[nodes]) & self.mask).astype(np.int64)
            nodes = 2 * nodes + 1 + (away > self.bounds[nodes])
        return nodes - len(self.points)

    def visit(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that may be home to a fingerprint within the radius of the row's.

        By the triangle inequality a branch is pruned when the row's distance to the vantage
        point is over ``radius`` beyond the bound; a row near the bound goes down both branches.
        """
        rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        first_leaf = len(self.points)
        while len(nodes) and nodes[0] < first_leaf:
            away = np.bitwise_count((fps[rows] ^ self.points[nodes]) & self.mask).astype(np.int64)
            near = away - self.radius <= self.bounds[nodes]
            far = away + self.radius > self.bounds[nodes]
            rows, nodes = (
                np.concatenate((rows[near], rows[far])),
                np.concatenate((2 * nodes[near] + 1, 2 * nodes[far] + 2)),
            )
        return rows, nodes - first_leaf


def block_masks(mask: int, blocks: int) -> list[int]:
    """The bits of ``mask`` dealt to ``blocks`` masks of nearly equal size."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[k::blocks]) for k in range(blocks)]


def plant(sample: np.ndarray, mask: int, blocks: int, radius: int, depth: int) -> list[Tree]:
    """One tree for each block of bits. Of two fingerprints that differ in at most ``radius`` bits
    of ``mask``, some block differs in at most radius // blocks bits: that tree's search radius."""
    return [Tree.fit(sample, m, depth, radius // blocks) for m in block_masks(mask, blocks)]


def shard_links(home: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints at ``home`` in a shard and all that came to it, ``fps``: a
    spanning forest, at most one pair per fingerprint.

    The shard is ordered by the distance to a vantage point of its own. By the triangle bound
    partners of a row lie where that distance differs by at most ``radius``: one stretch of the
    order, compared exactly, block by block.
    """
    fps, home = np.unique(fps), np.unique(home)
    if len(fps) < 2 or not len(home):
        return fps[:0], fps[:0]
    point = home[len(home) // 2]
    away = np.bitwise_count(fps ^ point).astype(np.int64)
    order = np.argsort(away, kind="stable")
    fps, away = fps[order], away[order]
    own = np.flatnonzero(np.isin(fps, home))
    label = np.arange(len(fps))
    a, b, step = [], [], max(1, (1 << 22) // len(fps))
    for start in range(0, len(own), step):
        rows = own[start : start + step]
        low = int(np.searchsorted(away, away[rows[0]] - radius))
        high = int(np.searchsorted(away, away[rows[-1]] + radius, side="right"))
        close = np.bitwise_count(fps[rows, None] ^ fps[None, low:high]) <= radius
        for k in np.flatnonzero(close.sum(axis=1) > 1):
            i, partners = int(rows[k]), low + np.flatnonzero(close[k])
            others, first = np.unique(label[partners], return_index=True)
            new = others != label[i]
            if new.any():
                a += [i] * int(new.sum())
                b += partners[first[new]].tolist()
                label[np.isin(label, others[new])] = label[i]
    return fps[a], fps[b]


def links(
    fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD
) -> DataFrame:
    """Pairs (a, b) of distinct ``fp`` within ``radius`` bits; every linked pair is connected by them.

    A forest of vantage-point trees, one for each of ``blocks`` blocks of bits, deals the
    fingerprints to shards by Hamming distance. A fingerprint is at home in one shard of a tree and
    visits those beyond a boundary within the tree's search radius (``radius`` // ``blocks``): the
    triangle bound prunes all others. In a shard those at home meet all that came. With one block
    this is a single tree over all bits; at radius + 1 blocks the search radius is zero. A home of
    more than ``shard`` fingerprints is dealt to tiles, each of which all that came visit. Trees
    are as deep as the number of fingerprints asks for, MAX_DEPTH at most, so the broadcast is at
    most ``blocks`` * 2**MAX_DEPTH * 16 bytes.
    """
    sample = np.array(
        [r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()], np.int64
    ).view(np.uint64)
    depth = min(MAX_DEPTH, max(0, fps.count() // SHARD_GOAL).bit_length())
    forest = fps.sparkSession.sparkContext.broadcast(plant(sample, (1 << 64) - 1, blocks, radius, depth))

    def settle(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            leaves = [(k << 40) + tree.home(values) for k, tree in enumerate(forest.value)]
            yield pa.RecordBatch.from_pydict({"shard": np.concatenate(leaves)})

    def deal(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(forest.value):
                rows, leaf = tree.visit(values)
                own = tree.home(values)[rows] == leaf
                columns = {"fp": values[rows].view(np.int64), "shard": (k << 40) + leaf, "home": own}
                yield pa.RecordBatch.from_pydict(columns)

    def compare(group: pa.Table) -> pa.Table:
        values = group["fp"].to_numpy().view(np.uint64)
        a, b = shard_links(values[group["home"].to_numpy()], values, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = fps.select("fp")
    dealt = rows.mapInArrow(deal, "fp long, shard long, home boolean")
    # at most as many as the trees have leaves
    large = cut_lineage(
        rows.mapInArrow(settle, "shard long")
        .groupBy("shard")
        .agg(F.ceil(F.count(F.lit(1)) / shard).alias("tiles"))
        .where("tiles > 1")
    )
    if not large.isEmpty():
        tile = F.pmod(F.xxhash64("fp"), F.col("tiles")) + 1
        tiled = dealt.join(F.broadcast(large), "shard", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        dealt = tiled.select(
            "fp", "shard", "home", tile.alias("own"), F.explode(F.sequence(F.lit(1), "tiles")).alias("tile")
        ).select("fp", F.xxhash64("shard", "tile").alias("shard"), (F.col("home") & (F.col("own") == F.col("tile"))).alias("home"))
    return dealt.groupBy("shard").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    shard: int = SHARD,
    keep: list[str] | None = None,
) -> DataFrame:
    """id, the columns in ``keep``, fingerprint (16 hex digits) and component_id of every row of
    ``docs``. None of ``keep`` may be called like another column of the result.

    Fingerprints that differ in at most ``radius`` bits link; component_id is the least id that is
    reachable. Null, empty and blank texts have the fingerprint zero and link like any other.
    Repeated rows share a component; a null id is never a component_id unless it has no other.
    Only distinct fingerprints are searched, so large groups of copies cost one. Other columns are
    ignored. Runs jobs when called.
    """
    kept = keep or []
    marked = fingerprints(docs, id_col, text_col, kept)
    marked = cut_lineage(marked.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`") for c in kept], "fp"))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("_id").alias("least")))
    groups = connected_components(links(distinct, radius, blocks, shard), "a", "b")
    linked = distinct.join(groups.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    final = distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    # The second key makes the join deal both sides anew, so that AQE can split a hot fingerprint.
    again = F.xxhash64("fp").alias("again")
    return marked.select("*", again).join(final.select("*", again), ["fp", "again"]).select(
        F.col("_id").alias(id_col),
        *[F.col(f"`{c}`") for c in kept],
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the least id of their group, with their columns.

    A row is told by its id and its text: rows of one id and different texts are judged apart, and
    rows that repeat both stay or go together. Rows with a null id have no group to stand for and
    stay. Null and empty texts are near-duplicates of each other. An empty table stays empty.
    """
    key, size = fresh_name(docs, "_text_key"), fresh_name(docs, "_text_size")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    told = docs.withColumn(key, F.xxhash64(text)).withColumn(size, F.octet_length(text))
    heads = near_duplicates(told, id_col, text_col, keep=[key, size])
    others = heads.where(F.col(f"`{id_col}`") != F.col("component_id")).select(f"`{id_col}`", key, size).distinct()
    left = told.join(others, [id_col, key, size], "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
