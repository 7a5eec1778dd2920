"""Sentence windows around hits, and hierarchical summaries over blocks of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import sentences
from skein.operators.running import in_ranges, running


def sentence_records(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(chunk_id, sentence_idx, total_sentences, sentence) of every sentence."""
    parts = docs.select(F.col(id_col).alias("chunk_id"), sentences(F.col(text_col)).alias("parts"))
    return parts.select(
        "chunk_id", F.size("parts").alias("total_sentences"), F.posexplode("parts").alias("sentence_idx", "sentence")
    )


def sentence_windows(records: DataFrame, n: int = 3) -> DataFrame:
    """Each sentence with the ``n`` before and after it, joined by spaces."""
    frame = Window.partitionBy("chunk_id").orderBy("sentence_idx").rowsBetween(-n, n)
    return records.withColumn("window", F.array_join(F.collect_list("sentence").over(frame), " "))


def best_windows(hits: DataFrame, records: DataFrame, n: int = 3) -> DataFrame:
    """For hits (query_id, chunk_id, sentence_idx, score) the window of each chunk's best hit."""
    best = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "sentence_idx")
    top = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    near = records.select("chunk_id", F.col("sentence_idx").alias("i"), "sentence")
    at = F.col("sentence_idx")
    joined = top.join(near, "chunk_id").where(F.col("i").between(at - n, at + n))
    texts = F.array_sort(F.collect_list(F.struct("i", "sentence")))
    return joined.groupBy("query_id", "chunk_id", "sentence_idx", "score").agg(
        F.array_join(F.transform(texts, lambda t: t["sentence"]), " ").alias("window")
    )


def structure_blocks(chunks: DataFrame, n: int = 5, order_col: str = "chunk_index") -> DataFrame:
    """Adds section and block: a section starts at a heading (is_heading); blocks are ``n`` places
    of a section in a row.

    Places are numbered on source, order and heading alone, in ranges, so that a source may hold
    any share of the rows; texts move once, dealt by source and place. Chunks of a source with
    equal order share a place, which is a heading if one of them is; a null heading is none; null
    sources are one source and null orders come first.
    """
    heads = F.coalesce(F.max(F.col("is_heading").cast("int")), F.lit(0))
    places = chunks.groupBy(F.col("source").alias("_source"), F.col(order_col).alias("_order")).agg(heads.alias("_head"))
    keys, order = ["_source"], ["_order"]
    rows = in_ranges(places, keys, order)
    rows = running(rows, keys, order, "_place", F.lit(1))
    rows = running(rows, keys, order, "section", F.col("_head"))
    rows = running(rows, keys, order, "_start", F.when(F.col("_head") == 1, F.col("_place")), "max")
    block = F.floor((F.col("_place") - F.coalesce("_start", F.lit(1))) / n)
    placed = rows.select("_source", "_order", "section", block.alias("block"))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col(order_col).eqNullSafe(F.col("_order"))
    return chunks.drop("section", "block").join(placed, same).drop("_source", "_order")


def summarise_blocks(
    blocks: DataFrame, summarise: Callable | None = None, order_col: str = "chunk_index", chars: int = 4000
) -> DataFrame:
    """One node per (source, section, block): its children's ids in order and its text, by an
    injected model of texts (a pandas function) or, without one, the first characters."""
    members = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), "id", "text")))
    nodes = blocks.groupBy("source", "section", "block").agg(members.alias("m"))
    joined = F.substring(F.array_join(F.transform("m", lambda x: x["text"]), " "), 1, chars)
    text = F.pandas_udf(summarise, "string")(joined) if summarise else joined
    return nodes.select(
        "source", "section", "block", F.transform("m", lambda x: x["id"]).alias("children_ids"), text.alias("text")
    )


def drill_down(hits: DataFrame, nodes: DataFrame, leaves: DataFrame, k: int, depth: int = 5) -> DataFrame:
    """The leaves under summary hits (query_id, id, score), at most ``k`` of each hit by their own
    score, the best score of each leaf. ``nodes`` has (id, children_ids), ``leaves`` (id, score)."""
    frontier = hits.select("query_id", F.col("id").alias("hit"), "id")
    found = None
    for _ in range(depth):
        down = frontier.join(nodes.select("id", "children_ids"), "id").select(
            "query_id", "hit", F.explode("children_ids").alias("id")
        )
        ends = down.join(leaves, "id").select("query_id", "hit", "id", "score")
        found = ends if found is None else found.union(ends)
        frontier = down.join(nodes.select("id"), "id", "left_semi")
        if frontier.isEmpty():
            break
    order = Window.partitionBy("query_id", "hit").orderBy(F.desc("score"), "id")
    top = found.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return top.groupBy("query_id", "id").agg(F.max("score").alias("score"))
