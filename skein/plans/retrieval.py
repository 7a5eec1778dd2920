"""The composed retrieval plan: hybrid search, fusion, threshold, diversity, top-k."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import fusion, rerank, routing, search
from skein.operators.policies import over_fetch
from skein.operators.transforms import Transforms, folded, sub_queries
from skein.session import cut_lineage


@dataclass(frozen=True)
class Config:
    """Options of a retrieval; ``with_overrides`` changes known ones."""

    top_k: int = 10
    similarity_threshold: float = 0.3
    hybrid: bool = True
    hybrid_mode: str = "rrf"
    hybrid_weight: float = 0.7
    rrf_k: int = 60
    mmr: bool = False
    mmr_lambda: float = 0.5
    sparse_weight: float = 0.3
    graph_budget: int = 3

    def with_overrides(self, **overrides) -> Config:
        known = {k: v for k, v in overrides.items() if v is not None and k in self.__dataclass_fields__}
        return replace(self, **known)


#: Options that the route of a query changes.
ROUTES = {
    "factual": {},
    "synthesis": {"top_k": 15},
    "table_lookup": {"top_k": 15, "hybrid_weight": 0.4},
    "entity_relation": {"graph_budget": 5},
    "corpus_exploration": {"top_k": 20, "similarity_threshold": 0.2},
}


@dataclass(frozen=True)
class Channels:
    """Hits (query_id, id, score) that further searches found, and models that order the result."""

    #: best windows of sentence hits: they join the dense list
    sentences: DataFrame | None = None
    #: symbols of code: they join the lexical list
    symbols: DataFrame | None = None
    #: learned-sparse hits, fused with the hybrid list
    sparse: DataFrame | None = None
    #: the graph's expansion, which fills slots of its own
    expanded: DataFrame | None = None
    #: scores pairs of (query text, document text)
    reranker: Callable[[pd.Series, pd.Series], pd.Series] | None = None


def candidates(
    queries: DataFrame, vectors: DataFrame, documents: DataFrame, fetch: int, hybrid: bool, where: Column | None,
    index: search.Bm25Index | None,
) -> tuple[DataFrame, DataFrame | None]:
    """The ``fetch`` best dense and lexical hits of each query."""
    dense = search.dense_search(vectors, queries.select("query_id", "embedding"), fetch, where=where)
    dense = dense.select("query_id", "id", "score")
    if not hybrid:
        return dense, None
    index = index or search.Bm25Index.build(documents)
    return dense, index.search(queries.select("query_id", "text"), fetch).select("query_id", "id", "score")


def compose(
    queries: DataFrame, documents: DataFrame, dense: DataFrame, lexical: DataFrame | None, config: Config,
    channels: Channels,
) -> DataFrame:
    """Candidates to results: channels joined, fused, cut at the threshold, made diverse, re-ranked,
    limited. Hits of one document from several searches count once, with the best score."""
    fetch = over_fetch(config.top_k, channels.reranker is not None, config.hybrid)
    if channels.sentences is not None:
        dense = fusion.union_stores(dense, channels.sentences.select("query_id", "id", "score"))
    if lexical is not None and channels.symbols is not None:
        lexical = fusion.union_stores(lexical, channels.symbols.select("query_id", "id", "score"))
    if lexical is None:
        fused = dense.withColumn("vector_score", F.col("score")).withColumn("fused_only", F.lit(False))
    elif config.hybrid_mode == "weighted":
        fused = fusion.weighted(dense, lexical, config.hybrid_weight)
    else:
        fused = fusion.reciprocal_rank(dense, lexical, config.rrf_k)
    if channels.sparse is not None:
        signals = fused.select("query_id", "id", "vector_score", "fused_only")
        mixed = fusion.with_sparse(fused.select("query_id", "id", "score"), channels.sparse, config.sparse_weight)
        fused = mixed.join(signals, ["query_id", "id"], "left")
    weighted = config.hybrid and config.hybrid_mode == "weighted"
    kept = search.top_k(fusion.above_threshold(fused, config.similarity_threshold, weighted), fetch)
    if config.mmr:
        chosen = rerank.mmr(kept.join(documents, "id"), config.mmr_lambda)
        kept = chosen.withColumnRenamed("mmr_rank", "rank")
    if channels.reranker is not None:
        pool = rerank.rerank_pool(kept, config.top_k).drop("text")
        asked = queries.select("query_id", F.col("text").alias("query_text"))
        pool = pool.join(asked, "query_id").join(documents.select("id", "text"), "id")
        ordered = rerank.rerank(pool.drop("rank"), channels.reranker)
        kept = ordered.withColumn("score", F.col("rerank_score")).select("query_id", "id", "score", "rank")
    if channels.expanded is not None:
        return rerank.graph_slots(kept.drop("rank"), channels.expanded, config.top_k, config.graph_budget)
    return kept.where(F.col("rank") <= config.top_k)


def search_raw(
    queries: DataFrame,
    vectors: DataFrame,
    documents: DataFrame,
    config: Config | None = None,
    where: Column | None = None,
    index: search.Bm25Index | None = None,
    expanded: DataFrame | None = None,
    channels: Channels | None = None,
    transforms: Transforms | None = None,
) -> DataFrame:
    """(query_id, id, score, rank, ...) of the best rows for queries (query_id, text, embedding).

    ``vectors`` has (id, embedding), ``documents`` (id, text). One plan for all queries: dense and
    lexical candidates are over-fetched, joined by further ``channels``, fused, cut at the
    threshold, made diverse if asked for, re-ranked by a model if there is one, and limited;
    ``expanded`` (query_id, id, score) fills the graph's slots. ``where`` filters the dense channel
    alone. With ``transforms`` the queries (query_id, text) become sub-queries, all searched in the
    same two passes; their hits are folded to their queries before anything is fused.
    """
    config = config or Config()
    channels = channels or Channels()
    if expanded is not None:
        channels = replace(channels, expanded=expanded)
    fetch = over_fetch(config.top_k, channels.reranker is not None, config.hybrid)
    if transforms is None:
        dense, lexical = candidates(queries, vectors, documents, fetch, config.hybrid, where, index)
        return compose(queries, documents, dense, lexical, config, channels)
    subs = cut_lineage(sub_queries(queries, transforms))  # the models are called once
    asked = subs.select(F.col("sub_id").alias("query_id"), "text", "embedding")
    found = candidates(asked, vectors, documents, fetch, config.hybrid, where, index)
    dense, lexical = (None if hits is None else folded(hits, subs) for hits in found)
    return compose(queries, documents, dense, lexical, config, channels)


def search_routed(
    queries: DataFrame,
    vectors: DataFrame,
    documents: DataFrame,
    config: Config | None = None,
    where: Column | None = None,
    index: search.Bm25Index | None = None,
    channels: Channels | None = None,
) -> DataFrame:
    """``search_raw`` with each query's options changed by its route (``ROUTES``), and the route.

    Both searches run once for all queries, for as many hits as the widest route asks, and their
    hits are kept in the checkpoint folder; a route takes the best of its queries' hits from there.
    A query without text is factual.
    """
    config, channels = config or Config(), channels or Channels()
    routed = queries.withColumn("route", F.coalesce(routing.query_route(F.col("text")), F.lit("factual")))
    settings = {name: config.with_overrides(**changes) for name, changes in ROUTES.items()}
    model = channels.reranker is not None
    widest = max(over_fetch(s.top_k, model, s.hybrid) for s in settings.values())
    dense, lexical = candidates(queries, vectors, documents, widest, config.hybrid, where, index)
    dense = cut_lineage(fusion.ranked(dense))
    lexical = None if lexical is None else cut_lineage(fusion.ranked(lexical))

    def branch(name: str, options: Config) -> DataFrame:
        own = routed.where(F.col("route") == name)
        ids, fetch = own.select("query_id"), over_fetch(options.top_k, model, options.hybrid)

        def hits(rows: DataFrame | None) -> DataFrame | None:
            if rows is None:
                return None
            rows = rows.where(F.col("rank") <= fetch) if "rank" in rows.columns else rows
            return rows.join(ids, "query_id", "left_semi").select("query_id", "id", "score")

        few = {n: hits(getattr(channels, n)) for n in ("symbols", "sparse", "expanded", "sentences")}
        found = compose(own, documents, hits(dense), hits(lexical), options, replace(channels, **few))
        return found.select("query_id", "id", "score", "rank").withColumn("route", F.lit(name))

    return reduce(DataFrame.unionByName, [branch(n, s) for n, s in settings.items()])
