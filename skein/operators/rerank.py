"""Re-ranking of results: diversity, code boosts, artifact weights, graph slots, confidence."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import basename


def mmr(rows: DataFrame, weight: float = 0.5, near: float = 0.85) -> DataFrame:
    """Maximal marginal relevance: (query_id, id, score, mmr_rank), near-duplicates dropped.

    ``rows`` has (query_id, id, text, score). Each step takes the row with the greatest
    weight * score - (1 - weight) * (greatest Jaccard with those taken); rows whose Jaccard with a
    taken one is ``near`` or more are dropped. Ties go to the better score, then the smaller id.
    The choice is sequential, so a query's candidates are one group: limit them first.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        sets = [set(x) for x in group["words"]]
        scores, left = group["score"].tolist(), list(range(len(group)))
        closest, order = [0.0] * len(sets), []
        while left:
            best = max(left, key=lambda i: (weight * scores[i] - (1 - weight) * closest[i], -i))
            order.append(best)
            rest = []
            for i in left:
                if i == best:
                    continue
                union = len(sets[i] | sets[best])
                closest[i] = max(closest[i], len(sets[i] & sets[best]) / union if union else 0.0)
                if closest[i] < near:
                    rest.append(i)
            left = rest
        out = group.iloc[order][["query_id", "id", "score"]].copy()
        out["mmr_rank"] = range(1, len(out) + 1)
        return out

    from skein.functions.text import clean_tokens

    words = rows.select("query_id", "id", "score", clean_tokens(F.col("text")).alias("words"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"query_id {types['query_id']}, id {types['id']}, score double, mmr_rank long"
    return words.groupBy("query_id").applyInPandas(choose, schema)


def code_boost(results: DataFrame, query_tokens: DataFrame, per_file: int = 3) -> DataFrame:
    """Lexical boost of code results, then at most ``per_file`` of a file before the overflow.

    ``results``: (query_id, id, score, text, symbol, qualified, file, symbol_type, start_line,
    end_line); ``query_tokens``: (query_id, token). A row gains 1 for a symbol that equals a token
    (0.5 for one that contains it), 0.4 for the file's name, 1 for the qualified name, 0.08 a token
    in the text up to 0.32; functions and methods count 1.1-fold, spans of up to 20 and 50 lines
    gain 0.05 and 0.02. final = 0.45 * score + 0.55 * boost / greatest boost; no boost at all
    leaves the scores.
    """
    asked = query_tokens.groupBy("query_id").agg(F.collect_set(F.lower("token")).alias("tokens"))
    rows = results.join(asked, "query_id", "left")
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    symbol, name = F.lower("symbol"), F.lower(basename(F.col("file")))

    def any_token(test: Callable[[Column], Column]) -> Column:
        return F.exists(tokens, test)

    text = F.lower("text")
    hits = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    lines = F.col("end_line") - F.col("start_line") + 1
    boost = (
        F.when(F.array_contains(tokens, symbol), 1.0)
        .when(any_token(lambda t: F.contains(symbol, t)), 0.5)
        .otherwise(0.0)
        + F.when(any_token(lambda t: F.contains(name, t)), 0.4).otherwise(0.0)
        + F.when(F.array_contains(tokens, F.lower("qualified")), 1.0).otherwise(0.0)
        + F.least(F.lit(0.32), 0.08 * hits)
    )
    boost = boost * F.when(F.col("symbol_type").isin("function", "method"), 1.1).otherwise(1.0)
    boost = boost + F.when(boost <= 0, 0.0).when(lines <= 20, 0.05).when(lines <= 50, 0.02).otherwise(0.0)
    own = Window.partitionBy("query_id")
    most = F.max("boost").over(own)
    final = F.when(most > 0, 0.45 * F.col("score") + 0.55 * F.col("boost") / most).otherwise(F.col("score"))
    scored = rows.withColumn("boost", boost).withColumn("final", F.round(final, 6))
    return file_cap(scored.drop("tokens", "score").withColumnRenamed("final", "score"), per_file)


def file_cap(rows: DataFrame, per_file: int, file_col: str = "file") -> DataFrame:
    """Rank in score order with at most ``per_file`` rows of a file first, the overflow after."""
    by_file = Window.partitionBy("query_id", file_col).orderBy(F.desc("score"), F.asc("id"))
    over = F.row_number().over(by_file) > per_file
    order = Window.partitionBy("query_id").orderBy("_over", F.desc("score"), F.asc("id"))
    return rows.withColumn("_over", over).withColumn("rank", F.row_number().over(order)).drop("_over")


#: fixed values: weight of leaves, summaries and community reports
ARTIFACTS = {
    "tree_traversal": {"leaf": 1.5, "raptor": 1.0, "community": 0.7},
    "summary_first": {"leaf": 1.0, "raptor": 1.5, "community": 0.7},
    "corpus_overview": {"leaf": 0.7, "raptor": 1.0, "community": 1.5},
}


def artifact_ranking(rows: DataFrame, mode: str = "tree_traversal", kind_col: str = "kind") -> DataFrame:
    """Rank by score times the weight of a row's kind; the score stays as it was."""
    weight = F.lit(1.0)
    for kind, w in ARTIFACTS.get(mode, {}).items():
        weight = F.when(F.col(kind_col) == kind, F.lit(w)).otherwise(weight)
    scored = rows.withColumn("ranking_score", F.col("score") * weight)
    order = Window.partitionBy("query_id").orderBy(F.desc("ranking_score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order))


def graph_slots(base: DataFrame, expanded: DataFrame, k: int = 10, budget: int = 3) -> DataFrame:
    """The ``k`` best base rows, then up to ``budget`` graph-expanded rows that are not there."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    top = base.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    extra = (
        expanded.join(top, ["query_id", "id"], "left_anti")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= budget)
        .withColumn("rank", F.col("rank") + k)
    )
    keep = ["query_id", "id", "score", "rank"]
    return top.select(*keep, F.lit(False).alias("expanded")).unionByName(
        extra.select(*keep, F.lit(True).alias("expanded"))
    )


def rerank_pool(rows: DataFrame, k: int) -> DataFrame:
    """The candidates worth a model call: the first max(3k, 20) of a query that has over k."""
    return rows.where(F.col("rank") <= max(3 * k, 20))


def rerank(rows: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Order by an injected model's score of (query text, row text), in Arrow batches."""
    score = F.pandas_udf(scorer, "double")
    scored = rows.withColumn("rerank_score", score("query_text", "text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order))


def retrieval_confidence(rows: DataFrame, totals: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Confidence of each query's kept results, and its verdict.

    ``rows`` (query_id, id, score, source) passed the threshold; ``totals`` (query_id, candidates)
    says how many there were before, and names all queries. Five signals up to 1: three rows; a
    best score of threshold + 0.3; a spread of 0.25; two sources; a quarter of the candidates.
    """
    spread = F.when(F.count("id") >= 2, F.max("score") - F.min("score")).otherwise(F.lit(0.0))
    found = (
        totals.join(rows, "query_id", "left")
        .groupBy("query_id")
        .agg(
            F.first("candidates").alias("candidates"),
            F.count("id").alias("n"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("top"),
            spread.alias("spread"),
            F.count_distinct(F.coalesce("source", F.col("id").cast("string"))).alias("sources"),
        )
    )

    def upto(value: Column, good: float) -> Column:
        return F.round(F.least(F.lit(1.0), value / F.lit(good)), 4)

    n, candidates = F.col("n"), F.col("candidates")
    passed = F.when(candidates > 0, upto(n / candidates, 0.25)).otherwise((n > 0).cast("double"))
    total = (
        0.30 * upto(n, 3.0)
        + 0.30 * upto(F.col("top"), min(1.0, threshold + 0.3))
        + 0.15 * upto(F.col("spread"), 0.25)
        + 0.15 * upto(F.col("sources"), 2.0)
        + 0.10 * passed
    )
    scored = found.select("query_id", "n", F.round(total, 4).alias("confidence"))
    return scored.withColumn("verdict", verdict(F.col("confidence")))


def verdict(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def correction(confidence: Column, has_local: Column, web: bool, lite: float = 0.4) -> Column:
    """(trust_local, web_fallback) for results of a confidence."""
    low = confidence < lite
    trust = has_local & ~(low & F.lit(web))
    return F.struct(trust.alias("trust_local"), (F.lit(web) & (~has_local | low)).alias("web_fallback"))
