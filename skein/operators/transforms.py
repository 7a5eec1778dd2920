"""Rewritings of queries by injected models, searched as sub-queries and folded back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.Series], pd.Series]


@dataclass(frozen=True)
class Transforms:
    """Models over query texts; those that are None are left out.

    ``embed`` gives vectors of texts and is needed by all. ``weights`` multiply the scores of a
    kind's sub-queries (query, multi, step_back, decompose; 1 where not named).
    """

    embed: Model
    #: lists of other wordings
    multi: Model | None = None
    #: a broader question
    step_back: Model | None = None
    #: lists of the questions it is made of
    decompose: Model | None = None
    #: a text that would answer it, embedded in the query's place
    hyde: Model | None = None
    weights: dict[str, float] = field(default_factory=dict)


def sub_queries(queries: DataFrame, models: Transforms) -> DataFrame:
    """(sub_id, query_id, variant, kind, weight, text, embedding): each query (query_id, text) as variant
    0, then what the models make of it, in the order multi, step_back, decompose.

    A text that is already among the variants, null or empty is left out. Variant 0's embedding is
    that of the hypothetical answer, if there is one. A null query text is searched as empty.
    """

    def listed(kind: str, texts: Column) -> Column:
        clean = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
        return F.transform(clean, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    text = F.coalesce("text", F.lit(""))
    rows = queries.select("query_id", text.alias("text"))
    made = [F.array(F.struct(F.lit("query").alias("kind"), F.col("text").alias("text")))]
    if models.multi:
        made.append(listed("multi", F.pandas_udf(models.multi, "array<string>")("text")))
    if models.step_back:
        made.append(listed("step_back", F.array(F.pandas_udf(models.step_back, "string")("text"))))
    if models.decompose:
        made.append(listed("decompose", F.pandas_udf(models.decompose, "array<string>")("text")))
    answer = F.pandas_udf(models.hyde, "string")("text") if models.hyde else F.lit(None).cast("string")
    rows = rows.select("query_id", F.concat(*made).alias("made"), answer.alias("answer"))
    texts = F.transform("made", lambda m: m["text"])
    first = F.filter("made", lambda m, i: F.array_position(texts, m["text"]) == i + 1)
    rows = rows.select("query_id", "answer", F.posexplode(first).alias("variant", "m"))
    weight = F.lit(1.0)
    for kind, w in models.weights.items():
        weight = F.when(F.col("m.kind") == kind, F.lit(float(w))).otherwise(weight)
    told = F.when((F.col("variant") == 0) & (F.coalesce("answer", F.lit("")) != ""), F.col("answer")).otherwise(F.col("m.text"))
    return rows.select(
        F.concat_ws("#", F.col("query_id").cast("string"), "variant").alias("sub_id"), "query_id", "variant", F.col("m.kind").alias("kind"),
        weight.alias("weight"), F.col("m.text").alias("text"), F.pandas_udf(models.embed, "array<float>")(told).alias("embedding"),
    )


def folded(hits: DataFrame, subs: DataFrame) -> DataFrame:
    """Hits (query_id, id, score) of sub-queries as hits of the queries that they were made of: the best
    weighted score of each row counts."""
    told = hits.withColumnRenamed("query_id", "sub_id").join(subs.select("sub_id", "query_id", "weight"), "sub_id")
    return told.groupBy("query_id", "id").agg(F.round(F.max(F.col("score") * F.col("weight")), 6).alias("score"))
