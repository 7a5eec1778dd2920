"""Answers over all reports of a graph: points from every report's pieces, the best of them reduced."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import seeded, token_estimate
from skein.operators import context, graph
from skein.operators.quantized import QuantizedIndex
from skein.plans import ranking
from skein.plans.incremental import folder
from skein.plans.registry import registry, table
from skein.session import cut_lineage

QUERIES, query = registry()

NO_DATA = "I am sorry but I am unable to answer this question given the provided data."
POINTS = "array<struct<point:string,score:double>>"
#: Marks that models put around JSON.
FENCE = r"^\s*```(?:json)?\s*|\s*```\s*$"


def map_reduce(
    reports: DataFrame,
    queries: DataFrame,
    mapper: Callable[[pd.Series, pd.Series], pd.Series],
    reducer: Callable[[pd.Series, pd.Series], pd.Series],
    level: int = 0,
    communities: int = 10,
    chars: int = 2000,
    floor: int = 20,
    most: int = 50,
    budget: int = 8000,
    seed: int = 42,
) -> DataFrame:
    """(query_id, answer, points) of each query (query_id, text) over reports (id, text, level).

    One plan: the reports of ``level`` (all, where it has none); the ``communities`` of them that share
    most of a query's words; pieces of ``chars`` characters, spread over tasks in an order drawn by
    ``seed``, so that no task has one report's pieces alone; ``mapper`` (question, piece) answers
    each with a JSON list of points and scores, fenced or not; the best ``most`` points of at least
    ``floor``, as many as stay within ``budget`` tokens in the order of their scores (summed in
    ranges, however many a query has); ``reducer`` (question, points) writes the answer of more than
    one point, a single point is the answer, and a query without points has NO_DATA.

    What is not a list of points gives none. Null and empty reports have no pieces. Repeated reports
    repeat their points. A query's points are at most ``most``, so one row holds them.
    """
    known = graph.reports_of_level(reports, level).select("id", "text")
    near = cut_lineage(context.relevance(known, queries, communities).select("query_id", "id"))
    # only the chosen reports are cut
    chosen = known.join(near.select("id").distinct(), "id", "left_semi")
    pieces = context.report_chunks(chosen, chars).withColumnRenamed("report_id", "id")
    asked = pieces.join(near, "id").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    drawn = asked.withColumn("_turn", seeded(F.concat_ws("#", "query_id", "id", "part"), seed))
    said = drawn.repartition("_turn").withColumn("said", F.pandas_udf(mapper, "string")("question", "chunk"))
    points = said.select("query_id", F.explode(F.from_json(F.regexp_replace("said", FENCE, ""), POINTS)).alias("p"))
    points = points.select("query_id", F.coalesce("p.score", F.lit(0.0)).alias("score"), "p.point").where("point <> ''")
    best = context.best_points(points, floor, most)
    kept = graph.prefix_budget(best.select("query_id", "rank", "point", "score"), budget, token_estimate(F.col("point")))
    listed = F.array_sort(F.collect_list(F.struct("rank", "point")))
    told = kept.groupBy("query_id").agg(listed.alias("listed"))
    told = queries.select("query_id", F.col("text").alias("question")).join(told, "query_id", "left")
    found = F.transform("listed", lambda x: x["point"])
    told = told.select("query_id", "question", F.coalesce(found, F.array().cast("array<string>")).alias("points"))
    whole = F.array_join("points", "\n")
    answer = (
        F.when(F.size("points") == 0, F.lit(NO_DATA))
        .when(F.size("points") == 1, whole)
        .otherwise(F.pandas_udf(reducer, "string")("question", whole))
    )
    return told.select("query_id", answer.alias("answer"), F.size("points").alias("points"))


def say(questions: pd.Series, pieces: pd.Series) -> pd.Series:
    """A model that makes a point of a piece's beginning; every other answer is fenced."""

    def one(piece: str) -> str:
        score = len(piece) * 7 % 101
        answer = json.dumps([{"point": piece[:40], "score": score}, {"score": 99}])
        return f"```json\n{answer}\n```" if score % 2 else answer

    return pieces.map(one)


def write(questions: pd.Series, points: pd.Series) -> pd.Series:
    return questions.str[:10] + ": " + points


MAP_REDUCE = r"""WITH known AS (SELECT doc_id AS id, text FROM documents WHERE lang = 'en'),
dw AS (SELECT id, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> ''))) AS w FROM known),
q AS (SELECT item_id AS query_id, text, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS ws FROM benchmark),
qw AS (SELECT query_id, len(ws) AS n, unnest(ws) AS w FROM q),
near AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r
  FROM (SELECT query_id, id, round(count(*) / any_value(n), 6) AS score FROM qw JOIN dw USING (w) GROUP BY 1, 2)) WHERE r <= 10),
pieces AS (SELECT id, substr(text, 500 * part + 1, 500) AS chunk FROM (SELECT id, text, unnest(range((len(text) + 499) // 500)) AS part FROM known WHERE len(text) > 0)),
points AS (SELECT query_id, substr(chunk, 1, 40) AS point, len(chunk) * 7 % 101 AS score FROM near JOIN pieces USING (id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point) AS rank FROM points WHERE score >= 20),
spent AS (SELECT *, sum(len(point) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM best WHERE rank <= 12),
told AS (SELECT query_id, count(*) AS points, string_agg(point, chr(10) ORDER BY rank) AS whole FROM spent WHERE spent <= 80 GROUP BY 1)
SELECT query_id, CAST(coalesce(points, 0) AS INTEGER) AS points, CASE WHEN points IS NULL THEN 'NO_DATA'
  WHEN points = 1 THEN whole ELSE concat(substr(text, 1, 10), ': ', whole) END AS answer FROM q LEFT JOIN told USING (query_id)""".replace("NO_DATA", NO_DATA)


@query(MAP_REDUCE)
def global_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts asked of all English documents, read as reports."""
    level = F.when(F.col("lang") == "en", 0).otherwise(1)
    reports = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", level.alias("level"))
    return map_reduce(reports, ranking.asked(spark, sf_dir), say, write, communities=10, chars=500, most=12, budget=80)


@query()
def quantized_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all, by a saved index of codes; recall is measured in the tests."""
    at = folder(spark, "codes")
    QuantizedIndex.build(ranking.vectors(spark, sf_dir)).save(at)
    return QuantizedIndex.load(spark, at).search(ranking.vector_queries(spark, sf_dir), rerank=40)
