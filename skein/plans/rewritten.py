"""Hybrid search of questions that models take apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.index import embed
from skein.operators.transforms import Transforms, sub_queries
from skein.plans.ranking import TOKENS, asked
from skein.plans.registry import registry, table
from skein.plans.retrieval import search_raw

QUERIES, query = registry()


def counted(texts: pd.Series) -> pd.Series:
    """A small model of vectors: characters, spaces and full stops."""
    return texts.map(lambda t: [float(len(t)), float(t.count(" ")), float(t.count("."))])


#: Halves of a question as its parts, its first 40 characters as the broader one.
MODELS = Transforms(
    embed=counted,
    step_back=lambda texts: texts.str[:40],
    decompose=lambda texts: texts.map(lambda t: [t[: len(t) // 2], t[len(t) // 2 :]]),
)
VARIANTS = """made AS (SELECT item_id AS query_id, [text, substr(text, 1, 40), substr(text, 1, len(text) // 2), substr(text, len(text) // 2 + 1)] AS l,
  ['query', 'step_back', 'decompose', 'decompose'] AS k FROM benchmark),
placed AS (SELECT query_id, unnest(l) AS text, unnest(k) AS kind, unnest(range(4)) AS i FROM made),
firsts AS (SELECT query_id, text, arg_min(kind, i) AS kind, min(i) AS i FROM placed WHERE text <> '' OR i = 0 GROUP BY 1, 2),
subs AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS variant, kind, text FROM firsts)"""
VECTOR = "[len({t}), len({t}) - len(replace({t}, ' ', '')), len({t}) - len(replace({t}, '.', ''))]::DOUBLE[]"
TRANSFORMED = f"""WITH {VARIANTS},
dv AS (SELECT doc_id AS id, {VECTOR.format(t="coalesce(text, '')")} AS e FROM documents),
sv AS (SELECT query_id, variant, {VECTOR.format(t="text")} AS e FROM subs),
pairs AS (SELECT query_id, variant, id, round(CASE WHEN n > 0 THEN d / n ELSE 0 END, 6) AS score FROM (
  SELECT query_id, variant, id, list_inner_product(dv.e, sv.e) AS d, sqrt(list_inner_product(dv.e, dv.e)) * sqrt(list_inner_product(sv.e, sv.e)) AS n FROM dv, sv)),
near AS (SELECT query_id, id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS r FROM pairs) WHERE r <= 30 GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near),
w AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
l AS (SELECT id, len(w) AS dl FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY 1, 2),
t AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p, s GROUP BY term),
asked AS (SELECT DISTINCT query_id, variant, unnest({TOKENS}) AS term FROM subs),
hits AS (SELECT query_id, variant, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN t USING (term) JOIN p USING (term) JOIN l USING (id), s GROUP BY 1, 2, 3),
said AS (SELECT query_id, id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS r FROM hits WHERE score > 0) WHERE r <= 30 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM said),
f AS (SELECT query_id, id, round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + b.rank), 0), 6) AS score, v.score AS vector FROM v FULL OUTER JOIN b USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f WHERE vector IS NULL OR vector >= 0.3)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


@query(f"WITH {VARIANTS} SELECT query_id, variant, kind, text FROM subs")
def query_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-queries of the benchmark's texts."""
    return sub_queries(asked(spark, sf_dir), MODELS).select("query_id", "variant", "kind", "text")


@query(TRANSFORMED)
def transformed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of questions with a step back and taken apart."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = embed(documents, counted).select("id", "embedding")
    return search_raw(asked(spark, sf_dir), vectors, documents, transforms=MODELS).select("query_id", "id", "score", "rank")
